import io
import json

import pytest
from test_tools import session

from semgraph.__main__ import drift_of, incremental_graph, main
from semgraph.operators.build import build, written
from semgraph.server import INTERNAL_ERROR, INVALID_PARAMS, INVALID_REQUEST, METHOD_NOT_FOUND, PARSE_ERROR, Server, tool_names
from semgraph.sources import graph_json as J
from semgraph.streaming import incremental as T


def test_line_protocol(spark):
    asked = [
        '{"id":1,"method":"initialize"}', "", '{"method":"notifications/initialized"}', "no json", "[]", '{"id":2}', '{"id":3,"method":"nothing"}', '{"id":4,"method":"tools/list"}',
        '{"id":5,"method":"tools/call","params":{"name":"dependants","arguments":{"symbol":"Go"}}}', '{"id":6,"method":"tools/call","params":{"name":"gone"}}',
        '{"id":7,"method":"tools/call","params":{"name":"dependants","arguments":{"wrong":1}}}', '{"id":8,"method":"tools/call","params":{"name":"execute","arguments":{"sql":"drop table x"}}}', '{"id":9,"method":"ping"}',
    ]
    out = io.StringIO()
    Server(session(spark)).run(io.StringIO("\n".join(asked)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, None, None, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r["error"]["code"] for r in got if "error" in r] == [PARSE_ERROR, INVALID_REQUEST, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INVALID_PARAMS, INTERNAL_ERROR]
    assert {t["name"] for t in got[5]["result"]["tools"]} == set(tool_names()) and len(tool_names()) >= 36
    told = got[6]["result"]
    assert [r["node"] for r in told["content"]["rows"]] == ["method:N.TTests.Check()"] and told["envelope"]["band"] == "Proven"


def doc(**names):
    return json.dumps({"version": "1.0", "symbols": [{"id": k, "name": v, "kind": "type"} for k, v in names.items()], "edges": [{"sourceId": k, "targetId": "a", "kind": "calls"} for k in names if k != "a"]})


def test_incremental_graph_and_its_drift(spark, monkeypatch):
    schema = "document_id string, payload string"
    base = spark.createDataFrame([("1", doc(a="A")), ("2", doc(b="B")), ("3", doc(c="C"))], schema)
    now = spark.createDataFrame([("1", doc(a="A")), ("2", doc(b="B2", d="D")), ("4", doc(e="E"))], schema)
    docs = J.parse(now, "document_id", "payload")
    full = written(build(J.symbols_of(docs), J.edges_of(docs)))
    inc = incremental_graph(spark, base, now)
    assert {r.id for r in inc.symbols.collect()} == {"a", "b", "d", "e"} and drift_of(full, inc).count() == 0
    # a change that is missed is told
    monkeypatch.setattr(T, "content_hash", lambda c: __import__("pyspark.sql.functions").sql.functions.lit("same"))
    missed = {(r.what, r.side, r.key) for r in drift_of(full, incremental_graph(spark, base, now)).collect()}
    assert missed == {("symbol", "full", "b"), ("symbol", "full", "d"), ("symbol", "incremental", "b"), ("edge", "full", "d -> a")}


@pytest.mark.parametrize("command", ["verify", "context", "analyze"])
def test_command_line(spark, tmp_path, capsys, command):
    for name, docs in (("base", {"1": doc(a="A"), "2": doc(b="B")}), ("now", {"1": doc(a="A"), "2": doc(b="B2"), "3": doc(c="C")})):
        (tmp_path / name).mkdir()
        for k, v in docs.items():
            (tmp_path / name / f"{k}.json").write_text(v)
    more = ["--base", str(tmp_path / "base")] if command == "verify" else []
    assert main([command, "--graph", str(tmp_path / "now"), "--rules", "hexagonal", *more]) == 0
    out = capsys.readouterr().out
    assert command != "context" or "- symbols: 3" in out


def test_stream_of_batches_fails_once_and_is_compacted(spark, tmp_path):
    """A batch that fails is repeated on the next start from the same checkpoint and counts once; merged batches give the same rows."""
    schema = "k int, n int, at int"
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda after=None: T.upsert_stream(T.file_stream(spark, src, schema), table, ["k"], ["at"], mark, after).awaitTermination()
    put([(1, 10, 1), (2, 20, 1)])
    run()
    put([(1, 11, 2), (3, 30, 2)])

    def broken(batch, n):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(broken)
    run()
    put([(2, 19, 0), (3, 31, 3)])
    run()
    want = {(1, 11, 2), (2, 20, 1), (3, 31, 3)}
    assert {tuple(r) for r in T.newest_of(spark, table, ["k"], ["at"]).collect()} == want
    last = T.compact(spark, table, ["k"], ["at"])
    assert last == 2 and {tuple(r) for r in T.newest_of(spark, table, ["k"], ["at"]).collect()} == want
    assert spark.read.parquet(table).count() == 3 and T.compact(spark, table, ["k"], ["at"]) == 2
    put([(1, 12, 9)])
    run()
    assert (1, 12, 9) in {tuple(r) for r in T.newest_of(spark, table, ["k"], ["at"]).collect()}
