import pytest
from pyspark.sql import functions as F

from semgraph import tools
from semgraph.operators.build import written
from semgraph.operators.reads import runtime_reachable
from semgraph.plans.graph_queries import rules
from test_graph import edge, make, rows, sym


def session(spark):
    s = [
        sym("mod:A", "module", name="A"), sym("mod:B", "module", name="B"), sym("file:a.cs", "file", "mod:A", "a.cs"), sym("type:N.T", "type", "file:a.cs", "a.cs", "T"), sym("method:N.T.Go()", "method", "type:N.T", "a.cs", "Go"),
        sym("file:tests/t.cs", "file", "mod:B", "tests/t.cs"), sym("type:N.TTests", "type", "file:tests/t.cs", "tests/t.cs", "TTests"), sym("method:N.TTests.Check()", "method", "type:N.TTests", "tests/t.cs", "Check", props={"attributes": "Test"}),
        sym("type:N.Other", "type", "file:tests/t.cs", "tests/t.cs", "Other"), sym("method:N.Other.Look()", "method", "type:N.Other", "tests/t.cs", "Look", props={"attributes": "Test"}),
    ]
    g = written(make(spark, s, [edge("method:N.TTests.Check()", "method:N.T.Go()"), edge("mod:B", "mod:A", "dependsOn")]))
    files = spark.createDataFrame([("a.cs", "class T {}"), ("tests/t.cs", "// T by name"), ("n.md", "- **INV-A-1. One.** x")], "path string, content string")
    return tools.Session(g, rules(spark), files)


def test_tools(spark):
    s = session(spark)
    assert s.capabilities()["symbols"] == 10
    assert rows(s.lookup("T"), "id", "files") == [("type:N.T", "a.cs")]
    assert rows(s.dependants("method:N.T.Go"), "node", "bucket") == [("method:N.TTests.Check()", "Test")]
    assert s.dependants("Go", exclude_tests=True).count() == 0
    assert rows(s.dependants("Go", group_by="both"), "bucket", "module_name", "n") == [("Test", "B", 1)]
    assert rows(s.blast_radius("Go", group_by="module"), "module_name", "preview") == [("B", "method:N.TTests.Check()")]
    assert rows(s.file_impact("a.cs"), "side", "file", "edge_count") == [("used_by", "file:tests/t.cs", 1)]
    assert rows(s.test_impact("T"), "test_class", "confidence") == [("type:N.TTests", "Direct")]
    assert rows(s.test_impact("type:N.T", reflection=True), "test_class", "distance") == [("type:N.Other", 2**31 - 1), ("type:N.TTests", 1)]
    assert s.partial_view("T").first().view == "// a.cs\nclass T {}"
    assert rows(s.invariant_check(), "id") == [("INV-A-1",)] and s.invariant_check(id_="INV-A-2").count() == 0
    assert rows(s.resolve_member("T", "Go", []), "outcome", "id") == [("Unique", "method:N.T.Go()")] and rows(s.resolve_member("T", "Go", ["int"]), "outcome", "id") == [("NotFound", None)]
    assert rows(s.resolve_member("Gone", "Go"), "outcome") == [("TypeNotFound",)]
    assert s.execute("select count(*) n from {symbols}").first().n == 10
    assert s.execute("with x as (select id from {symbols} where id in (select target_id from {edges})) select struct(count(*) n) s, '{not}' t from x").first().t == "{not}"
    assert rows(s.dependants("Go"), "total_before_filter") == [(1,)] and rows(s.blast_radius("Go", max_results=-1), "node", "full_count") == [("method:N.TTests.Check()", 1)] and s.blast_radius("Go", max_results=0).count() == 0
    assert rows(s.resolve_short_name("Goo"), "name", "is_near")[0] == ("Go", True) and rows(s.resolve_short_name("go"), "id", "is_near") == [("method:N.T.Go()", False)]
    assert set(s.context()) == set(tools.SECTIONS) and s.context(("hotspots",), hotspots=0)["hotspots"].count() == 0
    assert s.reload(s.g).g.generation == 2 and s.envelope("lookup").band == "Proven"
    assert s.analyze()["metrics"].first().modules == 2


@pytest.mark.parametrize("sql", [
    "drop table symbols", "insert into t values (1)", "create table t as select 1", "create temp view v as select 1", "set x = 1", "with x as (select 1 a) insert into t select a from x",
    "with x as (select 1 a) insert overwrite directory '{folder}' using parquet select a from x", "from (select 1 a) insert overwrite directory '{folder}' using parquet select a", "truncate table t",
    "explain select 1", "describe table t", "cache table t as select 1", "delete from t", "refresh table t", "use x",
])
def test_execute_is_read_only(spark, tmp_path, sql):
    with pytest.raises(ValueError):
        session(spark).execute(sql.replace("{folder}", str(tmp_path / "out")))
    assert not (tmp_path / "out").exists()


def test_module_order_with_a_cycle(spark):
    mods = [sym(m, "module") for m in "abcde"]
    g = make(spark, mods, [edge(x, y, "dependsOn") for x, y in ("ab", "bc", "cb", "cd", "ad")])
    assert rows(tools.module_order(g)) == [("a", 2), ("b", 1), ("c", 1), ("d", 0), ("e", 0)]


def test_capped(spark):
    df = spark.range(10)
    assert [tools.capped(df, n, F.desc("id"))[0].count() for n in (-1, 0, 3)] == [10, 0, 3] and tools.capped(df, 0)[1] == 10


def test_asset_calls_keep_methods_alive(spark):
    g = make(spark, [sym("T", "type"), sym("T.Go", parent="T", path="S.cs", name="Go")], [])
    calls = spark.createDataFrame([("S.cs", "Go")], "script_path string, method string")
    assert rows(runtime_reachable(g, calls), "id") == [("T",), ("T.Go",)]
