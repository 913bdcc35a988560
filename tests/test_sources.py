import json

from pyspark.sql import functions as F

from semgraph.operators.build import build
from semgraph.operators.reads import partial_files
from semgraph.sources import graph_json as J
from semgraph.sources.files import asset_calls, modules_of_projects, read_rules, read_texts
from semgraph.sources.python_source import extract
from semgraph.streaming import incremental as T


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_document_defaults(spark):
    doc = {"version": "1.0", "modules": [{"name": "x"}], "adapter": {"name": "ad", "capabilities": {"typeResolution": "proven"}}, "symbols": [{"id": "a", "name": "a"}, {"id": "b", "name": "b", "kind": "Type", "visibility": "Private", "properties": {"k": 1}}], "edges": [{"sourceId": "a", "targetId": "b"}, {"sourceId": "b", "targetId": "a", "kind": "DependsOn", "evidence": {"kind": "semantic"}}]}
    docs = J.parse(spark.createDataFrame([(1, "﻿" + json.dumps(doc)), (2, None), (3, "{"), (4, "[]")], "n int, p string"), "n", "p")
    assert rows(J.symbols_of(docs), "id", "kind", "visibility") == [("a", "module", "public"), ("b", "type", "private")]
    assert rows(J.edges_of(docs), "source_id", "kind", "evidence.confidence", "evidence.adapter_name") == [("a", "contains", "none", "unknown"), ("b", "dependsOn", "bestEffort", "")]
    assert rows(J.adapters_of(docs.where("document_id = 1")), "name", "typeResolution", "callResolution", "discovers") == [("ad", "proven", "none", False)]


def test_documents_round_trip(spark):
    doc = {"version": "1.0", "symbols": [{"id": "a", "name": "a", "kind": "type", "line": 3, "visibility": "private", "properties": {"k": "v"}}, {"id": "b", "name": "b", "kind": "method", "parentId": "a"}], "edges": [{"sourceId": "b", "targetId": "a", "kind": "calls", "callSite": {"filePath": "f", "line": 2, "column": 1}, "profiles": ["P"]}]}
    first = J.parse(spark.createDataFrame([("d", json.dumps(doc))], "n string, p string"), "n", "p")
    out = J.to_documents(J.symbols_of(first), J.edges_of(first), F.lit("d"), F.lit("d"))
    again = J.parse(out, "document_id", "payload")
    cut = lambda df, c: sorted(map(str, df.drop("pos", "ord", "document_id", *c).collect()))
    assert cut(J.symbols_of(again), []) == cut(J.symbols_of(first), []) and cut(J.edges_of(again), []) == cut(J.edges_of(first), [])
    assert "null" not in out.first().payload


def test_python_source(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("")
    (tmp_path / "pkg" / "a.py").write_text("class Base:\n    x: int = 1\n    def run(self, n):\n        return n\n")
    (tmp_path / "pkg" / "b.py").write_text("from pkg.a import Base\n\nclass Sub(Base):\n    other: Base\n    @staticmethod\n    def make():\n        return Base()\n")
    (tmp_path / "bad.py").write_text("def (:")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "c.py").write_text("class Hidden: pass")
    symbols, edges = extract(read_texts(spark, str(tmp_path), "*.py"), "proj")
    g = build(symbols, edges)
    ids = {r.id for r in g.symbols.collect()}
    assert {"mod:proj", "file:bad.py", "type:pkg.a.Base", "field:pkg.a.Base.x", "method:pkg.a.Base.run(n)", "type:pkg.b.Sub", "method:pkg.b.Sub.make()"} <= ids and not any("Hidden" in i for i in ids)
    got = {(r.source_id, r.target_id, r.kind) for r in g.links.collect()}
    assert {("type:pkg.b.Sub", "type:pkg.a.Base", "inherits"), ("method:pkg.b.Sub.make()", "type:pkg.a.Base", "references"), ("file:pkg/b.py", "type:pkg.a.Base", "references"), ("file:pkg/b.py", "file:pkg/a.py", "references")} <= got
    assert rows(partial_files(g).where("id = 'type:pkg.a.Base'"), "primary_file") == [("pkg/a.py",)]


def test_rules_projects_assets_and_excludes(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"name": "n", "version": "1", "rules": [{"id": "A", "source": "*", "mustNotReference": "x"}, {"id": "B", "source": "y"}]}, indent=1))
    assert rows(read_rules(spark, str(tmp_path / "r.json")), "rule_ord", "id", "must_not_reference") == [(0, "A", "x"), (1, "B", None)]
    g1, g2 = "a" * 32, "b" * 32
    (tmp_path / "P.csproj").write_text('<Project><PropertyGroup><DefineConstants>A;B</DefineConstants></PropertyGroup><ItemGroup><ProjectReference Include="..\\Q\\Q.csproj"/><PackageReference Include="N"/></ItemGroup></Project>')
    (tmp_path / "S.cs.meta").write_text(f"guid: {g1}\n")
    (tmp_path / "x.prefab").write_text(f"--- !u!114 &42\nMonoBehaviour:\n  m_Script: {{fileID: 11, guid: {g1}, type: 3}}\n--- !u!114 &43\nMonoBehaviour:\n  m_Calls:\n    m_Target: {{fileID: 42}}\n    m_MethodName: Go\n    m_Target: {{fileID: 7}}\n    m_MethodName: No\n")
    files = read_texts(spark, str(tmp_path))
    assert rows(modules_of_projects(files), "module", "depends_on", "packages", "defines") == [("P", ["Q"], ["N"], ["A", "B"])]
    assert rows(asset_calls(files)) == [("S.cs", "Go", "x.prefab")]
    assert {r.path for r in read_texts(spark, str(tmp_path), exclude=["*.prefab", "?.json"]).collect()} == {"P.csproj", "S.cs.meta"} and g2


MAN = "path string, module string, content_hash string, modified_at int"


def test_modes_and_replacement(spark):
    a = spark.createDataFrame([("x", "m", "1", 1), ("y", "m", "1", 1), ("z", "m", "1", 1), ("m.csproj", "m", "1", 1)], MAN)
    b = spark.createDataFrame([("x", "m", "2", 2), ("y", "m", "1", 2), ("w", "m", "1", 1), ("m.csproj", "m", "1", 1)], MAN)
    diff = T.manifest_diff(a, b)
    assert rows(diff, "path", "status") == [("m.csproj", "same"), ("w", "added"), ("x", "changed"), ("y", "touched"), ("z", "removed")]
    assert T.choose_mode(None, b) == ("FullFallback", "NoPriorAnalysis") and T.choose_mode(a, b) == ("Incremental", None)
    assert T.choose_mode(a, b, "s1", "s2", allow_full=False) == ("Rejected", "AnalysisScopeChanged")
    assert T.choose_mode(a, b.withColumn("module", F.lit("q")))[1] == "ModuleSetChanged"
    assert T.choose_mode(a, b.withColumn("content_hash", F.lit("9")))[1] == "ModuleDescriptorChanged"
    old, new = (spark.createDataFrame([(p, v) for p in ps], "path string, v int") for ps, v in (("xyz", 1), ("xyw", 2)))
    assert rows(T.replace_files(old, new, diff)) == [("w", 2), ("x", 2), ("y", 1)]
    assert rows(T.drift(old, old.limit(2), ["path"]).groupBy("side").count()) == [("full", 1)]
    s = T.staleness(a, b, F.lit("2025-01-01 00:00:00").cast("timestamp"), F.lit("2025-01-01 00:01:00").cast("timestamp")).first()
    assert (s.age_s, s.changed_files, s.stale) == (60, 3, True)


def test_upsert_stream_over_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k string, v int, at int"
    for n, part in enumerate(([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], [("a", 9, 0), ("b", 3, 5), ("c", 1, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        T.upsert_stream(T.file_stream(spark, src, schema, files_per_batch=1), out, ["k"], ["at"], str(tmp_path / "cp")).awaitTermination()
    assert rows(T.newest_of(spark, out, ["k"], ["at"]), "k", "v") == [("a", 2), ("b", 3), ("c", 1)]


def test_windowed_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select timestamp'2025-01-02' t, 'x' k union all select timestamp'2025-01-03', 'x'").write.parquet(src)
    q = T.windowed_counts(spark.readStream.schema("t timestamp, k string").parquet(src), "t", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 2
