"""Walks that hold the graph: the same rows as level by level, without a pair written on the way."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_graph import EDGE, SYM, edge, make, rows, sym

from semgraph.operators import analysis as A
from semgraph.operators import context as C
from semgraph.operators import reads as R
from semgraph.operators import traverse
from semgraph.operators.build import edge_kind, edge_role
from semgraph.operators.deliveries import newest, newest_of_few
from semgraph.operators.traverse import reach, reach_by_level, reach_paths


def tangle(spark, n=40, m=90):
    r = random.Random(5)
    e = [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)] + [("n00", None), (None, "n01")]
    return spark.createDataFrame(e, "src string, dst string")


@pytest.mark.parametrize("depth", [None, 0, 1, 3])
def test_reach_holds_the_graph(spark, monkeypatch, depth):
    steps = tangle(spark)
    seeds = spark.createDataFrame([("a", "n00"), ("a", "n07"), ("a", "n00"), ("b", "n01"), ("c", "alone"), ("é", "n02")], "root string, node string")
    want = rows(reach_by_level(steps, seeds, depth))
    assert rows(reach(steps, seeds, depth, held=0)) == want
    monkeypatch.setattr(traverse, "reach_by_level", None)
    assert rows(reach(steps, seeds, depth)) == rows(reach(steps, seeds, depth, kept=False)) == want


def knot(spark):
    r = random.Random(8)
    s = [sym("m1", "module"), sym("m2", "module"), *[sym(f"T{i}", "type", f"m{1 + i % 2}") for i in range(6)]]
    s += [sym(f"f{i:02}", parent=f"T{i % 6}", props={"attributes": "Test"} if i % 4 == 0 else None, name=f"name{i % 9}", path=f"src/{i}Tests.cs" if i % 3 else None) for i in range(30)]
    return make(spark, s, [edge(f"f{r.randrange(30):02}", r.choice([f"f{r.randrange(30):02}", f"T{r.randrange(6)}"])) for _ in range(70)])


def test_blast_radius_writes_no_pair(spark):
    """the pairs are the result; they are not written before."""
    g = knot(spark)
    got = A.blast_radius(g, g.symbols.where("kind = 'type'").select("id"))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("label", ["bucket", "module_name", None])
def test_blast_groups(spark, monkeypatch, label):
    """figures by group are those of the pairs, and need no pairs."""
    g = knot(spark)
    t = g.symbols.where("kind = 'type'").select("id")
    labels = {"bucket": g.symbols.select(F.col("id").alias("node"), F.col("bucket").alias("label")), "module_name": A.module_name_of(g).select(F.col("id").alias("node"), F.col("module_name").alias("label")), None: None}[label]
    pairs = A.blast_radius(g, t, 4)
    pairs = pairs.withColumn("label", F.lit("")) if label is None else pairs.join(labels, "node")
    want = rows(A.grouped(pairs, ["root", "label"], 3), "root", "label", "n", "n_direct", "preview")
    assert want and rows(A.blast_groups(g, t, labels, 4, 3, held=0), "root", "label", "n", "n_direct", "preview") == want
    monkeypatch.setattr(A, "reach_by_level", None)
    got = A.blast_groups(g, t, labels, 4, 3)
    shown = ["root", "label", "n", "n_direct", "preview"] if label else ["root", "label", "n", "n_direct"]
    assert rows(got, *shown) == [x[: len(shown)] for x in want]
    assert rows(got, "root", "label", "deepest") == rows(pairs.groupBy("root", "label").agg(F.max("dist").alias("deepest")))


@pytest.mark.parametrize("kind", ["type", "file"])
def test_test_impact_needs_no_pairs(spark, monkeypatch, kind):
    """F6, F9."""
    g = knot(spark) if kind == "type" else make(spark, [sym("file:a", "file"), sym("T", "type", "file:a"), sym("x", parent="T", path="a"), sym("t", parent="T", path="a", props={"attributes": "Fact"}, name="b"), sym("u", parent="T", props={"attributes": "Fact"}, name="b")], [("t", "x"), ("u", "t")])
    t = g.symbols.where(F.col("kind") == kind).select("id")
    want = rows(A.test_impact(g, t, held=0))
    monkeypatch.setattr(A, "reach_by_level", None)
    assert want and rows(A.test_impact(g, t)) == want


def test_dependency_matrix_walks_once(spark, monkeypatch):
    """containment and inheritance of any depth take no job per level."""
    n = 40
    s = [sym("m", "module"), sym("o", "module"), sym("T0", "type", "m"), *[sym(f"T{i}", "type", f"T{i - 1}") for i in range(1, n)], sym("x", parent="o")]
    g = make(spark, s, [edge("m", "o", "dependsOn"), edge(f"T{n - 1}", "x"), *[edge(f"T{i}", f"T{i + 1}", "inherits") for i in range(n - 1)]])
    monkeypatch.setattr(traverse, "reach_by_level", None)
    assert rows(C.dependency_matrix(g)) == [("m", "o", 1)]
    assert R.interface_closure(g).count() == n * (n - 1) // 2


def test_ways_to_authorities(spark):
    """two rows a node, and of the shortest ways the first one, as walks from every method find it."""
    r = random.Random(3)
    s = [sym("G", "type"), sym("A", "type"), *[sym(f"g{i}", parent="G") for i in range(3)], *[sym(f"a{i}", parent="A") for i in range(2)], *[sym(f"S{i}", "type", vis="public") for i in range(5)], *[sym(f"f{i:02}", parent=f"S{i % 5}") for i in range(30)]]
    ends = [f"f{i:02}" for i in range(30)] + ["g0", "g1", "g2", "a0", "a1"]
    g = make(spark, s, [edge(f"f{r.randrange(30):02}", r.choice(ends), r.choice(["calls", "references"])) for _ in range(45)])
    pick = lambda *ids: g.symbols.where(F.col("id").isin(*ids)).select("id")
    got = R.authority_coverage(g, g.symbols.where("id like 'S%'").select("id"), pick("G"), pick("A"), 4)
    parts = spark.createDataFrame([("G", "G", 0), ("A", "A", 1), *[("G", f"g{i}", 0) for i in range(3)], *[("A", f"a{i}", 1) for i in range(2)]], "authority string, node string, alt int")
    order = F.row_number().over(Window.partitionBy("source_id").orderBy("target_id", "kind_ord", "role"))
    steps = g.links.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), order.cast("bigint").alias("ord"), F.col("kind").alias("via"))
    seeds = g.symbols.where("id like 'f%'").select(F.col("id").alias("root"), F.col("id").alias("node"))
    hits = reach_paths(steps, seeds, 4).withColumnRenamed("root", "seed").join(parts, "node").join(g.symbols.select(F.col("id").alias("seed"), F.col("parent_id").alias("root")), "seed")
    best = hits.groupBy("root").agg(F.min(F.struct("alt", "dist", "seed", "node", "authority", "nodes", "vias")).alias("b"))
    want = rows(best.select("root", "b.dist", "b.seed", "b.authority", F.array_join("b.nodes", " > "), F.array_join("b.vias", ",")))
    assert want and rows(got.where("distance is not null").select("id", "distance", "seed", "authority", "path", "vias")) == want
    levels = R._way_to(g, parts.withColumnRenamed("node", "part"), 4)
    assert sum(x.count() for x in levels) <= 2 * g.symbols.count()


def test_resolve_counts_names_before_they_are_joined(spark):
    """F5, F8: inputs and symbols of one name do not meet pair by pair."""
    g = make(spark, [sym(f"method:N.T{i}.Go(int)", name="Go") for i in range(4)] + [sym("type:N.Go", "type", name="Go")], [])
    asked = spark.createDataFrame([(x,) for x in ["method:N.T1.Go(System.Int32)", "method:X.Go(a)", "X.Go", "Go", "type:X.Go", " method:N.T0.Go"]], "input string")
    got = R.resolve(g, asked)
    assert {r.input: (r.outcome, r.id, r.n_candidates) for r in got.collect()} == {
        "method:N.T1.Go(System.Int32)": ("Exact", "method:N.T1.Go(int)", 1), "method:X.Go(a)": ("Ambiguous", None, 4), "X.Go": ("Ambiguous", None, 5),
        "Go": ("Ambiguous", None, 5), "type:X.Go": ("Lenient", "type:N.Go", 1), " method:N.T0.Go": ("Lenient", "method:N.T0.Go(int)", 1),
    }
    assert "lname" in got._jdf.queryExecution().optimizedPlan().toString()


def raw_tangle(spark, seed):
    """Symbols and edges as told: ids under several parents, cycles of containment and inheritance, missing ends, edges told twice, files."""
    r = random.Random(seed)
    s = [sym(f"m{i}", "module", "m0" if i == 1 else None) for i in range(4)] + [sym(f"file:f{i}", "file", f"m{i % 5}") for i in range(6)]
    s += [sym(f"T{i}", "type", r.choice(["m0", "m1", "m2", "m3", "gone", f"T{r.randrange(8)}"]), path=f"f{i}", props={"typeKind": "interface"} if i % 2 else None) for i in range(8)]
    s += [sym(f"x{i:02}", r.choice(["method", "field"]), f"T{r.randrange(8)}", path=f"f{r.randrange(8)}") for i in range(30)]
    ids = [x[0] for x in s]
    some = lambda: r.choice([*ids, "gone"])
    e = [edge(some(), some(), r.choice(["calls", "references"]), {"native.kind": r.choice("ab")} if r.random() < 0.5 else None, n=n) for n in range(160)]
    e += [edge(f"m{r.randrange(4)}", r.choice(["m0", "m1", "m2", "m3", "gone", "T1"]), "dependsOn", {"native.kind": r.choice("ab")}, n=200 + n) for n in range(12)]
    e += [edge("m1", "m0", "contains"), edge("m2", "T0", "contains"), edge("m3", "T0", "contains"), edge("m3", "gone", "contains"), edge("T0", "T1", "contains"), edge("file:f0", "file:f1", "references"), edge("T2", "file:f1", "implements"), edge("T1", "T3", "inherits"), edge("T3", "T1", "inherits")]
    e += [edge(f"T{r.randrange(8)}", r.choice([f"T{r.randrange(8)}", "gone"]), r.choice(["inherits", "implements"]), n=300 + n) for n in range(16)]
    return s, e


def slim(spark, s, e):
    symbols, edges = spark.createDataFrame(s, SYM), spark.createDataFrame(e, EDGE)
    symbols = symbols.select("id", "kind", (F.coalesce(F.col("properties")["typeKind"], F.lit("")) == "interface").alias("face"), "file_path", "parent_id").withColumn("no", F.monotonically_increasing_id())
    return symbols, edges.select("source_id", "target_id", edge_kind(F.col("kind")).alias("kind"), edge_role(F.col("properties")).alias("role"))


def matrix_by_hand(g):
    """The SQL of dependency_matrix over a built graph in plain Python."""
    kind = {x.id: x.kind for x in g.symbols.collect()}
    e = [(x.source_id, x.target_id, x.kind) for x in g.edges.collect()]
    inside = {(s, t) for s, t, k in e if k == "contains" and kind.get(s) == "module"}
    while more := {(m, t) for m, x in inside for s, t, k in e if k == "contains" and s == x} - inside:
        inside |= more
    n = Counter((a, b) for s, t, k in e if k != "contains" for a, x in inside if x == s for b, y in inside if y == t)
    return sorted((s, t, max(1, n[s, t])) for s, t, k in e if k == "dependsOn" and kind.get(s) == "module")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dependency_matrix_builds_no_graph(spark, seed):
    """from what is told, without the graph, and a module on a cycle of containment lies in itself."""
    s, e = raw_tangle(spark, seed)
    g = make(spark, s, e)
    want = matrix_by_hand(g)
    assert max(n for *_, n in want) > 20
    assert rows(C.dependency_matrix(g)) == want
    assert rows(C.dependency_matrix_of(*slim(spark, s, e))) == want


@pytest.mark.parametrize("few", [None, 1])
def test_newest_of_few(spark, few):
    """rows of a key of their own are not compared."""
    t = spark.createDataFrame([(i % 40 if i < 43 else None, i, f"v{i}") for i in range(45)], "k long, at int, v string")
    assert rows(newest_of_few(t, "k", ["at"], ["v"], few)) == rows(newest(t, "k", ["at"], ["v"]))


def usage_by_hand(g):
    """The SQL of interface_usage over a built graph in plain Python."""
    kind, face = {x.id: x.kind for x in g.symbols.collect()}, {x.id for x in g.symbols.collect() if x.properties.get("typeKind") == "interface"}
    e = {(x.source_id, x.target_id, x.kind) for x in g.edges.collect()}
    con = {(s, t) for s, t, k in e if kind.get(s) == "type" and k == ("inherits" if s in face else "implements")}
    up = {(s, t) for s, t, k in e if k == "inherits"}
    clo = set(up)
    while more := {(a, t) for a, b in clo for s, t in up if s == b} - clo:
        clo |= more
    held = lambda x: {t for s, t, k in e if k == "contains" and s == x and kind[t] != "type"}
    out = []
    for i, c in con:
        above = {b for a, b in clo if a == c}
        parts = {p for n in above | {c} for p in {n} | held(n)}
        own, more = len(held(c)), sum(len(held(n)) for n in above)
        out.append((i, c, own, more, own + more, len({s for s, t, k in e if k in ("calls", "references") and t in parts})))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_interface_usage_builds_no_graph(spark, monkeypatch, seed):
    """from what is told, without the graph, walking from contracts alone, and users of ancestors are joined once for those who share them."""
    s, e = raw_tangle(spark, seed)
    g = make(spark, s, e)
    want = usage_by_hand(g)
    assert any(x[1] == "file:f1" and x[5] for x in want) and any(x[3] for x in want)
    assert rows(R.interface_usage(g)) == want
    seeds = []
    monkeypatch.setattr(R, "reach", lambda steps, s, *a: seeds.append(s) or reach(steps, s, *a))
    assert rows(R.interface_usage_of(*slim(spark, s, e))) == want
    assert {x.root for x in seeds[0].collect()} <= {x[1] for x in want}
