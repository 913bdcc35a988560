import random

import pytest
from pyspark.sql import functions as F

from semgraph.functions.paths import glob_pattern, matches_pattern, path_bucket
from semgraph.operators import analysis as A
from semgraph.operators import reads as R
from semgraph.operators.build import build
from semgraph.operators.scc import components
from semgraph.operators.traverse import nearest_ancestor, reach, reach_paths
from semgraph.operators.validate import validate
from semgraph.schema import CALL_SITE, EVIDENCE

SYM = "id string, name string, qualified_name string, kind string, file_path string, line int, parent_id string, visibility string, is_abstract boolean, is_static boolean, properties map<string,string>, ord int"
EDGE = f"source_id string, target_id string, kind string, evidence {EVIDENCE}, properties map<string,string>, call_site {CALL_SITE}, profiles array<string>, ord long"


def sym(id_, kind="method", parent=None, path=None, name=None, vis="internal", props=None, ord_=0, static=False):
    return (id_, name or id_.split(":")[-1].rsplit(".", 1)[-1], None, kind, path, None, parent, vis, False, static, props or {}, ord_)


def edge(s, t, kind="calls", props=None, profiles=None, n=0):
    return (s, t, kind, None, props or {}, None, profiles, n)


def make(spark, symbols, edges):
    symbols = [sym(x) if isinstance(x, str) else x for x in symbols]
    edges = [edge(*x[:2]) if len(x) == 2 else x for x in edges]
    edges = [(*e[:-1], i) for i, e in enumerate(edges)]
    return build(spark.createDataFrame(symbols, SYM), spark.createDataFrame(edges, EDGE))


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_dangling_and_partial_types_and_last_symbol(spark):
    s = [sym("file:a", "file"), sym("file:b", "file"), sym("T", "type", "file:a"), sym("T", "type", "file:b", name="T2", ord_=1), sym("U", "type", "U")]
    g = make(spark, s, [("T", "ghost"), ("ghost", "T"), ("T", "U")])
    assert rows(g.edges, "source_id", "target_id", "kind") == [("T", "U", "calls"), ("file:a", "T", "contains"), ("file:b", "T", "contains")]
    assert rows(g.symbols.where("id = 'T'"), "name") == [("T2",)]


def test_explicit_containment_is_not_repeated(spark):
    g = make(spark, [sym("m", "module"), sym("T", "type", "m")], [edge("m", "T", "Contains")])
    assert rows(g.edges, "source_id", "target_id", "kind") == [("m", "T", "contains")]


def test_roles_and_profiles(spark):
    p, q = {"native.referenceKind": "parameterType"}, {"native.referenceKind": "returnType"}
    e = [edge("f", "S", "references", p, ["P"]), edge("f", "S", "references", q), edge("f", "S", "References", p, ["E"]), edge("f", "S", "references", p), edge("f", "g"), edge("f", "g")]
    g = make(spark, ["f", "S", "g"], e)
    assert rows(g.edges.select("target_id", "role", F.array_join("profiles", ",").alias("p"))) == [("S", "parameterType", "E,P"), ("S", "returnType", None), ("g", "", None)]


def test_file_edges(spark):
    s = [sym(f"file:{c}", "file") for c in "1234"] + [sym("a", path="1"), sym("b", path="2"), sym("c", path="2"), sym("d", path="3"), sym("e", path="4"), sym("f", path="nowhere")]
    g = make(spark, s, [("a", "b"), ("a", "c"), edge("a", "b", "references"), edge("file:3", "file:4", "references"), ("d", "e"), ("a", "f"), ("b", "c")])
    got = g.edges.where("evidence.adapter_name = 'GraphBuilder' and kind = 'references'").select("source_id", "target_id", F.col("properties")["edgeCount"])
    assert rows(got) == [("file:1", "file:2", "3")]
    assert rows(A.file_impact(g)) == [("file:1", "file:2", 3), ("file:3", "file:4", 1)]


def test_validate(spark):
    s = [sym("a"), sym("a", ord_=1), sym("", name="n"), ("b", "", None, "type", None, None, "gone", "public", False, False, {}, 0)]
    e = [("a", "b"), ("a", "b"), ("", "a"), ("a", None), ("a", "x"), ("y", "a"), edge("a", "a", "references"), ("a", "a")]
    e = [edge(*x) if len(x) == 2 else x for x in e]
    got = validate(spark.createDataFrame(s, SYM), spark.createDataFrame([(*x[:-1], i) for i, x in enumerate(e)], EDGE))
    assert sorted(r.code for r in got.collect()) == sorted([
        "DUPLICATE_SYMBOL_ID", "EMPTY_SYMBOL_ID", "EMPTY_SYMBOL_NAME", "DANGLING_PARENT_ID", "DUPLICATE_EDGE", "EMPTY_EDGE_SOURCE", "EMPTY_EDGE_TARGET",
        "DANGLING_EDGE_TARGET", "DANGLING_EDGE_SOURCE", "SELF_REFERENCING_EDGE",
    ])


@pytest.mark.parametrize("path,bucket", [
    (None, "Production"), ("", "Production"), ("src/A.cs", "Production"), ("src/Tests/A.cs", "Test"), ("src/ATests.cs", "Test"), ("src/contests/A.cs", "Production"), ("Editor\\A.cs", "Editor"),
    ("obj/ATests.cs", "Generated"), ("src/A.g.cs", "Generated"), ("src/A.generated.x", "Generated"), ("vendor/tests/A.cs", "Vendored"), ("src/Examples2/A.cs", "Vendored"), ("src/ATest.cs", "Test"),
])
def test_path_bucket(spark, path, bucket):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(path_bucket(F.col("p"))).first()[0] == bucket


def test_patterns(spark):
    cases = [("App.Domain.X", "*.Domain", True), ("Domain", "*.Domain", True), ("App.Domains", "*.Domain", False), ("App.X", "App.*", True), ("App", "App.*", True), ("Apple", "App.*", False), ("a.b.c", "A.B", True), ("a.bc", "a.b", False), ("x", "*", True)]
    df = spark.createDataFrame(cases, "n string, p string, want boolean")
    assert df.where(matches_pattern(F.col("n"), F.col("p")) != F.col("want")).count() == 0
    import re

    assert re.match(glob_pattern("src/*.G?.cs"), "SRC/a/b.g1.cs") and not re.match(glob_pattern("src/*.cs"), "src/a.css")


def chain(spark):
    return make(spark, list("abcd"), [("a", "b"), ("b", "c"), ("c", "d")])


def test_blast_radius(spark):
    g = chain(spark)
    d = g.symbols.where("id = 'd'").select("id")
    assert rows(A.blast_radius(g, d), "node", "dist") == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(A.blast_radius(g, d, 2), "node") == [("b",), ("c",)]
    assert rows(A.blast_radius(g, d, 0)) == []
    loop = make(spark, list("ab"), [("a", "a"), edge("b", "a", "inherits"), ("b", "a")])
    a = loop.symbols.where("id = 'a'").select("id")
    assert rows(A.blast_radius(loop, a), "node") == [("b",)]
    assert rows(A.breaks(loop, a), "node", "break_kind", "reason") == [("a", "BindingRemoval", "calls"), ("b", "SignatureChange", "inherits,calls")]
    assert rows(A.cycles(loop)) == []


def test_first_path(spark):
    steps = spark.createDataFrame([("s", "y", 2, "k2"), ("s", "x", 1, "k1"), ("x", "t", 1, "k3"), ("y", "t", 1, "k4")], "src string, dst string, ord long, via string")
    seeds = spark.createDataFrame([("r", "s")], "root string, node string")
    got = reach_paths(steps, seeds, 5).where("node = 't'").first()
    assert (got.dist, got.nodes, got.vias) == (2, ["s", "x", "t"], ["k1", "k3"])


def test_long_chains_and_rings_are_contracted(spark):
    """A chain of 300 nodes into a ring of 300 with a chain out, a ring of two, and a dense core: no job per node."""
    e = [(f"a{i:03}", f"a{i + 1:03}") for i in range(300)] + [("a300", "r000")] + [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)] + [("r007", "z0")] + [(f"z{i}", f"z{i + 1}") for i in range(50)]
    e += [("p", "q"), ("q", "p"), ("q", "q"), (None, "p"), ("p", None)] + [(f"d{i}", f"d{j}") for i in range(6) for j in range(6) if i != j] + [("d0", "a000")]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(e, "src string, dst string"), last_edges=0).collect()}
    assert got == {(f"r{i:03}", "r299") for i in range(300)} | {("p", "q"), ("q", "q")} | {(f"d{i}", "d5") for i in range(6)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_reach_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 40
    e = sorted({(f"v{rnd.randrange(n):02}", f"v{rnd.randrange(n):02}") for _ in range(55)})
    out = {}
    for a, b in e:
        out.setdefault(a, []).append(b)
    far = {}
    for v in {x for p in e for x in p}:
        seen, front, k = {v: 0}, [v], 0
        while front:
            k += 1
            front = [w for w in dict.fromkeys(w for u in front for w in out.get(u, [])) if w not in seen]
            seen.update(dict.fromkeys(front, k))
        far[v] = seen
    want = {(v, max(w for w in far[v] if v in far[w])) for v in far if sum(v in far[w] for w in far[v]) > 1}
    df = spark.createDataFrame(e, "src string, dst string")
    assert {tuple(r) for r in components(df).collect()} == want
    assert {tuple(r) for r in components(df, last_edges=0).collect()} == want
    seeds = spark.createDataFrame([(v, v) for v in sorted(far)[::5]], "root string, node string")
    assert {(r.root, r.node, r.dist) for r in reach(df, seeds, None).collect()} == {(v, w, k) for v in sorted(far)[::5] for w, k in far[v].items()}


def test_cycle_classes(spark):
    s = [sym("T", "type"), sym("a", parent="T"), sym("b", parent="T"), sym("c"), sym("d"), sym("g", path="obj/g.cs"), sym("h"), sym("i"), sym("j")]
    e = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("g", "h"), ("h", "g"), edge("i", "j", "references", {"initializerOwner": "methodGroup"}), ("j", "i")]
    g = make(spark, s, e)
    got = A.cycle_taxonomy(g, A.cycles(g))
    assert rows(got) == [("b", 2, "PartialClassCluster"), ("d", 2, "LikelyRealLoop"), ("h", 2, "GeneratedOrStaticAnalysisArtifact")]
    assert rows(A.cycle_stats(got), "class", "n_cycles", "largest")[0] == ("GeneratedOrStaticAnalysisArtifact", 1, 2)


def test_coupling_and_tiers(spark):
    s = [sym("A", "type"), sym("B", "type"), sym("C", "type"), sym("D", "type"), sym("t", parent="D", props={"attributes": "Obsolete;Fact"})]
    g = make(spark, s, [("A", "B"), edge("A", "B", "references"), ("B", "C"), ("D", "B")])
    assert rows(A.coupling(g, ("type",)), "id", "fan_in", "fan_out", "instability") == [("A", 0, 1, 1.0), ("B", 2, 1, 1 / 3), ("C", 1, 0, 0.0), ("D", 0, 1, 1.0)]
    assert rows(A.tiers(g), "id", "tier") == [("A", "Runtime"), ("B", "Boundary"), ("C", "Pure"), ("D", "Tooling")]


def test_first_rule_only(spark):
    g = make(spark, [("x", "X", "App.Domain.X", "type", None, None, None, "public", False, False, {}, 0), ("y", "Y", "App.Infra.Y", "type", None, None, None, "public", False, False, {}, 0)], [("x", "y")])
    r = spark.createDataFrame([(0, "R1", "*.Domain", "*.Infra", None), (1, "R2", "*", "*.Infra", None), (2, "R3", "*.Domain", None, "System")], "rule_ord int, id string, source string, must_not_reference string, may_only_reference string")
    assert rows(A.violations(g, r), "rule_id", "message") == [("R1", "R1: App.Domain.X must_not_reference *.Infra")]
    assert rows(A.violations(g, r, block=1)) == rows(A.violations(g, r)) and A.violations(g, r.limit(0)).count() == 0
    assert rows(A.violations(g, r.where("rule_ord = 2")), "message") == [("R3: App.Domain.X may_only_reference System",)]


def test_nearest_ancestor_stops_at_its_hops(spark):
    df = spark.createDataFrame([("m", "module", None)] + [(f"n{i}", "type", f"n{i - 1}" if i else "m") for i in range(20)], "id string, kind string, parent_id string")
    got = {r.id: r.found for r in nearest_ancestor(df, "kind = 'module'", 16).collect()}
    assert got["m"] == "m" and got["n14"] == "m" and got["n15"] is None


def test_test_impact(spark):
    s = [sym("X", "type"), sym("x", parent="X"), sym("K", "type"), sym("t1", parent="K", props={"attributes": "Test"}), sym("t2", parent="K", props={"attributes": "Test"}), sym("h", parent="K")]
    g = make(spark, s, [("t1", "x"), ("h", "x"), ("t2", "h")])
    assert rows(A.test_impact(g, g.symbols.where("id = 'X'").select("id"))) == [("X", "K", 1, "Direct", "t1;t2")]
    assert rows(A.test_impact(g, g.symbols.where("id = 't1'").select("id"))) == [("t1", "K", 0, "Transitive", "t1")]


def test_dead_code(spark):
    s = [
        sym("used", vis="private"), sym("dead", vis="private"), sym("pub", vis="public"), sym("tst", path="tests/a.cs"), sym("impl", vis="private"), sym("tag", props={"attributes": "MenuItem"}), sym("Host", "type"), sym("inner", parent="Host", props={"attributes": "Test"}),
        sym("syn", props={"synthesized": "true"}), sym("Scaf", "type", static=True), sym("cond", parent="Scaf", props={"attributes": "Conditional"}), sym("I", "type", vis="public"), sym("K", "type", props={"baseType": "UnityEngine.MonoBehaviour"}), sym("K.Update", parent="K"), sym("gone", path="gen/x.cs"),
    ]
    g = make(spark, s, [("dead", "used"), edge("impl", "I", "implements"), ("pub", "K")])
    got = rows(R.dead_code(g, path_exclude=["gen/*"]), "id", "bucket")
    assert got == [("Scaf", "Scaffolding"), ("cond", "Scaffolding"), ("dead", "Production")]
    assert {r.id: r.reason for r in R.runtime_reachable(g).collect()}["Host"].startswith("Type contains member tagged [Test]")


def test_ports_and_authority(spark):
    face = {"typeKind": "interface"}
    s = [sym("m1", "module"), sym("m2", "module"), sym("I", "type", "m1", props=face), sym("J", "type", "m1", props=face), sym("I.a", parent="I"), sym("I.b", parent="I"), sym("J.c", parent="J"), sym("C", "type", "m1"), sym("C.p", parent="C", vis="public", props={"classification": "PureForwarder"}), sym("u", parent="m2"), sym("v", parent="m1")]
    g = make(spark, s, [edge("J", "I", "inherits"), edge("C", "J", "implements"), ("u", "I.a"), ("u", "C.p"), ("v", "C")])
    assert rows(R.port_health(g), "id", "members", "live_members", "verdict") == [("I", 2, 1, "mixed"), ("J", 3, 1, "mixed")]
    got = {r.id: r for r in R.authority_report(g).collect()}
    assert (got["C"].n_contracts, got["C"].public_surface, got["C"].forwarder_ratio, got["C"].cross_modules, got["C"].same_consumers) == (1, 1, 1.0, 1, 1)
    assert got["J"].single_implementer is True and got["C"].single_implementer is None
    assert rows(R.interface_usage(g).where("id = 'C'"), "direct_members", "inherited_members", "consumers") == [(1, 2, 1)]


def test_authority_coverage(spark):
    s = [sym("S", "type"), sym("s1", parent="S"), sym("E", "type"), sym("Guard", "type"), sym("g1", parent="Guard"), sym("Alt", "type"), sym("Z", "type"), sym("z1", parent="Z"), sym("Y", "type"), sym("y1", parent="Y"), sym("h")]
    g = make(spark, s, [("s1", "h"), ("h", "g1"), ("z1", "Alt")])
    pick = lambda *x: g.symbols.where(F.col("id").isin(*x)).select("id")
    got = {r.id: (r.status, r.path) for r in R.authority_coverage(g, pick("S", "E", "Z", "Y"), pick("Guard"), pick("Alt")).collect()}
    assert got == {"S": ("RequiredReached", "s1 > h > g1"), "E": ("NoSubjectSeeds", None), "Z": ("AllowedAlternativeReached", "z1 > Alt"), "Y": ("MissingRequired", None)}


def test_search_and_resolve(spark):
    s = [sym("type:A.MidiLearnManager", "type"), sym("method:A.MidiLearnManager.Run(int)", parent="type:A.MidiLearnManager"), sym("method:A.MidiLearnManager.Run()", parent="type:A.MidiLearnManager"), sym("field:A.MidiLearnManager.Rate", "field", "type:A.MidiLearnManager")]
    s = [(*x[:1], {"type:A.MidiLearnManager": "MidiLearnManager", "field:A.MidiLearnManager.Rate": "Rate"}.get(x[0], "Run"), *x[2:]) for x in s]
    g = make(spark, s, [])
    assert R.search(g, "learn").first().score == 15
    assert R.near_matches(g, "MidiLearnManger").first().id == "type:A.MidiLearnManager"
    asked = spark.createDataFrame([(x,) for x in ("type:A.MidiLearnManager", "method:A.MidiLearnManager.Run", "method:A.MidiLearnManager.Rate", "rate", "nothing", "method:A.MidiLearnManager.Run(System.Int32)")], "input string")
    got = {r.input: (r.outcome, r.id) for r in R.resolve(g, asked).collect()}
    assert got["type:A.MidiLearnManager"] == ("Exact", "type:A.MidiLearnManager") and got["method:A.MidiLearnManager.Run"] == ("Ambiguous", None)
    assert got["method:A.MidiLearnManager.Rate"] == ("Lenient", "field:A.MidiLearnManager.Rate") == got["rate"] and got["nothing"] == ("NotFound", None)
    assert got["method:A.MidiLearnManager.Run(System.Int32)"] == ("Exact", "method:A.MidiLearnManager.Run(int)")
    assert rows(R.overloads(g), "name", "n") == [("Run", 2)]


def test_empty_graph(spark):
    g = make(spark, [], [])
    for df in (A.coupling(g), A.tiers(g), A.cycles(g), R.dead_code(g), R.port_health(g), A.module_boundary(g), g.edges):
        assert df.count() == 0


def test_rules_meet_names_as_the_grammar_says(spark):
    """Matching by parts of names against the grammar itself, odd patterns and names included."""
    names = ["a", "a.b", "a.b.c", "x.a.b", "A.B", "ab.c", "a..b", ".a", "a.", "x.y.z.a.b.c.d", "*", "b.*", "n.t.m(system.int32,a.b)"]
    patterns = ["*", "*.a", "*.A.B", "a.*", "a", "a.b", "*.b.c", "*.", "*..b", ".*", "*.*", "b.*", "*.int32,a", "", "x.y.*", "*.d", "nothing"]
    named = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "source_id string, s string")
    rules = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "rule_ord int, pattern string")
    widths = sorted({len(p[2:].split(".")) for p in patterns if p.startswith("*.") and p != "*"})
    got = {(r.s, r.pattern) for r in A._matching(named, rules, widths).collect()}
    both = named.crossJoin(rules)
    want = {(r.s, r.pattern) for r in both.where(matches_pattern(F.col("s"), F.col("pattern"))).collect()}
    assert got == want and ("a.b.c", "*.b.c") in got
