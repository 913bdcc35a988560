"""Figures over numbered steps: those of the built graph, without building it."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph import EDGE, SYM, edge, make, rows, sym
from test_walk import raw_tangle

from semgraph.operators import analysis as A
from semgraph.operators import numbers as N
from semgraph.operators import walk as W
from semgraph.operators.build import edge_kind, edge_role
from semgraph.operators.scc import components
from semgraph.plans import graph_queries as Q

D = "/root/testdata/sf0.001"
RULES = [(f"R{i:02}", *x) for i, x in enumerate([("X", "M0", None), ("*", "t.*", None), ("x01", None, "x0*"), ("*.x", None, "T1"), *[(f"x{i:02}", f"T{i % 8}", None) for i in range(70)]])]


def pipeline_rows(seed):
    """The tangle with tests, method groups told under a role of their own, and equal identities that differ in that."""
    r = random.Random(seed)
    s, e = raw_tangle(None, seed)
    s = [(*x[:2], r.choice([None, "", x[0]]), *x[3:10], {**x[10], "attributes": r.choice(["Test", "A;Fact", "B", "Tests"])}, x[11]) if x[0][0] == "x" else x for x in s]
    for n in range(60):
        ends = f"x{r.randrange(30):02}", r.choice([f"x{r.randrange(30):02}", f"T{r.randrange(8)}"])
        e += [edge(*ends, r.choice(["references", "calls"]), {"native.kind": "a", "initializerOwner": g}, n=400 + n) for g in r.sample(["methodGroup", "no"], 2)]
    return s, [(*x[:-1], n) for n, x in enumerate(e)]


def numbers_of(spark, s, e):
    symbols, edges = spark.createDataFrame(s, SYM), spark.createDataFrame(e, EDGE)
    marks = N.rule_marks(F.coalesce(F.nullif("qualified_name", F.lit("")), "id"), RULES)
    tagged = F.arrays_overlap(F.split(F.coalesce(F.col("properties")["attributes"], F.lit("")), ";"), F.array(F.lit("Test"), F.lit("Fact")))
    symbols = symbols.select("id", "kind", "file_path", "parent_id", ((F.col("kind") == "method") & tagged).alias("test"), F.when((F.col("kind") == "method") & tagged, F.coalesce("qualified_name", "name")).alias("text"), *marks)
    group = F.coalesce((F.col("properties")["initializerOwner"] == "methodGroup") & (F.col("kind") == "references"), F.lit(False))
    edges = edges.select("source_id", "target_id", edge_kind(F.col("kind")).alias("kind"), edge_role(F.col("properties")).alias("role"), group.alias("skip"), "ord")
    return N.numbered(symbols, edges, len(marks) // 2)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_metrics_are_those_of_the_graph(spark, seed):
    """F1 of round 3, pipeline_metrics: more rules than a mark has bits, references between files, containment told and made, ends that are missing."""
    s, e = pipeline_rows(seed)
    g = make(spark, s, e)
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_ord int, id string, source string, must_not_reference string, may_only_reference string")
    broken, tier = A.violations(g, rules).count(), [r.tier for r in A.tiers(g).collect()]
    far = A.blast_groups(g, A.coupling(g, ("type", "module")).where("fan_in >= 3").select("id"), preview=0).collect()
    kinds = [x.kind for x in g.symbols.collect()]
    want = [len(kinds), *[kinds.count(k) for k in ("file", "type", "module", "method")], g.edges.count(), broken, A.cycles(g).select("component").distinct().count()]
    want += [A.coupling(g).where("fan_in + fan_out > 0").count(), tier.count("Tooling"), tier.count("Boundary"), len(far), sum(r.n for r in far)]
    assert broken and far and "Tooling" in tier and g.edges.where("evidence.adapter_name = 'GraphBuilder' and kind = 'references'").count()
    assert rows(N.metrics(numbers_of(spark, s, e))) == [tuple(want)]


@pytest.mark.parametrize("seed", range(6))
def test_strong(spark, seed):
    r = random.Random(seed)
    n = 30 + 10 * seed
    e = [(r.randrange(n), r.randrange(n)) for _ in range(n + 8)] + [(n + i, n + i + 1) for i in range(40)]
    a, b = (np.array(x, dtype=np.int32) for x in zip(*e))
    want = components(spark.createDataFrame([(str(x), str(y)) for x, y in e], "src string, dst string")).select("component").distinct().count()
    assert N.strong(a, b) == want
    assert N.strong(a[:0], b[:0]) == N.strong(a[-40:], b[-40:]) == 0


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables")
def test_pipeline_metrics_builds_no_graph(spark, monkeypatch):
    """F1 of round 3; a graph of too many steps for a task is built, with the same figures."""
    monkeypatch.setattr(Q.N, "HELD", 0)
    want = rows(Q.pipeline_metrics(spark, D))
    monkeypatch.undo()
    monkeypatch.setattr(Q, "graph", None)
    assert rows(Q.pipeline_metrics(spark, D)) == want


def test_pipeline_impact_of_files(spark, monkeypatch):
    """F2 of round 3, test_impact_of_files: all files of a task are walked at once, over numbered steps."""
    s, e = pipeline_rows(4)
    s = [(*x[:4], "f3" if i % 2 else x[4], *x[5:]) for i, x in enumerate(s)]
    g, numbers = make(spark, s, e), numbers_of(spark, s, e)
    monkeypatch.setattr(A, "walk", lambda *a: None)
    want = rows(A.test_impact(g, g.symbols.where("kind = 'file'").select("id")))
    assert len({x[0] for x in want}) > 3 and {x[3] for x in want} == {"Direct", "OneHop", "Transitive"}
    monkeypatch.setattr(A, "reach_by_level", None)
    assert rows(A.test_impact(numbers, numbers.symbols.where("kind = 'file'").select("id"))) == want


@pytest.mark.skipif(not Path(D).exists(), reason="no test tables")
def test_impact_of_files_builds_no_graph(spark, monkeypatch):
    """F2 of round 3; a graph of too many steps for a task is built, with the same rows."""
    monkeypatch.setattr(Q.N, "HELD", 0)
    want = rows(Q.test_impact_of_files(spark, D))
    monkeypatch.undo()
    monkeypatch.setattr(Q, "graph", None)
    assert want and rows(Q.test_impact_of_files(spark, D)) == want


@pytest.mark.parametrize("part", [1, 7, 10**6])
@pytest.mark.parametrize("depth", [0, 1, 3, 200])
def test_spread_is_a_walk_from_each(monkeypatch, part, depth):
    r = np.random.default_rng(depth)
    n, m = 90, 130
    h = W.Held.__new__(W.Held)
    a, h.n = r.integers(0, n, m), n
    h.end = r.integers(0, n, m).astype(np.int32)[np.argsort(a, kind="stable")]
    h.at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    h.dist, h.mark = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
    monkeypatch.setattr(W, "PART", part)
    firsts = [r.choice(n, size=int(r.integers(1, 4)), replace=False).astype(np.int32) for _ in range(70)]
    wanted = r.permutation(n)[:40]
    got = h.spread(firsts, depth, wanted)
    for i, first in enumerate(firsts):
        want = dict(zip(*(x.tolist() for x in h.walk(first, depth))))
        assert got[i].tolist() == [want.get(x, -1) for x in wanted.tolist()]
