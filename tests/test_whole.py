"""Registered queries do the whole job: against brute force over the built graph of the smallest tables."""

from collections import defaultdict
from pathlib import Path

import pytest

from semgraph.operators import audits
from semgraph.plans import graph_queries as Q
from semgraph.plans.graph_source import graph

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def back_links(spark):
    back = defaultdict(set)
    for r in graph(spark, D).links.select("source_id", "target_id").distinct().collect():
        back[r.target_id].add(r.source_id)
    return back


def walk(back, seeds, depth):
    """Least distance of everything that reaches the seeds."""
    dist, front = dict.fromkeys(seeds, 0), set(seeds)
    for n in range(1, depth + 1):
        front = {s for t in front for s in back.get(t, ())} - dist.keys()
        dist |= dict.fromkeys(front, n)
    return dist


def pipeline_roots(spark, back):
    """Types and modules of three dependants."""
    return [r.id for r in graph(spark, D).symbols.where("kind in ('type', 'module')").collect() if len(back.get(r.id, ())) >= 3]


def test_blast_all_hot_goes_ten_steps(spark):
    back = back_links(spark)
    want = set()
    for root in pipeline_roots(spark, back):
        far = [n for node, n in walk(back, [root], 10).items() if node != root]
        want.add((root, len(far), max(far)))
    assert max(n for *_, n in want) > 3
    assert {tuple(r) for r in Q.blast_all_hot(spark, D).select("root", "n", "deepest").collect()} == want


def test_all_construction_sites_and_tables_come_out(spark):
    sites = spark.range(300).selectExpr("id site_id", "'T' type_id")
    slots = spark.createDataFrame([("T", "a")], "type_id string, slot string")
    none = spark.createDataFrame([], "site_id long, slot string, pos int, is_null boolean, in_branch boolean, after_escape boolean")
    assert audits.assignment_coverage(sites, slots, none).count() == 300
    some = audits.assignment_coverage(sites, slots, none, max_sites=256)
    assert some.count() == 256 and {r.n_sites for r in some.select("n_sites").collect()} == {300}
    cells = spark.range(70 * 40).selectExpr("'T' type_id", "'t' || id % 70 table_id", "cast(id div 70 as int) row_no", "0 col_no", "'int' kind", "'1' text")
    assert audits.static_tables(cells).count() == 70 * 40 and audits.static_tables(cells, 64, 32).count() == 64 * 32
