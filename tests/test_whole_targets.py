"""Reads of one symbol run for all symbols, blast radii for all roots of the analysis."""

from pathlib import Path

import pytest
from test_whole import back_links, pipeline_roots, walk

from semgraph.plans import graph_queries as Q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def test_single_hop_reads_cover_all_targets(spark):
    back = back_links(spark)
    want = {(t, s) for t, many in back.items() for s in many}
    assert {tuple(r) for r in Q.dependants(spark, D).select("root", "node").collect()} == want
    assert {tuple(r) for r in Q.blast_breaks(spark, D).select("root", "node").collect()} == want
    for q in (Q.edges_by_bucket, Q.edges_by_module):
        assert sum(r.n for r in q(spark, D).collect()) == len(want)


def test_blast_radii_cover_all_roots(spark):
    back = back_links(spark)
    want = {(root, node, n) for root in pipeline_roots(spark, back) for node, n in walk(back, [root], 10).items() if node != root}
    assert {tuple(r) for r in Q.blast_radius(spark, D).select("root", "node", "dist").collect()} == want
    for q in (Q.blast_by_bucket, Q.blast_by_module):
        assert sum(r.n for r in q(spark, D).collect()) == len(want)
