"""Test impact is sought for all types and files, and every symbol's name is resolved."""

from pathlib import Path

import pytest

from semgraph.plans import graph_queries as Q
from semgraph.plans.graph_source import graph

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def test_targets_and_names_are_whole(spark, monkeypatch):
    monkeypatch.setattr(Q.A, "test_impact", lambda g, targets: targets)
    symbols = graph(spark, D).symbols.select("id", "kind", "name").collect()
    assert {r.id for r in Q.test_impact(spark, D).collect()} == {r.id for r in symbols if r.kind == "type"}
    assert {r.id for r in Q.test_impact_of_files(spark, D).collect()} == {r.id for r in symbols if r.kind == "file"}
    assert {r.name for r in symbols if r.name is not None} <= {r.input for r in Q.resolve(spark, D).collect()}
