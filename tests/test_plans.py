"""Plans that must stay as they are at any size: pruned scans, no cross products, no group in Python."""

import re
from pathlib import Path

import pytest

from semgraph.plans import graph_queries, problems

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,columns", [("p4_found", {"graph_id", "payload"})])
def test_scans_read_only_what_they_need(spark, name, columns):
    text = plan(problems.QUERIES[name](spark, D))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",")}
    assert read and read <= columns


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "coupling", "dependants", "edges_by_module", "file_impact", "dead_code", "authority_report", "port_health", "module_boundary"])
def test_no_cross_product(spark, name):
    text = plan({**problems.QUERIES, **graph_queries.QUERIES}[name](spark, D))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "FlatMapGroups" not in text and "BatchEvalPython" not in text


def test_hot_keys_are_counted_and_dealt(spark):
    """The input is read once, by the job that writes the distinct rows; no range is sampled and no Python runs."""
    text = plan(problems.p5_found(spark, D))
    assert "edges.parquet" not in text and "rangepartitioning" not in text and "MapInArrow" not in text
