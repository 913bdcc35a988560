"""Reports tell what the analysis found, not constants."""

from pathlib import Path

import pytest

from semgraph.plans import graph_queries as Q
from semgraph.plans import report_queries as P

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


def test_inferred_invariants_count_cycles_and_violations(spark):
    n_cycles = len({r.component for r in Q.cycles(spark, D).collect()})
    n_violations = len(Q.violations(spark, D).collect())
    assert n_violations
    told = {r.statement for r in P.inferred_invariants(spark, D).collect() if "is pure" not in r.statement}
    assert told == {f"{n_violations} architecture violations found"} | ({f"{n_cycles} circular dependency cycles detected"} if n_cycles else set())
