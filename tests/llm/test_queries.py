from pathlib import Path

import pytest

from semgraph.llm import queries as Q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, D).count() > 0


def test_packs_hold_every_token(spark):
    packed = Q.p6_pack(spark, D).groupBy("pack_name").sum("n_tokens").collect()
    assert len({r[1] for r in packed}) == 1 and len(packed) == 3
    # what is reached; a last container per pack is not full
    assert all(r.unused_tokens < 2 * dict(Q._packs(spark, D))[r.pack_name] for r in Q.p6_report(spark, D).collect())
    assert all(r.unused_share < 0.008 for r in Q.p6_report(spark, "/root/testdata/sf0.01").collect())


def test_checks_hold(spark):
    assert all((r.n_over, r.n_split_in_vain, r.n_not_whole, r.wasteful) == (0, 0, 0, 0) for r in Q.p6_check(spark, D).collect())
    assert all((r.too_often, r.too_many, r.lacking, r.as_planned) == (False, False, False, True) for r in Q.p7_check(spark, D).collect())


def test_spellings_are_found(spark):
    """Words of scripts with enough text to learn from; a script of a handful of words cannot be learnt."""
    rows = Q.p8_recovery(spark, "/root/testdata/sf0.01").collect()
    assert {r.script for r in rows} >= {"Latin", "Cyrillic", "Greek"}
    assert all(r.share >= 0.9 for r in rows if r.script in ("Latin", "Cyrillic", "Greek"))
