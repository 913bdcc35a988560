import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semgraph.llm.mixing import mix_plan, mix_report, mix_sources, water_fill

DOCS = "doc_id long, source string, n_tokens long, range int, whole int"
TARGETS = "mix_name string, source string, target_share double, max_repeats int, draw int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.just(0.0) | st.floats(0.01, 10), st.just(0.0) | st.floats(0.01, 1000)), max_size=6), st.floats(0, 5000))
def test_water_fill(rows, total):
    weights, caps = {s: w for s, (w, _) in rows.items()}, {s: c for s, (_, c) in rows.items()}
    got = water_fill(weights, caps, total)
    live = [s for s in rows if weights[s] > 0 and caps[s] > 0]
    assert set(got) == set(rows) and all(got[s] <= caps[s] * (1 + 1e-9) for s in rows)
    assert sum(got.values()) == pytest.approx(min(total, sum(caps[s] for s in live)))
    free = [s for s in live if got[s] < caps[s] * (1 - 1e-9)]
    for s in free:  # what is not clamped keeps its proportion, and what is clamped would have had at least as much
        assert got[s] / weights[s] == pytest.approx(max(got[f] / weights[f] for f in free), rel=1e-6)
        assert all(got[s] / weights[s] >= got[c] / weights[c] * (1 - 1e-9) for c in live)


def test_plan_of_odd_targets():
    t = [{"mix_name": m, "source": s, "target_share": w, "max_repeats": r} for m, s, w, r in (("m", "a", 1.0, None), ("m", "a", 1.0, 2), ("m", "b", None, 3), ("m", "c", float("nan"), 3), ("m", "d", -1.0, 3), ("m", "gone", 5.0, 3), (None, "a", 1.0, 1), ("m", None, 1.0, 1), ("n", "a", 1.0, 0))]
    plan = {(r["mix_name"], r["source"]): r for r in mix_plan(t, {"a": 10, "b": 10, "c": 10, "d": 10})}
    assert plan["m", "a"]["epochs"] == 1.0 and plan["m", "a"]["max_repeats"] == 2 and plan["m", "gone"]["epochs"] == 0
    assert plan["m", "b"]["whole"] == plan["m", "c"]["whole"] == plan["m", "d"]["whole"] == plan["n", "a"]["whole"] == 0


def test_mix(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["big"] * 8 + ["mid", "mid", "small"]), rnd.choice([None, 0, *range(1, 60)]), 0, 0) for i in range(3000)] + [(1, "mid", 10, 0, 0)] * 5 + [(9, None, 10, 0, 0)]
    targets = [("x", "big", 0.5, 1, 0), ("x", "mid", 0.3, 4, 0), ("x", "small", 0.2, 2, 0), ("y", "small", 1.0, 3, 0), ("y", "none", 9.0, 3, 0)]
    df, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    mixed, plan = mix_sources(df, t, seed=7)
    rows = mixed.collect()
    size = Counter()
    for _, s, n, *_ in docs:
        size[s] += n or 0
    caps = {(m, s): r for m, s, _, r, _ in targets}
    got = Counter()
    for r in rows:
        assert 1 <= r.repeats <= caps[r.mix_name, r.source]
        got[r.mix_name, r.source] += r.repeats * r.n_tokens
    for p in plan.collect():
        assert 0 <= p.planned_tokens - got[p.mix_name, p.source] < 61  # within one document
    assert got["x", "small"] == 2 * size["small"]  # clamped at its epochs
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(df, t, seed=7)[0].collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, mix_sources(df, t, seed=8)[0].collect()))
    report = {(r.mix_name, r.source): r for r in mix_report(mixed, plan).collect()}
    assert sum(r.actual_share for k, r in report.items() if k[0] == "x") == pytest.approx(1, abs=1e-5)
    assert report["y", "none"].actual_share == 0 and report["y", "small"].actual_share == 1


def test_nothing_to_mix(spark):
    docs, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("x", "a", 1.0, 2, 0)], TARGETS)
    mixed, plan = mix_sources(docs, t)
    assert mixed.count() == 0 and mix_report(mixed, plan).first().actual_share == 0
    assert mix_sources(spark.createDataFrame([(1, "a", 3, 0, 0)], DOCS), t.limit(0))[0].count() == 0


def test_exact_total():
    t = [{"mix_name": "m", "source": s, "target_share": w, "max_repeats": r} for s, w, r in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 9))]
    plan = {r["source"]: r for r in mix_plan(t, {"a": 1000, "b": 1000, "c": 10}, "exact")}
    assert plan["c"]["epochs"] == pytest.approx(4) and plan["a"]["planned_tokens"] == pytest.approx(200) and plan["b"]["planned_tokens"] == pytest.approx(120)
    assert mix_plan(t, {}, "exact")[0]["planned_tokens"] == 0
