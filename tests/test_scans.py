import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semgraph.functions.ids import clean_id
from semgraph.operators import keyscan
from semgraph.operators.diff import checksum_tree, table_diff
from semgraph.operators.hot_keys import chunk_states, numbered, per_key_counts
from semgraph.operators.orphans import apply_deltas, current_orphans, orphan_references, orphans_by_period
from semgraph.session import new_folder

T0 = dt.datetime(2025, 1, 1)


def test_chunks_and_starts():
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(x, pa.string())}) for x in (["a"] * 5, ["a", "b"], [], ["b", None, None, "c"])]
    assert [t.num_rows for t in keyscan.chunks(iter(batches), 4)] == [4, 4, 3]
    assert keyscan.starts(pa.chunked_array([["a", "a", None], [None, "b"]])).tolist() == [True, False, True, False, True]


def test_per_key_counts(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None, ""]), rnd.choice([None, "", *map(str, range(40))])) for _ in range(4000)] + [("dup", "x")] * 300 + [("none", None)] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "t string, s string, key int")
    got = {(r.key, r.n_rows, r.n_values) for r in per_key_counts(df, "t", "s", chunk_rows=7).collect()}  # chunks far smaller than a key
    want = {(k, sum(t == k for t, _ in rows), len({s for t, s in rows if t == k and s is not None})) for k in {t for t, _ in rows} - {None}}
    assert got == want
    for key in ("hot", "a"):
        distinct = len({s for t, s in rows if t == key})
        states = sorted(chunk_states(df, "t", "s", chunk_rows=7).where(F.col("key") == key).collect(), key=lambda r: r.chunk_no)
        # every chunk but the last is exactly full, whatever the partitions
        assert [(r.chunk_no, r.n_distinct) for r in states] == [(i, min(7, distinct - 7 * i)) for i in range(-(-distinct // 7))]
        at = 0
        for r in states:
            assert r.first_row == at
            at += r.n_rows
        assert at == sum(t == key for t, _ in rows)
    placed = numbered(df, "t", "s", chunk_rows=7).where("key = 'hot'").collect()
    assert sorted(r.row_at for r in placed) == list(range(len(placed))) and all(r.chunk_no == r.row_at // 7 for r in placed)


def test_per_key_counts_of_nothing(spark):
    assert per_key_counts(spark.createDataFrame([], "t string, s string"), "t", "s").count() == 0
    assert per_key_counts(spark.createDataFrame([(None, "x")], "t string, s string"), "t", "s").count() == 0


def _orphans(spark, recs, refs, chunk_rows=65_536):
    a = spark.createDataFrame(recs, "key string, loaded_at timestamp, row_no long, is_deleted boolean")
    b = spark.createDataFrame(refs, "ref int, key string, loaded_at timestamp, row_no long, note string").withColumn("ref", F.col("ref").cast("byte"))
    return sorted((r.ref, r.row_no, r.month, r.ref_state) for r in orphan_references(a, b, chunk_rows).collect())


def _brute_orphans(recs, refs):
    out = []
    for ref, key, t, n, _ in refs:
        if key is None:
            continue
        mine = [r for r in recs if r[0] == key]
        before = [r for r in mine if r[1] <= t]
        state = "missing" if not mine else "late" if not before else "deleted" if max(before, key=lambda r: (r[1], r[2]))[3] else None
        if state:
            out.append((ref, n, t.year * 100 + t.month, state))
    return sorted(out)


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    when = lambda: T0 + dt.timedelta(days=rnd.randrange(60))
    recs = [(f"k{rnd.randrange(12)}", when(), i, rnd.random() < 0.4) for i in range(60)] + [("hot", T0 + dt.timedelta(days=20), 900, False), ("hot", T0 + dt.timedelta(days=40), 901, True)]
    refs = [(rnd.randrange(3), rnd.choice(["hot"] * 8 + [f"k{rnd.randrange(15)}", None]), when(), i, "x") for i in range(900)]
    assert _orphans(spark, recs, refs, 11) == _brute_orphans(recs, refs)


def test_orphans_edges(spark):
    assert _orphans(spark, [], []) == []
    assert _orphans(spark, [("a", T0, 1, False)], []) == []
    refs = [(0, "a", T0, 1, None), (0, "a", T0, 1, None), (1, None, T0, 2, None)]
    assert _orphans(spark, [], refs) == [(0, 1, 202501, "missing")] * 2
    assert _orphans(spark, [("a", T0, 1, None), (None, T0, 2, True)], refs) == []
    assert _orphans(spark, [("a", T0, 1, False), ("a", T0, 2, True)], refs[:1]) == [(0, 1, 202501, "deleted")]


def test_signed_counts(spark):
    schema = "key string, n_existing long, n_edges long"
    rows = [("a", 1, 0), ("b", 1, 0), ("b", -1, 0), ("a", 0, 1), ("b", 0, 2), ("c", 0, 1), ("c", 0, -1), (None, 0, 1)]
    whole = apply_deltas(None, spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in current_orphans(whole).collect()} == {("b", 2)}
    # the same in batches of any order
    counts = None
    for part in (rows[5:], rows[:2], rows[2:5]):
        counts = apply_deltas(counts, spark.createDataFrame(part, schema))
    assert sorted(counts.collect()) == sorted(whole.collect())
    counts = apply_deltas(counts, spark.createDataFrame([("b", 1, 0), ("a", -1, 0)], schema))
    assert {tuple(r) for r in current_orphans(counts).collect()} == {("a", 1)}


def test_counts_kept_by_month_are_those_of_a_full_run(spark):
    rnd = random.Random(4)
    when = lambda: T0 + dt.timedelta(days=rnd.randrange(150))
    recs = [(rnd.choice([f"k{rnd.randrange(9)}", None]), when(), i, rnd.choice([True, False, None])) for i in range(80)]
    refs = [(rnd.choice(["edges", "symbols"]), rnd.choice(["hot"] * 4 + [f"k{rnd.randrange(12)}", None]), when()) for _ in range(300)]
    a = spark.createDataFrame(recs, "key string, loaded_at timestamp, row_no long, is_deleted boolean")
    b = spark.createDataFrame(refs, "ref_table string, key string, loaded_at timestamp")
    months = orphans_by_period(a, b, ["edges", "symbols"])
    assert [m for m, _ in months] == sorted({t.year * 100 + t.month for t in [r[1] for r in recs if r[0]] + [r[2] for r in refs if r[1]]})
    for m, counts in months:
        old = lambda t: t.year * 100 + t.month <= m  # noqa: E731, B023
        newest = {}
        for k, t, n, gone in recs:
            if k and old(t):
                newest[k] = max(newest.get(k, ()), (t, n, not gone))
        want = {k: [int(newest.get(k, (0, 0, False))[2]), 0, 0] for k in {*newest, *(k for _, k, t in refs if k and old(t))}}
        for table, k, t in refs:
            if k and old(t):
                want[k][1 + (table == "symbols")] += 1
        assert {(r.key, r.n_existing, r.n_edges, r.n_symbols) for r in counts.collect()} == {(k, *v) for k, v in want.items()}
    assert orphans_by_period(a.limit(0), b.limit(0), ["edges"]) == []


L = "edge_id long, s string, t string, at int, n int, key string"


def _diff(spark, a, b):
    df = table_diff(spark.createDataFrame(a, L), spark.createDataFrame(b, L), "edge_id", ["s", "t"], ["at", "n"], ["at", "n"], "only_left", "only_right")
    return sorted(tuple(r) for r in df.collect())


def test_diff(spark):
    a = [(i, f"s{i}", f"t{i}", 1, 1, "x") for i in range(500)] + [(7, "new", "t7", 2, 1, "x"), (7, "old", "t7", 0, 9, "x"), (None, "q", "q", 1, 1, "x"), (10**12, "far", None, 1, 1, None)]
    b = [(i, f"s{i}", f"t{i}", 1, 1, "y") for i in range(500) if i != 3] + [(7, "s7", "t7", 5, 1, "y"), (900, "a", "b", 1, 1, "y"), (10**12, "far", "", 1, 1, None), (5, None, "u", 9, 9, None)]
    assert _diff(spark, a, b) == [(3, "only_left"), (5, "s"), (5, "t"), (7, "s"), (900, "only_right"), (10**12, "t")]


def test_diff_of_nothing(spark):
    assert _diff(spark, [], []) == []
    assert _diff(spark, [(4, "a", "b", 1, 1, None)], []) == [(4, "only_left")]
    assert _diff(spark, [(4, "a", None, 1, 1, None)] * 3, [(4, "a", None, 1, 1, None)]) == []


def test_clean_ids(spark):
    cases = [(None, None), ("", None), (" \t ", None), ("a", "a"), (" a\\b\t", "a/b"), ("\ta b ", "a b"), ("A", "A"), ("\n", "\n"), ("\\", "/")]
    df = spark.createDataFrame(cases, "c string, want string")
    assert df.where(~clean_id("c").eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = {k: (rnd.choice("abc"), rnd.choice(["x", None, ""])) for k in rnd.sample(range(-500, 10**6 if seed == 2 else 2000), 1500)}
    sides = []
    for _ in range(2):
        rows = []
        for k, (s, t) in base.items():
            if rnd.random() < 0.01:
                continue
            s = rnd.choice("abc") if rnd.random() < 0.01 else s
            rows += [(k, s, t, 5, 1, "n")] + [(k, "old", "old", rnd.randrange(5), rnd.randrange(9), "n")] * rnd.choice([0, 0, 3])
        sides.append(rows)
    new = [{r[0]: (r[1], r[2]) for r in sorted(rows, key=lambda r: (r[3], r[4]))} for rows in sides]
    want = [(k, "only_left") for k in new[0].keys() - new[1].keys()] + [(k, "only_right") for k in new[1].keys() - new[0].keys()]
    want += [(k, f) for k in new[0].keys() & new[1].keys() for i, f in enumerate("st") if new[0][k][i] != new[1][k][i]]
    assert _diff(spark, *sides) == sorted(want)


def test_diff_at_the_ends_of_the_integers(spark):
    lo, hi = -(2**63), 2**63 - 1
    a = [(k, f"s{k}", "t", 1, 1, None) for k in (lo, lo + 1, -1, 0, 1, hi - 1, hi)]
    b = [(k, f"s{k}", "t" if k != hi else "u", 1, 1, None) for k in (lo, -1, 0, 2, hi - 1, hi)]
    assert _diff(spark, a, b) == [(lo + 1, "only_left"), (1, "only_left"), (2, "only_right"), (hi, "t")]
    assert _diff(spark, a[:1], b[-1:]) == [(lo, "only_left"), (hi, "only_right")]


def test_checksums_of_great_fingerprints_do_not_overflow(spark):
    """Fingerprints whose sum is far beyond 64 bits."""
    rows = spark.range(3000).selectExpr("id key", "9223372036854775807 - id % 2 fp", "-9223372036854775808 + id % 3 fp2")
    other = rows.selectExpr("key", "if(key = 1234, 0, fp) fp", "fp2")
    found = checksum_tree(rows, other, 0, 2999, 4, new_folder(spark, "t")).collect()
    assert [r.rng for r in found] == [1234 >> 4]
