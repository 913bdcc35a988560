import bisect
import random
from collections import Counter

import pytest

from semgraph.llm.packing import fill_check, fill_containers, fill_report, pack

ITEMS = "item long, doc_id long, n_tokens long, digest long, shard int, n int"


def brute_pack(sizes, capacity, linear, quadratic):
    """The same rule by looking at every container."""
    cost, left, out = [], [], []
    for n in sizes:
        fits = [(cost[i], i) for i in range(len(cost)) if left[i] >= n]
        if not fits:
            cost.append(0.0)
            left.append(capacity)
            fits = [(0.0, len(cost) - 1)]
        i = min(fits)[1]
        cost[i] += linear * n + quadratic * n * n
        left[i] -= n
        out.append(i)
    return out


@pytest.mark.parametrize("seed,cap", [(1, 50), (2, 64), (3, 7), (4, 1), (5, 1000)])
def test_pack_against_brute_force(seed, cap):
    rnd = random.Random(seed)
    sizes = sorted((rnd.randint(1, cap) for _ in range(300)), reverse=True)
    assert pack(sizes, cap, 1.0, 0.01) == brute_pack(sizes, cap, 1.0, 0.01)
    assert pack([], 8) == [] and pack([8, 8], 8) == [0, 1]


def best_fit(sizes, capacity):
    """Containers of the best-fit decreasing rule."""
    rooms = []
    for n in sizes:
        i = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize("mean", [0.1, 0.25, 0.35, 0.45, 0.6])
def test_few_containers_for_dense_sizes(mean):
    rnd = random.Random(int(mean * 100))
    sizes = sorted((max(1, min(4096, int(rnd.gauss(mean, 0.12) * 4096))) for _ in range(4000)), reverse=True)
    room = Counter()
    for n, i in zip(sizes, pack(sizes, 4096)):
        room[i] += n
    assert max(room.values()) <= 4096 and len(room) <= 1.002 * best_fit(sizes, 4096) + 1


def test_a_great_capacity_takes_no_memory():
    assert pack([10**12, 5, 5], 10**13) == [0, 0, 0]


def check(rows, items, packs):
    for name, cap in packs:
        mine = [r for r in rows if r.pack_name == name]
        room = Counter()
        for r in mine:
            room[r.container_id] += r.n_tokens
        assert max(room.values(), default=0) <= cap
        for c in room:  # pieces lie one after another
            at = 0
            for r in sorted((r for r in mine if r.container_id == c), key=lambda r: r.start_at):
                assert r.start_at == at
                at += r.n_tokens
        want = Counter()
        for _, doc, n, *_ in items:
            want[doc] += n or 0
        got = Counter()
        for r in mine:
            got[r.doc_id] += r.n_tokens
        assert got == +want
        split = Counter(r.doc_id for r in mine)
        assert all(split[doc] == -(-n // cap) for _, doc, n, *_ in items if n and Counter(x[1] for x in items)[doc] == 1)


def test_fill(spark):
    rnd = random.Random(1)
    items = [(i, i // 2 if i < 20 else i, rnd.choice([None, 0, 1, 5, 30, 64, 65, 128, 700]), i * 7, 9, 9) for i in range(400)]
    packs = [("small", 64), ("large", 512)]
    df = fill_containers(spark.createDataFrame(items, ITEMS), [*packs, ("none", None), (None, 3), ("zero", 0)])
    rows = df.collect()
    check(rows, items, packs)
    for r in fill_check(spark.createDataFrame(items, ITEMS), df, packs).collect():
        assert (r.n_over, r.n_not_whole, r.wasteful) == (0, 0, 0)
    # the same packing from the same items told in another order and numbered anew
    again = fill_containers(spark.createDataFrame([(1000 - i, *x[1:]) for i, x in enumerate(reversed(items))], ITEMS).repartition(3), packs)
    inside = lambda rs: Counter((r.pack_name, r.doc_id, r.n_tokens, r.container_id) for r in rs if not r.container_id.startswith("full"))
    assert inside(again.collect()) == inside(rows)
    report = {r.pack_name: r for r in fill_report(df, packs).collect()}
    assert all(0 <= r.cost_deviation < 0.5 and r.greatest_cost >= r.mean_cost for r in report.values())
    assert all(r.unused_share < 0.05 for r in report.values()) and set(report) == {"small", "large"}


def test_null_and_large_ids_and_repeated_packs(spark):
    big = 2**62 + 1
    rows = fill_containers(spark.createDataFrame([(1, None, 3, 0, 0, 0), (2, big, 4, 0, 0, 0), (3, None, 20, 0, 0, 0)], ITEMS), [("a", 9), ("a", 8)]).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 3), (0, 4), (0, 8), (0, 8), (big, 4)]


def test_nothing_to_fill(spark):
    df = spark.createDataFrame([], ITEMS)
    assert fill_containers(df, [("a", 4)]).count() == 0
    assert fill_containers(spark.createDataFrame([(1, 1, 3, 0, 0, 0)], ITEMS), []).count() == 0
