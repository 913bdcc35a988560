import random

import pytest

from semgraph.operators.hierarchy import descendants, hierarchy

SCHEMA = "id string, parent string"


def brute(rows):
    par = {}
    for i, p in rows:
        if i is not None:
            par[i] = max([x for x in (par.get(i), p) if x is not None], default=None)
    par = {i: (p if p in par else None) for i, p in par.items()}
    out, above = {}, {}
    for i in par:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = par[x]
        above[i] = seen
        out[i] = (seen[-1], len(seen) - 1) if x is None else (min(seen[seen.index(x) :]), -1)
    below = {i: 0 for i in par}
    for i, chain in above.items():
        for a in set(chain) - {i}:
            below[a] += 1
    return {(i, r, d, below[i]) for i, (r, d) in out.items()}, above


def run(spark, rows, **kw):
    return hierarchy(spark.createDataFrame(rows, SCHEMA), **kw)


def found(df):
    return {(r.id, r.root_id, r.tree_depth, r.n_below) for r in df.collect()}


def test_small_shapes(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "x"), ("y", "x"), ("m", "n"), ("n", "m"), ("o", "n"), ("p", "gone"), (None, "a"), ("b", "a"), ("b", None)]
    assert found(run(spark, rows)) == brute(rows)[0]


def test_empty_and_extra_columns(spark):
    assert run(spark, []).count() == 0
    df = spark.createDataFrame([("a", None, 1, "z"), ("b", "a", 2, "z")], "id string, parent string, w int, status string")
    assert found(hierarchy(df)) == {("a", "a", 0, 1), ("b", "a", 1, 0)}


@pytest.mark.parametrize("seed,n,reach", [(1, 120, 3), (2, 200, 200), (3, 90, 1)])
def test_random_against_brute_force(spark, seed, n, reach):
    """Bushy trees, shallow ones and one long path, with some cycles and missing parents."""
    rnd = random.Random(seed)
    rows = [(f"n{i:03}", f"n{max(0, i - rnd.randint(1, reach)):03}" if i else None) for i in range(n)]
    for _ in range(n // 30):
        i = rnd.randrange(n)
        rows[i] = (rows[i][0], rnd.choice([f"n{rnd.randrange(n):03}", "gone", None, rows[i][0]]))
    check(rows, run(spark, rows, with_paths=True))


def check(rows, tree):
    want, above = brute(rows)
    assert found(tree) == want
    par = {i: c[1] if len(c) > 1 else None for i, c in above.items()}
    ring = {i for i, c in above.items() if any(par.get(x) == i or (x == i and dict(rows).get(i) == i) for x in c) and next(d for n, _, d, _ in want if n == i) < 0}
    root = {i: r for i, r, _, _ in want}
    pairs = set()
    for r in tree.collect():
        chain = above[r.id]
        stop = next((k for k, x in enumerate(chain) if x in ring), len(chain) - 1)
        assert r.path == chain[: stop + 1][::-1] and r.on_cycle == (r.id in ring)
        pairs |= {(root[a] if a in ring else a, r.id, k) for k, a in enumerate(chain[: stop + 1]) if k or (r.id in ring and r.id != root[r.id])}
    assert {(r.ancestor_id, r.id, r.distance) for r in descendants(tree).collect()} == pairs


def test_cycles_with_trees_below(spark):
    rows = [(x, y) for x, y in zip("abcde", "bcdea")] + [("self", "self"), ("s1", "self"), ("s2", "s1"), ("t1", "c"), ("t2", "t1"), ("t3", "t2"), ("t4", "t2"), ("u", "e"), ("root", None), ("k", "root")]
    tree = run(spark, rows, with_paths=True)
    check(rows, tree)
    got = {(r.ancestor_id, r.id, r.distance) for r in descendants(tree).where("id in ('t3', 'd', 's2', 'k')").collect()}
    assert got == {("a", "t3", 3), ("t1", "t3", 2), ("t2", "t3", 1), ("a", "d", 0), ("self", "s2", 2), ("s1", "s2", 1), ("root", "k", 1)}


def test_rounds_by_all_tasks_and_by_one_are_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(f"n{i:04}", f"n{max(0, i - rnd.randint(1, 4)):04}" if i else None) for i in range(400)] + [(f"c{i}", f"c{(i + 1) % 37}") for i in range(37)]
    want = brute(rows)[0]
    assert found(run(spark, rows)) == want
    monkeypatch.setattr("semgraph.operators.hierarchy.LAST_ROWS", 0)
    assert found(run(spark, rows)) == want


def test_star_with_a_hot_parent(spark):
    rows = [("r", None)] + [(f"k{i}", "r") for i in range(3000)] + [(f"q{i}", "nowhere") for i in range(500)]
    got = found(run(spark, rows))
    assert ("r", "r", 0, 3000) in got and ("k7", "r", 1, 0) in got and ("q7", "q7", 0, 0) in got
