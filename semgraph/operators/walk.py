"""Walks from many roots over a graph whose steps every task holds, so that no pair is shuffled or written on the way.

The roots are dealt to tasks. Steps are numbered and written to the shared
work folder; a Python worker reads them once and keeps 4 bytes a step. Nodes are
numbered in the order of their ids, so numbers order as ids do. What is made of
the nodes that a root reaches (``finish``) is made in the task that found them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.session import materialize, new_folder, shuffle_partitions

#: steps that a task may hold; a graph of more is walked level by level
HELD = 20_000_000
#: rows after which a task hands on what it found
BATCH = 50_000
#: words of 64 walks that are gathered at once, and that a table of nodes or results may have
PART, WORDS = 1_000_000, 4_000_000
_held: dict[str, object] = {}


def _table(path: str, columns: list[str]) -> pa.Table:
    where, inner = fs.FileSystem.from_uri(path)
    files = [f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=where, use_threads=False) for f in files])


class Held:
    """The steps below ``base`` as offsets and ends, and what else its tasks look up by the number of a node."""

    def __init__(self, base: str, n: int):
        self.base, self.n, self._columns = base, n, {}
        steps = _table(f"{base}/numbered", ["a", "b"])
        a, b = (steps[c].to_numpy() for c in ("a", "b"))
        self.end = np.ascontiguousarray(b[np.argsort(a, kind="stable")])
        self.at = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(np.bincount(a, minlength=n), out=self.at[1:])
        self.dist = np.full(n, -1, dtype=np.int32)
        self.mark = np.zeros(n, dtype=np.int32)

    def walk(self, first: np.ndarray, max_depth: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and least distances of what ``first`` reaches, itself at 0, in the order of distance and number."""
        dist, mark, front, levels, depth = self.dist, self.mark, np.unique(first), [], 0
        dist[front] = 0
        while len(front):
            levels.append(front)
            if max_depth is not None and depth >= max_depth:
                break
            depth += 1
            lo = self.at[front]
            n = self.at[front + 1] - lo
            total = int(n.sum())
            if not total:
                break
            # the places of all steps out of the front, run by run
            near = self.end[np.arange(total) + np.repeat(lo - np.cumsum(n) + n, n)]
            near = near[dist[near] < 0]
            turn = np.arange(len(near), dtype=np.int32)
            mark[near] = turn
            front = np.sort(near[mark[near] == turn])
            dist[front] = depth
        got = np.concatenate(levels) if levels else np.zeros(0, np.int32)
        found = np.repeat(np.arange(len(levels), dtype=np.int32), [len(x) for x in levels])
        dist[got] = -1
        return got, found

    def count(self, first: int, max_depth: int) -> int:
        """How many other nodes ``first`` reaches."""
        return len(self.walk(np.array([first]), max_depth)[0]) - 1

    def spread(self, firsts: list[np.ndarray], max_depth: int, wanted: np.ndarray) -> np.ndarray:
        """A row for each of ``firsts`` with the least distances of the nodes ``wanted`` from it, -1 where one is not reached.

        All are walked at once, a bit each, over the steps that any of them takes.
        """
        got = np.sort(self.walk(np.concatenate(firsts), max_depth)[0])
        self.dist[got] = 0
        self.mark[got] = np.arange(len(got), dtype=np.int32)
        lo = self.at[got]
        n = self.at[got + 1] - lo
        b = self.end[np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)]
        a = np.repeat(np.arange(len(got), dtype=np.int32), n)
        # the last nodes lead on to some that are not reached
        keep = self.dist[b] >= 0
        a, b = a[keep], self.mark[b[keep]]
        met = self.dist[wanted] >= 0
        near = self.mark[wanted[met]]
        front = np.zeros((len(got), -(-len(firsts) // 64)), dtype=np.uint64)
        for i, first in enumerate(firsts):
            front[self.mark[first], i // 64] |= np.uint64(1 << (i % 64))
        self.dist[got] = -1
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(b) != 0])) if len(b) else np.zeros(0, np.int64)
        ends, turn = np.append(heads[1:], len(b)), max(1, PART // front.shape[1])
        cuts = [0]
        while cuts[-1] < len(heads):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, heads[cuts[-1]] + turn, "right"))))
        seen, depth = front.copy(), 0
        dist = np.full((len(near), len(firsts)), -1, dtype=np.int8 if max_depth < 128 else np.int32)
        while True:
            bits = np.unpackbits(np.ascontiguousarray(front[near]).view(np.uint8), axis=1, count=len(firsts), bitorder="little")
            np.putmask(dist, bits, depth)
            if depth >= max_depth:
                break
            depth += 1
            after = np.zeros_like(front)
            for i, j in zip(cuts, cuts[1:]):
                low, high = heads[i], ends[j - 1]
                after[b[heads[i:j]]] = np.bitwise_or.reduceat(front[a[low:high]], heads[i:j] - low, axis=0)
            after &= ~seen
            if not after.any():
                break
            seen |= after
            front = after
        out = np.full((len(firsts), len(wanted)), -1, dtype=dist.dtype)
        out[:, met] = dist.T
        return out

    def column(self, name: str) -> pa.Array:
        """A column of the notes by the number of the node: null where there is none."""
        if name not in self._columns:
            t = _table(f"{self.base}/notes", ["no", name])
            at = np.full(self.n, -1, dtype=np.int64)
            at[t["no"].to_numpy()] = np.arange(t.num_rows)
            self._columns[name] = t[name].combine_chunks().take(pa.array(at, mask=at < 0))
        return self._columns[name]

    def codes(self, name: str) -> tuple[np.ndarray, pa.Array]:
        """A column of the notes as numbers in the order of its values, -1 for null, and the values."""
        if (name, 0) not in self._columns:
            coded = self.column(name).dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order) + 1, dtype=np.int32)
            rank[order], rank[-1] = np.arange(len(order)), -1
            self._columns[name, 0] = rank[coded.indices.fill_null(len(order)).to_numpy()], coded.dictionary.take(pa.array(order))
        return self._columns[name, 0]


def _hold(base: str, n: int) -> Held:
    """The graph of the latest walk; a worker holds no other."""
    if base not in _held:
        _held.clear()
        _held[base] = Held(base, n)
    return _held[base]


Finish = Callable[[Held, pa.Array, list[np.ndarray], list[np.ndarray]], Iterator[pa.RecordBatch]]


def contiguous(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``rows`` written with a number ``no`` from 0, in the order of their parts, and how many."""
    seen = Observation()
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    # a row per part that was written
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    low, total = [], 0
    for r in sizes:
        low += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    start = F.create_map(*low)[part] if low else F.lit(0)
    return rows.withColumn("no", (start + place).cast("int")).drop("_at"), total


def _numbers(ids: DataFrame, base: str) -> tuple[DataFrame, int]:
    """``id, no`` from 0 in the order of ids, and how many."""
    return contiguous(ids.where("id is not null").distinct().orderBy("id"), f"{base}/ids")


def walk(steps: DataFrame, seeds: DataFrame, max_depth: int | None, finish: Finish, schema: str, notes: DataFrame | None = None, held: int | None = None) -> DataFrame | None:
    """What ``finish`` makes of the nodes that each root reaches; nothing if there are more than ``held`` steps.

    ``steps(src, dst)``, ``seeds(root, node)``, ``notes(node, ...)`` of one row
    a node (none: the ids as ``name``). ``finish`` gets the roots and for each
    the numbers and distances of its nodes, as ``Held.walk`` has them, and looks
    notes up by number.
    """
    spark = steps.sparkSession
    base = new_folder(spark, "walk")
    seen = Observation()
    steps = steps.where("src is not null and dst is not null").select("src", "dst").distinct()
    steps = materialize(steps.observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/steps")
    if seen.get["n"] > (HELD if held is None else held):
        return None
    seeds = seeds.select("root", "node").where("node is not null")
    ids = steps.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds.select(F.col("node").alias("id")))
    ids, n = _numbers(ids, base)
    numbered = steps.join(ids.select(F.col("id").alias("src"), F.col("no").alias("a")), "src").select("dst", "a").join(ids.select(F.col("id").alias("dst"), F.col("no").alias("b")), "dst")
    materialize(numbered.select("a", "b"), f"{base}/numbered")
    said = ids.select("no", F.col("id").alias("name"))
    if notes is not None:
        said = notes.withColumnRenamed("node", "id").join(ids, "id")
    materialize(said, f"{base}/notes")
    firsts = seeds.join(ids.withColumnRenamed("id", "node"), "node").groupBy("root").agg(F.collect_set("no").alias("nodes"))
    tasks = max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for b in batches:
            graph = graph or _hold(base, n)
            roots, got, found, size = [], [], [], 0
            for i in range(b.num_rows):
                nodes, dist = graph.walk(b.column(1)[i].values.to_numpy(zero_copy_only=False), max_depth)
                roots.append(i)
                got.append(nodes)
                found.append(dist)
                size += len(nodes)
                if size >= BATCH or i + 1 == b.num_rows:
                    yield from finish(graph, b.column(0).take(pa.array(roots, pa.int32())), got, found)
                    roots, got, found, size = [], [], [], 0

    return firsts.repartition(tasks, "root").mapInArrow(run, schema)


def _flat(got: list[np.ndarray], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in got]), np.concatenate(got), np.concatenate(found)


def _lists(values: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    """Runs of ``values`` of these sizes, each joined to one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values), by)


def pairs(held: Held, roots: pa.Array, got: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``root, node, dist``, by the note ``name``."""
    owner, nodes, dist = _flat(got, found)
    names = held.column("name")
    for i in range(0, len(nodes), BATCH):
        part = slice(i, i + BATCH)
        yield pa.RecordBatch.from_arrays([roots.take(pa.array(owner[part])), names.take(pa.array(nodes[part])), pa.array(dist[part])], names=["root", "node", "dist"])


def groups(label: str | None, preview: int) -> Finish:
    """``root, label, n, n_direct, deepest, preview`` of what is not the root, by the note ``label`` or as a whole; the first ``preview`` by distance and id."""

    def finish(held: Held, roots: pa.Array, got: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        owner, nodes, dist = _flat(got, found)
        code, values = held.codes(label) if label else (np.zeros(held.n, dtype=np.int32), pa.array([""]))
        keep = (dist > 0) & (code[nodes] >= 0)
        owner, nodes, dist = owner[keep], nodes[keep], dist[keep]
        if not len(nodes):
            return
        of = code[nodes]
        if label:
            # stable, so that nodes stay in the order of distance and id; short numbers are sorted by digits
            short = np.uint16 if max(len(values), len(roots)) < 2**16 else np.int32
            order = np.argsort(of.astype(short), kind="stable")
            order = order[np.argsort(owner[order].astype(short), kind="stable")]
            owner, nodes, dist, of = owner[order], nodes[order], dist[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(of) != 0)]))
        n = np.diff(np.concatenate([at, [len(nodes)]]))
        direct, deepest = np.add.reduceat((dist == 1).astype(np.int64), at), np.maximum.reduceat(dist, at)
        shown = np.minimum(n, preview)
        heads = np.arange(int(shown.sum())) + np.repeat(at - np.cumsum(shown) + shown, shown)
        first = _lists(held.column("name").take(pa.array(nodes[heads])), shown, "|") if preview else pa.nulls(len(n), pa.string())
        yield pa.RecordBatch.from_arrays([roots.take(pa.array(owner[at])), values.take(pa.array(of[at])), pa.array(n), pa.array(direct), pa.array(deepest), first], names=["root", "label", "n", "n_direct", "deepest", "preview"])

    return finish


def texts(held: Held, roots: pa.Array, got: list[np.ndarray], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``root, label, dist, texts``: of the nodes with a note ``label`` the least distance and all distinct ``text`` in order."""
    owner, nodes, dist = _flat(got, found)
    (code, values), (rank, words) = held.codes("label"), held.codes("text")
    keep = code[nodes] >= 0
    owner, nodes, dist = owner[keep], nodes[keep], dist[keep]
    if not len(nodes):
        return
    of, word = code[nodes], rank[nodes]
    order = np.lexsort((word, of, owner))
    yield from _spoken(roots, owner[order], dist[order], of[order], word[order], values, words)


def _spoken(roots: pa.Array, owner: np.ndarray, dist: np.ndarray, of: np.ndarray, word: np.ndarray, values: pa.Array, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of ``texts``, of nodes in the order of owner, label and text."""
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(of) != 0)])
    at = np.flatnonzero(new)
    told = (new | np.concatenate([[True], np.diff(word) != 0])) & (word >= 0)
    least, size = np.minimum.reduceat(dist, at), np.add.reduceat(told.astype(np.int64), at)
    word, end = word[told], np.cumsum(size)
    for i in range(0, len(at), BATCH):
        part = slice(i, i + BATCH)
        spoken = word[end[i] - size[i] : end[part][-1]]
        yield pa.RecordBatch.from_arrays([roots.take(pa.array(owner[at[part]])), values.take(pa.array(of[at[part]])), pa.array(least[part]), _lists(words.take(pa.array(spoken)), size[part], ";")], names=["root", "label", "dist", "texts"])


def texts_of_all(held: Held, roots: pa.Array, firsts: list[np.ndarray], max_depth: int) -> Iterator[pa.RecordBatch]:
    """``texts`` of many roots, that are walked at once."""
    (code, values), (rank, words) = held.codes("label"), held.codes("text")
    noted = np.flatnonzero(code >= 0)
    # in the order of label and text, so that what a root reaches needs no sorting
    noted = noted[np.lexsort((rank[noted], code[noted]))]
    of, word = code[noted], rank[noted]
    if not len(noted):
        return
    # 64 roots or as many as memory has room for
    many = 64 * max(1, min(8, WORDS // max(1, held.n), WORDS * 8 // (64 * len(noted))))
    for i in range(0, len(firsts), many):
        dist = held.spread(firsts[i : i + many], max_depth, noted)
        some = max(1, BATCH * 4 // len(noted))
        for j in range(0, len(dist), some):
            owner, at = np.nonzero(dist[j : j + some] >= 0)
            if len(at):
                yield from _spoken(roots.slice(i + j, some), owner, dist[j : j + some][owner, at].astype(np.int32), of[at], word[at], values, words)
