"""Filling containers of fixed capacity with whole texts: cost-balanced packing."""

from __future__ import annotations

import heapq
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: estimated cost of a text of n tokens: LINEAR * n for the layers and QUADRATIC * n * n for attention within it
LINEAR, QUADRATIC = 1.0, 1.0 / 12_288
#: containers that one task fills; more texts make more shards, so no task grows with the table
SHARD_CONTAINERS = 2_048


def pack(sizes: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[int]:
    """The container of each size (in descending order, none above ``capacity``).

    Each text goes to the open container of least cost that has room for it,
    and a new one is opened only if none has: opening enough for the total at
    once would spread the room left so evenly that no text fits in it.  A
    minimum tree over the room left finds a container in O(log n); its leaves
    are the different sizes, so memory follows the texts and not the capacity.
    """
    steps = sorted(set(sizes))
    # room is told apart only by how many of the sizes fit in it
    rank = lambda room: bisect_right(steps, room)
    width = 1 << len(steps).bit_length()
    none = (float("inf"), -1)
    tree = [none] * (2 * width)
    heaps: list[list] = [[] for _ in range(len(steps) + 1)]

    def touch(r: int) -> None:
        i = r + width
        tree[i] = heaps[r][0] if heaps[r] else none
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b
            i >>= 1

    left: list[int] = []
    out = []
    for n in sizes:
        lo, hi, best = rank(n) + width, 2 * width, none
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                best = min(best, tree[hi])
            lo >>= 1
            hi >>= 1
        cost, i = best
        if i < 0:
            cost, i = 0.0, len(left)
            left.append(capacity)
        else:
            heapq.heappop(heaps[rank(left[i])])
            touch(rank(left[i]))
        left[i] -= n
        heapq.heappush(heaps[rank(left[i])], (cost + linear * n + quadratic * n * n, i))
        touch(rank(left[i]))
        out.append(i)
    return out


def fill_containers(items: DataFrame, packs: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """``items(item, doc_id, n_tokens, digest)`` -> where each piece of each item lies, for each pack.

    Columns: ``pack_name, container_id, doc_id, piece_no, n_tokens, start_at``
    (tokens before the piece in its container).  Only an item above the
    capacity is split: into full pieces, which fill containers of their own,
    and a rest that is packed as others are.  Items are dealt by a seeded hash
    of their ``digest`` into shards of about ``SHARD_CONTAINERS`` containers,
    which are packed apart; a shard leaves few containers unfilled, so the loss
    does not grow.  ``item`` tells equal items apart and decides nothing else,
    so a seed gives the same packing however the input is split into files.

    Defined cases: an item without tokens takes no room and lies in no
    container; equal items are items each; packs without a positive capacity
    are left out, and of several rows of a pack the smallest capacity holds; a
    null ``doc_id`` stays null; no items, no rows.
    """
    packs = sorted((n, int(c)) for n, c in packs if n is not None and c is not None and c > 0)
    packs = [p for i, p in enumerate(packs) if not i or packs[i - 1][0] != p[0]]
    if not packs:
        packs, items = [("", 1)], items.limit(0)
    each = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("cap")) for n, c in packs])
    rows = items.where("n_tokens > 0").select("item", "doc_id", "n_tokens", "digest", F.explode(each).alias("p")).select("item", "doc_id", "n_tokens", "digest", "p.*")
    full = F.when(F.col("n_tokens") > F.col("cap"), F.floor(F.col("n_tokens") / F.col("cap"))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("full", full)
    filled = rows.where("full > 0").select("pack_name", "item", "doc_id", "cap", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"))
    filled = filled.select(
        "pack_name", F.concat_ws("-", F.lit("full"), "item", "piece_no").alias("container_id"), "doc_id", "piece_no",
        F.col("cap").cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("start_at"),
    )
    rest = rows.withColumn("n", F.col("n_tokens") - F.col("full") * F.col("cap")).where("n > 0").select("pack_name", "cap", "item", "doc_id", "digest", F.col("full").alias("piece_no"), "n")
    totals = {r["pack_name"]: r["t"] for r in rest.groupBy("pack_name").agg(F.sum("n").alias("t")).collect()}
    shards = F.coalesce(*[F.when(F.col("pack_name") == n, F.lit(max(1, round((totals.get(n) or 0) / c / SHARD_CONTAINERS)))) for n, c in packs])
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "digest"), shards).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "digest", "item"], ascending=[False, True, True], kind="stable")
        at = pack(pdf["n"].tolist(), int(pdf["cap"].iloc[0]))
        pdf["container_id"] = [f"{s}-{i}" for s, i in zip(pdf["shard"], at)]
        pdf["start_at"] = pdf.groupby("container_id")["n"].cumsum() - pdf["n"]
        return pdf.rename(columns={"n": "n_tokens"})[["pack_name", "container_id", "doc_id", "piece_no", "n_tokens", "start_at"]]

    # as text, since pandas would make a number with nulls a float
    rest = rest.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = rest.groupBy("pack_name", "shard").applyInPandas(fill, "pack_name string, container_id string, doc_id string, piece_no int, n_tokens bigint, start_at bigint")
    return packed.withColumn("doc_id", F.col("doc_id").cast(items.schema["doc_id"].dataType)).unionByName(filled)


def fill_report(packed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Per pack: pieces, containers, tokens, unused room and its share, and how evenly the estimated cost lies: the mean and greatest cost of a container and the deviation over the mean."""
    caps = F.coalesce(*[F.when(F.col("pack_name") == n, F.lit(c)) for n, c in packs])
    cost = F.sum(LINEAR * F.col("n_tokens") + QUADRATIC * F.col("n_tokens") * F.col("n_tokens"))
    per = packed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), cost.alias("cost"))
    room = F.count("*") * F.first(caps)
    return per.groupBy("pack_name").agg(
        F.sum("k").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"),
        (room - F.sum("t")).alias("unused_tokens"), F.round(1 - F.sum("t") / room, 6).alias("unused_share"),
        F.round(F.mean("cost"), 3).alias("mean_cost"), F.round(F.max("cost"), 3).alias("greatest_cost"), F.round(F.stddev_pop("cost") / F.mean("cost"), 6).alias("cost_deviation"),
    )


def fill_check(items: DataFrame, packed: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    """Per pack what must hold: items of tokens, containers above the capacity, items split in vain, items whose tokens do not add up, containers beyond twice the least number."""
    want = items.where("n_tokens > 0").groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("want"), F.max("n_tokens").alias("largest"))
    out = None
    for name, cap in packs:
        mine = packed.where(F.col("pack_name") == name)
        per = mine.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
        got = mine.groupBy("doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
        docs = want.withColumnRenamed("doc_id", "d").join(got, F.col("d").eqNullSafe(F.col("doc_id")), "full_outer").agg(
            F.sum("n_items").alias("n_items"), F.count_if((F.col("largest") <= cap) & (F.col("pieces") > F.col("n_items"))).alias("n_split_in_vain"), F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("n_not_whole")
        )
        cons = per.agg(F.count_if(F.col("t") > cap).alias("n_over"), (F.count("*") > 2 * F.ceil(F.sum("t") / cap)).cast("int").alias("wasteful"))
        row = docs.crossJoin(cons).select(F.lit(name).alias("pack_name"), "n_items", "n_over", "n_split_in_vain", "n_not_whole", "wasteful")  # a row each
        out = row if out is None else out.unionByName(row)
    return out
