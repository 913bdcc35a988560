"""Differences between two copies of a table by hierarchical checksums.

Both sides reduce to one digest per field and key.  Fingerprints of the keys
are combined over key ranges, the ranges are halved again and again down to
leaves of about ``LEAF_KEYS`` keys, and only ranges whose checksums differ are
followed downwards.  Keys are compared one by one, field by field, only inside
leaves that differ.  Fields are held as 64-bit digests, so no raw value is
ever shuffled; that two different values of a key have one digest is a chance
of 2^-64.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.operators.deliveries import newest
from semgraph.session import materialize, new_folder

LEAF_KEYS = 16
#: halvings between two levels of checksums that are compared
STEP = 4
_PARTS = ("n", "x", "y")


def _checksums(df: DataFrame, rng: Column, side: str) -> DataFrame:
    """Checksums per range: the number of keys and the xors of two independent fingerprints; none can overflow."""
    return df.groupBy(rng.alias("rng")).agg(F.count("*").alias(f"{side}_n"), F.bit_xor("fp").alias(f"{side}_x"), F.bit_xor("fp2").alias(f"{side}_y"))


def checksum_tree(left: DataFrame, right: DataFrame, low: int, high: int, shift: int, base: str) -> DataFrame:
    """``left(key, fp, fp2)``, ``right(key, fp, fp2)`` with keys from ``low`` to ``high`` -> the leaves that differ, as ``rng``.

    A leaf is ``key >> shift``; the level above halves the number of ranges
    ``STEP`` times, up to at most two ranges (one of each sign).  Each level is
    made of the written one below.  The descent starts at the top and keeps a
    range only if its parent range differs.
    """
    leaf = F.shiftright("key", shift)
    level = _checksums(left, leaf, "a").join(_checksums(right, leaf, "b"), "rng", "full_outer").fillna(0)
    levels = [materialize(level, f"{base}/level0")]
    lo, hi = low >> shift, high >> shift
    while hi - lo > 1:
        lo, hi = lo >> STEP, hi >> STEP
        agg = [(F.sum if p == "n" else F.bit_xor)(f"{s}_{p}").alias(f"{s}_{p}") for s in "ab" for p in _PARTS]
        levels.append(materialize(levels[-1].groupBy(F.shiftright("rng", STEP).alias("rng")).agg(*agg), f"{base}/level{len(levels)}"))
    differ = reduce(lambda x, y: x | y, [F.col(f"a_{p}") != F.col(f"b_{p}") for p in _PARTS])
    bad = levels[-1].where(differ).select("rng")
    for level in reversed(levels[:-1]):
        bad = level.where(differ).join(bad.withColumnRenamed("rng", "up"), F.shiftright("rng", STEP) == F.col("up"), "left_semi").select("rng")
    return bad


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_order: list[str], right_order: list[str], only_left: str, only_right: str) -> DataFrame:
    """``(key, finding)``: keys that only one side has, and each field whose values differ.

    The row of a key is the one with the greatest order columns.  ``key`` is
    an integer column; ``fields`` are strings or cast to strings, compared as
    they are (clean them before), nulls equal to nulls.

    Both sides are read once and written as digests, which are read for the
    leaves and, joined with the differing leaves before they are shuffled, for
    the comparison.  The descent saves shuffling and comparing, not reading.

    Defined cases: rows without a key belong to no record and are left out;
    several rows of a key count as the newest, and as one of them if the order
    columns tie; keys may be any 64-bit integers; two empty tables give no
    rows; ranges need not be evenly filled, that only costs time.
    """
    base = new_folder(left.sparkSession, "diff")
    names = [f"h{i}" for i in range(len(fields))]

    def prints(df: DataFrame, order: list[str], tag: str) -> DataFrame:
        """The newest row of each key as a digest per field, 0 for null; the raw values are not shuffled."""
        ords = [f"o{i}" for i in range(len(order))]
        digests = [F.when(F.col(f).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(f).cast("string"))).alias(h) for f, h in zip(fields, names)]
        slim = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).alias(o) for c, o in zip(order, ords)], *digests)
        return materialize(newest(slim, "key", [*ords, *names], names), f"{base}/{tag}")

    a, b = prints(left, left_order, "a"), prints(right, right_order, "b")
    keys = a.select("key").unionByName(b.select("key")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).first()
    low, high, n = keys["low"] or 0, keys["high"] or 0, keys["n"]
    shift = max(0, (high - low).bit_length() - max(1, (n // (2 * LEAF_KEYS)).bit_length()))
    printed = lambda df: df.select("key", F.xxhash64("key", *names).alias("fp"), F.xxhash64(F.lit(1), "key", *names).alias("fp2"))
    bad = checksum_tree(printed(a), printed(b), low, high, shift, base)
    # both sides go once through the shuffle; keys then meet within their range
    sides = [df.select(F.shiftright("key", shift).alias("rng"), "key", F.struct(*names).alias("row"), F.lit(i).alias("side")).join(bad, "rng", "left_semi") for i, df in enumerate((a, b))]
    row = lambda i: F.max(F.when(F.col("side") == i, F.col("row")))
    met = sides[0].unionByName(sides[1]).groupBy("rng", "key").agg(row(0).alias("l"), row(1).alias("r"))
    differing = [F.when(F.col(f"l.{h}") != F.col(f"r.{h}"), F.lit(f)) for f, h in zip(fields, names)]
    finding = F.when(F.col("r").isNull(), F.array(F.lit(only_left))).when(F.col("l").isNull(), F.array(F.lit(only_right))).otherwise(F.array_compact(F.array(*differing)))
    return met.select("key", F.explode(finding).alias("finding"))
