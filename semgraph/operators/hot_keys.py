"""Per-key figures without a task that holds a key: exact offset chunking.

Equal rows are combined first and the distinct ones dealt to partitions by a
hash of the whole row, so that a key of very many rows lies in all of them.
Rows are counted per key and partition, the counts summed up to offsets, and
every row so gets its exact number within its key.  Numbers are cut into
chunks of equal size, chunks are worked on apart, and their states are merged
in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semgraph.session import materialize, new_folder

CHUNK_ROWS = 65_536
#: ``monotonically_increasing_id`` has the partition above these bits and the row's place in it below
_PLACE_BITS = 33


def numbered(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every distinct ``(key, value)`` with its number within the key: ``key, value, weight, row_at, chunk_no``.

    ``weight`` says how many rows of ``df`` it stands for, ``row_at`` counts
    from 0 within the key, ``chunk_no`` is ``row_at`` over ``chunk_rows``.  A
    key of no more than ``chunk_rows`` distinct rows is one chunk, number 0,
    and its rows have no ``row_at``.
    The rows are written once before they are counted, so a partition that is
    computed again after a loss numbers the same rows the same way.  A window
    over the counts of a key sees a row per partition.
    """
    base = new_folder(df.sparkSession, "numbered")
    pairs = df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).where("key is not null")
    pairs = pairs.groupBy("key", "value").agg(F.count("*").alias("weight")).sortWithinPartitions(F.xxhash64("key"), "key")
    rows = materialize(pairs.withColumn("at", F.monotonically_increasing_id()), f"{base}/rows")
    pid = F.shiftright("at", _PLACE_BITS)
    # both are written, so that their size is known where they are joined: small ones are broadcast, others not
    long_ = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows).select("key"), f"{base}/long")
    counts = rows.join(long_, "key", "left_semi").groupBy("key", pid.alias("pid")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    w = Window.partitionBy("key").orderBy("pid")
    # rows of a key lie one after another in a partition
    shift = F.sum("n").over(w) - F.col("n") - F.col("first_at")
    offsets = materialize(counts.select(F.col("key").alias("_key"), F.col("pid").alias("_pid"), shift.alias("shift")), f"{base}/offsets")
    placed = rows.join(offsets, (F.col("key") == F.col("_key")) & (pid == F.col("_pid")), "left")
    # rows of a key without offsets are one chunk; their numbers are not needed to cut it
    at = F.col("at") + F.col("shift")
    return placed.select("key", "value", "weight", at.alias("row_at"), F.coalesce(F.floor(at / chunk_rows), F.lit(0)).alias("chunk_no"))


def chunk_states(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The chunks of every key in order, with exact offsets.

    Columns: ``key, chunk_no, first_row`` (rows of the key in the chunks before
    it), ``n_rows`` and ``n_values`` (rows of ``df``, and distinct non-null
    values, of the chunk; a value lies in one chunk only) and ``n_distinct``
    (distinct rows: exactly ``chunk_rows`` in all chunks of a key but the last).
    A window over the states of a key sees one row per chunk.
    """
    states = numbered(df, key, value, chunk_rows).groupBy("key", "chunk_no").agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_values"), F.count("*").alias("n_distinct"))
    w = Window.partitionBy("key").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return states.select("key", "chunk_no", F.coalesce(F.sum("n_rows").over(w), F.lit(0)).alias("first_row"), "n_rows", "n_values", "n_distinct")


def per_key_counts(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``key, n_rows, n_values``: rows and distinct non-null values of each non-null key.

    Defined cases: rows of a null key are no key's; null values are rows but no
    value; empty input gives no rows; equal rows count each; columns of the
    input with clashing names do not matter, as only two are read.
    """
    return chunk_states(df, key, value, chunk_rows).groupBy("key").agg(F.max(F.col("first_row") + F.col("n_rows")).alias("n_rows"), F.sum("n_values").alias("n_values"))
