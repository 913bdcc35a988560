"""References to records that do not exist.

Signed change deltas per key: a record that appears is +1 existence, one that
is deleted -1; a reference is +1 reference.  Running sums over the deltas of a
key in time order tell for each reference whether the record existed when it
was loaded: the reference count is then positive, so it is an orphan if the
existence count is zero.  The deltas are scanned in key order, cut into ranges
of equal size, so a key with a third of all references costs no task more than
others.  ``orphans_by_period`` keeps the counts from batch to batch, so that a
new batch costs its own rows and the counts, not the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.operators.keyscan import CHUNK_ROWS, chunks, in_key_order, starts
from semgraph.session import materialize, new_folder, shuffle_partitions

#: deltas in a range at most on average; more ranges than ``spark.sql.shuffle.partitions`` are made where that is too few
RANGE_ROWS = 4_000_000
#: what a delta is; the order within a key and time
KNOWN, EXISTS, REFERENCE = 0, 1, 2
#: what a reference found; OPEN: it depends on the partitions before
FOUND, MISSING, LATE, DELETED, OPEN = 0, 1, 2, 3, 4

_OUT = "what int, pid int, ref byte, row_no bigint, month int, first_key string, last_key string, known boolean, seen boolean, alive boolean"
_SCHEMA = pa.schema([
    ("what", pa.int32()), ("pid", pa.int32()), ("ref", pa.int8()), ("row_no", pa.int64()), ("month", pa.int32()), ("first_key", pa.string()),
    ("last_key", pa.string()), ("known", pa.bool_()), ("seen", pa.bool_()), ("alive", pa.bool_()),
])


def _scan(batches: Iterator[pa.RecordBatch], chunk_rows: int) -> Iterator[pa.RecordBatch]:
    """Running existence counts over the ordered deltas of one partition.

    Gives a row per reference without a record and one for the state at the
    partition's end (``what`` -1).
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    first_key = key = None
    # of the key that goes on from the chunk before; at first the one that may go on from another partition
    known = seen = False
    count, pending = 0, True
    for t in chunks(batches, chunk_rows):
        n = t.num_rows
        keys = t["key"].combine_chunks()
        kind, alive = t["kind"].to_numpy(), t["alive"].to_numpy().astype(np.int64)
        new = starts(t["key"])
        new[0] = key is not None and keys[0].as_py() != key
        first_key = keys[0].as_py() if first_key is None else first_key
        group = np.cumsum(new)
        carried = group == 0
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        # signed existence deltas: the state after a row less that before it; their running sum within the key
        at = np.flatnonzero(kind == EXISTS)
        before = np.zeros(len(at), np.int64)
        if len(at):
            before[1:] = np.where(group[at[1:]] == group[at[:-1]], alive[at[:-1]], 0)
            before[0] = count if carried[at[0]] else 0
        delta = np.zeros(n, np.int64)
        delta[at] = alive[at] - before
        total = np.cumsum(delta)
        exists = total - (total[begin] - delta[begin]) + np.where(carried, count, 0)
        last_at = np.full(n, -1, np.int64)
        last_at[at] = at
        was_seen = (np.maximum.accumulate(last_at) >= begin) | (carried & seen)
        is_known = (kind[begin] == KNOWN) | (carried & known)
        state = np.where(was_seen, np.where(exists > 0, FOUND, DELETED), np.where(is_known, LATE, MISSING))
        state = np.where(carried & pending & ~was_seen & ~is_known, OPEN, state)
        out = np.flatnonzero((kind == REFERENCE) & (state != FOUND))
        if len(out):
            m, take = len(out), pa.array(out)
            nulls = [pa.nulls(m, f.type) for f in list(_SCHEMA)[5:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(state[out].astype(np.int32)), pa.array(np.full(m, pid, np.int32)), t["ref"].combine_chunks().take(take), t["row_no"].combine_chunks().take(take), t["month"].combine_chunks().take(take), *nulls],
                schema=_SCHEMA,
            )
        pending = pending and bool(carried[-1])
        key, known, seen, count = keys[n - 1].as_py(), bool(is_known[-1]), bool(was_seen[-1]), int(exists[-1])
    if key is not None:
        end = [-1, pid, None, None, None, first_key, key, known, seen, bool(count > 0)]
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(end, _SCHEMA)], schema=_SCHEMA)


def _carries(ends: list) -> dict[int, int]:
    """What a reference to the first key of each partition finds at its start, from the states at the partitions' ends."""
    out: dict[int, int] = {}
    key, known, seen, alive = None, False, False, False
    for e in sorted(ends, key=lambda r: r["pid"]):
        if e["first_key"] != key:
            known = seen = alive = False
        out[e["pid"]] = (FOUND if alive else DELETED) if seen else LATE if known else MISSING
        if e["last_key"] != e["first_key"]:
            known = seen = alive = False
        key, known = e["last_key"], known or e["known"]
        if e["seen"]:
            seen, alive = True, e["alive"]
    return out


def orphan_references(records: DataFrame, references: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """References whose record did not exist when they were loaded.

    ``records(key, loaded_at, row_no, is_deleted)``, ``references(ref byte, key, loaded_at, row_no)``
    -> ``(ref, row_no, month int yyyymm, ref_state)`` with ref_state ``missing``, ``late`` or ``deleted``.

    Defined cases: a null key is no reference and no record; a reference without
    ``loaded_at`` is held against nothing but ``missing``/``late``; a null ``is_deleted``
    is false; equal rows are told each; a record loaded at the same instant as the reference counts as there.
    The driver gets one row per partition, never keys.
    """
    spark = references.sparkSession
    base = new_folder(spark, "orphans")
    month = lambda c: (F.year(c) * 100 + F.month(c)).cast("int")
    none = F.lit(None)
    # a record row is told twice: without a time, that the key is known at all, and as the existence that it gives or takes
    kinds = F.explode(F.array(F.lit(KNOWN).cast("byte"), F.lit(EXISTS).cast("byte")))
    deltas = (
        records.where("key is not null").select("key", "loaded_at", kinds.alias("kind"), "row_no", (~F.coalesce("is_deleted", F.lit(False))).cast("byte").alias("alive"))
        .select("key", F.when(F.col("kind") == EXISTS, F.col("loaded_at")).alias("loaded_at"), "kind", F.when(F.col("kind") == EXISTS, F.col("row_no")).alias("row_no"), F.when(F.col("kind") == EXISTS, F.col("alive")).otherwise(F.lit(0)).cast("byte").alias("alive"), none.cast("byte").alias("ref"), none.cast("int").alias("month"))
        .unionByName(references.where("key is not null").select("key", "loaded_at", F.lit(REFERENCE).cast("byte").alias("kind"), "row_no", F.lit(0).cast("byte").alias("alive"), "ref", month("loaded_at").alias("month")))
    )
    # written, so that finding the ranges does not evaluate the inputs again; their number follows the rows
    seen = Observation()
    deltas = materialize(deltas.observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/deltas")
    ranges = max(shuffle_partitions(spark), -(-seen.get["n"] // RANGE_ROWS))
    scanned = in_key_order(deltas, "key", [F.col("loaded_at"), F.col("kind"), F.col("row_no")], "ref", ranges).select("key", "kind", "row_no", "alive", "ref", "month")
    found = materialize(scanned.mapInArrow(lambda b: _scan(b, chunk_rows), _OUT), f"{base}/found")
    carry = _carries(found.where("what = -1").select("pid", "first_key", "last_key", "known", "seen", "alive").collect())
    carried = spark.createDataFrame(list(carry.items()) or [(-1, MISSING)], "cp int, carry int")
    names = F.create_map(*[F.lit(x) for x in (MISSING, "missing", LATE, "late", DELETED, "deleted")])
    return (
        found.where("what > 0")
        .join(F.broadcast(carried), F.col("pid") == F.col("cp"), "left")
        .withColumn("state", F.when(F.col("what") == OPEN, F.col("carry")).otherwise(F.col("what")))
        .where(F.col("state") != FOUND)
        .select("ref", "row_no", "month", names[F.col("state")].alias("ref_state"))
    )


def apply_deltas(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Signed counts per key after a batch of changes; both tables have ``key, n_existing`` and a column of references per referring table.

    A delta is +1 for each row that came and -1 for each that went, or a sum of
    them.  The sums are commutative, so batches may come in any order, and a
    key is combined before it is shuffled.  A null key is no key.
    """
    rows = deltas if counts is None else counts.unionByName(deltas.select(counts.columns))
    return rows.where("key is not null").groupBy("key").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "key"])


def current_orphans(counts: DataFrame) -> DataFrame:
    """``key, n_references``: keys with references and no record, as the counts stand."""
    n = reduce(lambda a, b: a + b, [F.col(c) for c in counts.columns if c not in ("key", "n_existing")])
    return counts.select("key", "n_existing", n.alias("n_references")).where("n_references > 0 and n_existing <= 0").select("key", "n_references")


def existence_deltas(counts: DataFrame | None, changes: DataFrame) -> DataFrame:
    """``changes(key, alive, n_<table>...)`` of a batch as deltas: +1 if a record came, -1 if it went, 0 if it stays as it was.

    ``alive`` is what the newest record row of the key in the batch says, null if there is none.
    """
    before = F.lit(0).cast("long")
    if counts is not None:
        changes = changes.join(counts.select("key", F.col("n_existing").alias("_before")), "key", "left")
        before = F.coalesce("_before", before)
    refs = [c for c in changes.columns if c not in ("key", "alive", "_before")]
    return changes.select("key", F.when(F.col("alive").isNull(), F.lit(0)).otherwise(F.col("alive").cast("long") - before).cast("long").alias("n_existing"), *refs)


def orphans_by_period(records: DataFrame, references: DataFrame, tables: list[str]) -> list[tuple[int, DataFrame]]:
    """The counts after each month of deliveries, ``[(yyyymm, counts)]``, each made of those before and the month's deltas.

    ``records(key, loaded_at, row_no, is_deleted)``, ``references(ref_table,
    key, loaded_at)`` with ``ref_table`` one of ``tables``.  Deliveries are
    combined to one row per month and key and written by month, so every month
    reads only its own; the driver gets the months.  Rows without a time
    belong to no month and are left out.
    """
    spark = records.sparkSession
    base = new_folder(spark, "periods")
    month = (F.year("loaded_at") * 100 + F.month("loaded_at")).alias("month")
    zero = [F.lit(0).cast("long").alias(f"n_{t}") for t in tables]
    none = F.lit(None)
    recs = records.select(month, "key", F.struct("loaded_at", "row_no", (~F.coalesce("is_deleted", F.lit(False))).alias("alive")).alias("r"), *zero)
    refs = references.select(month, "key", none.cast(recs.schema["r"].dataType).alias("r"), *[(F.col("ref_table") == t).cast("long").alias(f"n_{t}") for t in tables])
    rows = recs.unionByName(refs).where("month is not null and key is not null")
    made = rows.groupBy("month", "key").agg(F.max("r").alias("r"), *[F.sum(f"n_{t}").alias(f"n_{t}") for t in tables])
    made = made.select("month", "key", F.col("r.alive").alias("alive"), *[f"n_{t}" for t in tables])
    made.write.partitionBy("month").parquet(f"{base}/changes")
    changes = spark.read.schema(made.schema).parquet(f"{base}/changes")
    out, counts = [], None
    for m in sorted(r[0] for r in changes.select("month").distinct().collect()):
        batch = changes.where(F.col("month") == m).drop("month")
        counts = materialize(apply_deltas(counts, existence_deltas(counts, batch)), f"{base}/counts-{m}")
        out.append((m, counts))
    return out
