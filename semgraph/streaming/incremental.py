"""Incremental re-analysis: what changed, what to do about it, and replacing the parts of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

NO_PRIOR, MODULE_SET, DESCRIPTOR, SCOPE = "NoPriorAnalysis", "ModuleSetChanged", "ModuleDescriptorChanged", "AnalysisScopeChanged"


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, module, content_hash, modified_at`` of two times -> ``path, module, status``.

    ``added``, ``removed``, ``changed`` (another hash), ``touched`` (only a
    later time) or ``same``: the time is looked at first, the hash decides.
    """
    a = before.select("path", F.col("module").alias("m0"), F.col("content_hash").alias("h0"), F.col("modified_at").alias("t0"))
    b = after.select("path", F.col("module").alias("m1"), F.col("content_hash").alias("h1"), F.col("modified_at").alias("t1"))
    status = (
        F.when(F.col("h0").isNull() & F.col("m0").isNull(), "added").when(F.col("h1").isNull() & F.col("m1").isNull(), "removed")
        .when(~F.col("h0").eqNullSafe(F.col("h1")), "changed").when(F.col("t0") < F.col("t1"), "touched").otherwise("same")
    )
    return a.join(b, "path", "full_outer").select("path", F.coalesce("m1", "m0").alias("module"), status.alias("status"))


def with_modules_forced(diff: DataFrame, authoritative: DataFrame | None = None) -> DataFrame:
    """A diff in which a changed, added or removed project file makes every file of its module changed.

    ``authoritative(path)``, where it is given, are the only files that may have
    changed by content; removed files and forced modules count all the same.
    """
    rows = diff
    if authoritative is not None:
        known = authoritative.select("path").distinct().withColumn("_told", F.lit(True))
        status = F.when(F.col("_told").isNull() & F.col("status").isin("changed", "added"), "same").otherwise(F.col("status"))
        rows = rows.join(known, "path", "left").select("path", "module", status.alias("status"))
    forced = diff.where("path like '%.csproj' and status in ('changed', 'added', 'removed')").select("module").distinct().withColumn("_forced", F.lit(True))
    status = F.when(F.col("_forced") & F.col("status").isin("same", "touched"), "changed").otherwise(F.col("status"))
    return rows.join(forced, "module", "left").select("path", "module", status.alias("status"))


def choose_mode(before: DataFrame | None, after: DataFrame, scope_before: str | None = None, scope_after: str | None = None, allow_full: bool = True) -> tuple[str, str | None]:
    """``("Incremental" | "FullFallback" | "Rejected", reason)`` from the manifests; modules are compared by set, descriptors by hash."""
    reason = None
    if before is None:
        reason = NO_PRIOR
    elif scope_before != scope_after:
        reason = SCOPE
    else:
        mods = before.select("module").distinct().withColumn("a", F.lit(1)).join(after.select("module").distinct().withColumn("b", F.lit(1)), "module", "full_outer")
        if mods.where("a is null or b is null").limit(1).count():
            reason = MODULE_SET
        elif manifest_diff(before, after).where("path like '%.csproj' and status in ('changed', 'added', 'removed')").limit(1).count():
            reason = DESCRIPTOR
    if reason is None:
        return "Incremental", None
    return ("FullFallback" if allow_full else "Rejected"), reason


def replace_files(old: DataFrame, new: DataFrame, diff: DataFrame, key: str = "path") -> DataFrame:
    """Rows per file with those of changed, added and removed files replaced by ``new``; the others stay as they are."""
    moved = diff.where("status in ('changed', 'added', 'removed')").select(F.col("path").alias(key))
    return old.join(moved, key, "left_anti").unionByName(new.join(moved, key, "left_semi"))


def tag_profile(edges: DataFrame, profile: str) -> DataFrame:
    return edges.withColumn("profiles", F.array(F.lit(profile)))


def drift(full: DataFrame, incremental: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that only one of two runs has, with the number of times: ``side`` full or incremental."""
    a, b = full.select(*cols), incremental.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("full")).unionByName(b.exceptAll(a).withColumn("side", F.lit("incremental")))


def staleness(manifest: DataFrame, current: DataFrame, analyzed_at: Column, now: Column, warn_s: int = 3_600) -> DataFrame:
    """One row: seconds since the analysis, files changed since, and whether to warn."""
    newer = current.join(manifest.select("path", F.col("modified_at").alias("t0")), "path", "left").agg(F.count_if(F.coalesce(F.col("modified_at") > F.col("t0"), F.lit(True))).alias("changed_files"))
    age = F.unix_timestamp(now) - F.unix_timestamp(analyzed_at)
    return newer.select(age.alias("age_s"), "changed_files", ((age > warn_s) | (F.col("changed_files") > 0)).alias("stale"))


def file_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def upsert_stream(changes: DataFrame, table: str, key: list[str], order: list[str], checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the newest row of each key of a change stream in a partitioned table, exactly once per batch.

    Every batch writes its own folder ``batch=<n>`` and overwrites it if it is
    repeated after a failure, so no row counts twice; readers take the newest
    row over the folders with ``newest_of``.
    """

    def write(batch: DataFrame, n: int) -> None:
        keep = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r")).select(*key, "r.*")
        last.write.mode("overwrite").parquet(f"{table}/batch={n}")
        if after:
            after(last, n)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    keep = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r")).select(*key, "r.*")


def newest_of(spark: SparkSession, table: str, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key over all batches of a table kept by ``upsert_stream``, compacted ones included."""
    return _newest(spark.read.parquet(table), key, order)


def compact(spark: SparkSession, table: str, key: list[str], order: list[str]) -> int | None:
    """Merges the batches of a table into one, so that readers do not aggregate all history; the number of the batch that holds them now.

    The merged rows take the place of the last batch; they are written beside
    the table first.  A run that is lost before the end leaves rows told
    twice, which readers take once.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(table).getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(fs_path(table)) if s.getPath().getName().startswith("batch="))
    if len(batches) < 2:
        return batches[0] if batches else None
    last = batches[-1]
    newest_of(spark, table, key, order).write.mode("overwrite").parquet(f"{table}-compact")
    for n in batches[:-1]:
        fs.delete(fs_path(f"{table}/batch={n}/_SUCCESS"), False)
    fs.delete(fs_path(f"{table}/batch={last}"), True)
    fs.rename(fs_path(f"{table}-compact"), fs_path(f"{table}/batch={last}"))
    for n in batches[:-1]:
        fs.delete(fs_path(f"{table}/batch={n}"), True)
    return last


def windowed_counts(changes: DataFrame, time: str, by: str, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """An extension: counts per event-time window; rows later than ``late`` behind the newest are past their window."""
    return changes.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), by, "n")
