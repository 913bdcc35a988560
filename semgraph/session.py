"""Session helpers: the shared work folder and written intermediate tables.

Iterative operators cut their lineage by writing parquet into the folder the
cluster names in ``spark.checkpoint.dir``.  Every executor can read it, so a
lost executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if "dir" not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dir["dir"] = tempfile.mkdtemp(prefix="semgraph-")
        atexit.register(shutil.rmtree, _own_dir["dir"], ignore_errors=True)
    return "file://" + _own_dir["dir"]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path below the work folder; ``release`` and the end of the driver delete what is written there."""
    path = f"{work_dir(spark)}/semgraph-{uuid.uuid4().hex[:12]}-{tag}"
    if not _made:
        atexit.register(release)
    _made.append((spark, path))
    return path


def release() -> int:
    """Deletes all intermediate tables made so far, when no result is read any more; how many there were."""
    n = len(_made)
    while _made:
        spark, path = _made.pop()
        try:
            discard(spark, path)
        except Exception:  # noqa: S110 - the session may be gone; what it left is deleted with its folder
            pass
    return n


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and return the written table; nothing is recomputed after that."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later plan reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def frequent_keys(df: DataFrame, key: str, parts: int = 200) -> list:
    """Keys that hold more than 1/``parts`` of the non-null rows: fewer than ``parts`` by construction."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = df.where(F.col(key).isNotNull()).agg(F.count("*").alias("total"))
    # one row, so no larger than the keys
    return [r[0] for r in counts.join(F.broadcast(total), F.col("n") * parts > F.col("total")).select(key).collect()]
