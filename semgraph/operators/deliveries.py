"""Newest rows of delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.session import materialize, new_folder

#: keys of several rows that every task may hold
FEW_KEYS = 2_000_000


def newest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row of each non-null ``key`` with the greatest ``order``; partial aggregation absorbs keys of very many rows."""
    row = F.max_by(F.struct(*keep), F.struct(*order))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row")).select(key, "_row.*")


def newest_of_few(df: DataFrame, key: str, order: list[str], keep: list[str], few: int | None = None) -> DataFrame:
    """``newest`` of a number as ``key`` that few rows share: rows of a key of their own are not shuffled.

    Where more than ``few`` keys have several rows, all rows are compared.
    """
    df, seen = df.where(F.col(key).isNotNull()), Observation()
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key).observe(seen, F.count(F.lit(1)).alias("n"))
    twice = materialize(twice, new_folder(df.sparkSession, "twice"))
    if seen.get["n"] > (FEW_KEYS if few is None else few):
        return newest(df, key, order, keep)
    once = df.join(F.broadcast(twice), key, "left_anti").select(key, *keep)
    return once.unionByName(newest(df.join(F.broadcast(twice), key, "left_semi"), key, order, keep))
