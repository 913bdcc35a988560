"""Checks of the raw tables: one row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.operators.build import edge_kind, edge_role


def validate(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``code, subject``: what is wrong with raw symbols and edges (columns as for ``build``).

    Empty ids and names, ids told again, parents and ends that do not exist,
    edges to themselves (calls may), and edges told again under one identity.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    s = symbols.select("id", "name", "parent_id", "ord")
    e = edges.select("source_id", "target_id", edge_kind(F.col("kind")).alias("kind"), edge_role(F.col("properties")).alias("role"), "ord")
    label = F.concat_ws(" -> ", F.coalesce("source_id", F.lit("")), F.coalesce("target_id", F.lit("")))

    def again(df: DataFrame, *key: str) -> DataFrame:
        """Rows after the first of their key; the first is found by partial aggregation, so no task sorts a key."""
        first = df.groupBy(*key).agg(F.min("ord").alias("_first"))
        return df.join(first, list(key)).where("ord > _first")

    told = lambda code, df, subject: df.select(F.lit(code).alias("code"), subject.alias("subject"))
    ids = s.where(~blank("id")).select("id").distinct()

    def missing(code: str, df: DataFrame, col: str, subject: Column) -> DataFrame:
        return told(code, df.where(~blank(col)).join(ids.withColumnRenamed("id", "_id"), F.col(col) == F.col("_id"), "left_anti"), subject)

    found = [
        told("EMPTY_SYMBOL_ID", s.where(blank("id")), F.coalesce("name", F.lit(""))),
        told("DUPLICATE_SYMBOL_ID", again(s.where(~blank("id")), "id"), F.col("id")),
        told("EMPTY_SYMBOL_NAME", s.where(blank("name")), F.coalesce("id", F.lit(""))),
        told("EMPTY_EDGE_SOURCE", e.where(blank("source_id")), label),
        told("EMPTY_EDGE_TARGET", e.where(blank("target_id")), label),
        missing("DANGLING_EDGE_SOURCE", e, "source_id", label),
        missing("DANGLING_EDGE_TARGET", e, "target_id", label),
        told("SELF_REFERENCING_EDGE", e.where(~blank("source_id") & (F.col("source_id") == F.col("target_id")) & (F.col("kind") != "calls")), label),
        told("DUPLICATE_EDGE", again(e, "source_id", "target_id", "kind", "role"), label),
        missing("DANGLING_PARENT_ID", s, "parent_id", F.coalesce("id", F.lit(""))),
    ]
    return reduce(DataFrame.unionByName, found)
