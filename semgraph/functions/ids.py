"""Identifier and scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column | str) -> Column:
    """Ids without surrounding spaces and tabs and with ``\\`` read as ``/``; an empty one is null."""
    c = F.col(c) if isinstance(c, str) else c
    # trimming a set of characters is slow, so only ids that need it are trimmed
    ragged = c.startswith(" ") | c.endswith(" ") | c.contains("\t")
    trimmed = F.when(ragged, F.trim(c, F.lit(" \t"))).otherwise(c)
    return F.nullif(F.replace(trimmed, F.lit("\\"), F.lit("/")), F.lit(""))


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
