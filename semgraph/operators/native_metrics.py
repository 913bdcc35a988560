"""Figures of edge roles per file, module and symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.operators.analysis import module_of
from semgraph.operators.build import Graph, file_of

#: fixed values: the roles of reference edges that are counted, and those that name a type
ROLES = ("include", "globalAccess", "fieldAccess", "parameterType", "callbackTarget", "enumMember", "fieldType", "underlyingType", "globalType", "returnType")
TYPE_ROLES = ("parameterType", "fieldType", "underlyingType", "globalType", "returnType")


def role_class() -> Column:
    """The counted role of a reference edge, null for others."""
    return F.when((F.col("kind") == "references") & F.col("role").isin(*ROLES), F.col("role"))


def _counts(prefix: str) -> list[Column]:
    out = [F.count_if(F.col("kind") == "references").alias(f"{prefix}_references"), F.count_if(F.col("kind") == "calls").alias(f"{prefix}_calls")]
    out += [F.count_if(F.col("rc") == r).alias(f"{prefix}_{r}") for r in ROLES]
    return [*out, F.count_if(F.col("rc").isin(*TYPE_ROLES)).alias(f"{prefix}_type_references")]


def _classed(g: Graph) -> DataFrame:
    return g.links.select("source_id", "target_id", "kind", "role").withColumn("rc", role_class())


def file_metrics(g: Graph) -> DataFrame:
    """Per file: declared symbols, edges in and out by role, calls within and across files."""
    files = file_of(g.symbols)
    e = _classed(g).join(files.select(F.col("id").alias("source_id"), F.col("file_id").alias("sf")), "source_id", "left").join(files.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf")), "target_id", "left")
    cross = (F.col("kind") == "calls") & (F.col("sf") != F.col("tf"))
    outs = e.where("sf is not null").groupBy(F.col("sf").alias("id")).agg(*_counts("out"), F.count_if(cross).alias("out_cross_calls"), F.count_if((F.col("kind") == "calls") & (F.col("sf") == F.col("tf"))).alias("local_calls"))
    ins = e.where("tf is not null").groupBy(F.col("tf").alias("id")).agg(*_counts("in"), F.count_if(cross).alias("in_cross_calls"))
    decl = files.where("id <> file_id").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("declared"))
    mine = g.symbols.where("kind = 'file'").select("id")
    return mine.join(decl, "id", "left").join(outs, "id", "left").join(ins, "id", "left").fillna(0)


def module_metrics(g: Graph) -> DataFrame:
    """Per module: symbols, edges by role, calls within and across files."""
    mods = module_of(g).where("module is not null")
    files = file_of(g.symbols)
    e = _classed(g).join(mods.select(F.col("id").alias("source_id"), "module"), "source_id")
    e = e.join(files.select(F.col("id").alias("source_id"), F.col("file_id").alias("sf")), "source_id", "left").join(files.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf")), "target_id", "left")
    call = F.col("kind") == "calls"
    per = e.groupBy(F.col("module").alias("id")).agg(F.count("*").alias("edges"), *_counts("out"), F.count_if(call & (F.col("sf") == F.col("tf"))).alias("same_file_calls"), F.count_if(call & (F.col("sf") != F.col("tf"))).alias("cross_file_calls"))
    syms = mods.where("id <> module").groupBy(F.col("module").alias("id")).agg(F.count("*").alias("symbols"))
    return g.symbols.where("kind = 'module'").select("id").join(syms, "id", "left").join(per, "id", "left").fillna(0)


def symbol_metrics(g: Graph) -> DataFrame:
    """Per symbol with links: counts in and out by role, and calls within its file and across files."""
    files = file_of(g.symbols)
    e = _classed(g).join(files.select(F.col("id").alias("source_id"), F.col("file_id").alias("sf")), "source_id", "left").join(files.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf")), "target_id", "left")
    call = F.col("kind") == "calls"
    where = lambda prefix: (F.count_if(call & (F.col("sf") == F.col("tf"))).alias(f"{prefix}_same_file_calls"), F.count_if(call & (F.col("sf") != F.col("tf"))).alias(f"{prefix}_cross_file_calls"))
    outs = e.groupBy(F.col("source_id").alias("id")).agg(*_counts("out"), *where("out"))
    ins = e.groupBy(F.col("target_id").alias("id")).agg(*_counts("in"), *where("in"))
    return outs.join(ins, "id", "full_outer").fillna(0)


def unit_summary(units: DataFrame) -> DataFrame:
    """``units(module, parsed boolean, n_diagnostics, n_defines, standard)`` -> figures of a build per module."""
    return units.groupBy("module").agg(
        F.count("*").alias("units"), F.count_if("parsed").alias("parsed"), F.count_if(~F.coalesce("parsed", F.lit(False))).alias("failed"),
        F.sum("n_diagnostics").alias("diagnostics"), F.sum("n_defines").alias("defines"), F.array_join(F.array_sort(F.collect_set("standard")), ",").alias("standards"),
    )
