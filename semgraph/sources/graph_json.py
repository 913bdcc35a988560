"""Graph documents as JSON: reading with the format's defaults, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.operators.build import edge_kind

_LEVELS = "typeResolution string, callResolution string, implementationResolution string, crossModuleReferences string, overrideResolution string"
DOCUMENT = (
    "version string, language string, "
    f"adapter struct<name: string, version: string, capabilities: struct<discoverSymbols: boolean, {_LEVELS.replace(' string', ': string')}>>, "
    "symbols array<struct<id: string, name: string, qualifiedName: string, kind: string, filePath: string, line: int, parentId: string, visibility: string, isAbstract: boolean, isStatic: boolean, properties: map<string,string>>>, "
    "edges array<struct<sourceId: string, targetId: string, kind: string, evidence: struct<kind: string, adapterName: string, sourceSpan: string, confidence: string>, properties: map<string,string>, "
    "callSite: struct<filePath: string, line: int, column: int, endLine: int, endColumn: int, containingSymbolId: string>, profiles: array<string>>>"
)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """``document_id, payload`` of the JSON files below a folder, one document per file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("document_id"), F.col("value").alias("payload"))


def parse(df: DataFrame, doc_id: str, payload: str) -> DataFrame:
    """``document_id, d`` of every payload that is an object; ``modules`` of a document are not read.

    A part of another shape than the format's is null, the rest of the document stays.
    """
    text = F.regexp_replace(payload, "^[\\uFEFF\\s]+", "")
    return df.select(F.col(doc_id).alias("document_id"), F.from_json(text, DOCUMENT).alias("d")).where("d.symbols is not null or d.edges is not null or d.version is not null")


def symbols_of(docs: DataFrame) -> DataFrame:
    """Raw symbols with ``ord``: a missing kind is a module, a missing visibility public."""
    rows = docs.select("document_id", F.posexplode("d.symbols").alias("pos", "x")).where("x is not null")
    return rows.select(
        "document_id", "pos", F.coalesce("x.id", F.lit("")).alias("id"), F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.qualifiedName", F.lit("")).alias("qualified_name"),
        F.lower(F.coalesce("x.kind", F.lit("module"))).alias("kind"), F.coalesce("x.filePath", F.lit("")).alias("file_path"), F.coalesce("x.line", F.lit(0)).alias("line"),
        F.when(F.col("x.parentId") != "", F.col("x.parentId")).alias("parent_id"), F.lower(F.coalesce("x.visibility", F.lit("public"))).alias("visibility"), F.coalesce("x.isAbstract", F.lit(False)).alias("is_abstract"),
        F.coalesce("x.isStatic", F.lit(False)).alias("is_static"), F.coalesce("x.properties", F.create_map().cast("map<string,string>")).alias("properties"),
        F.struct("document_id", "pos").alias("ord"),
    )


def edges_of(docs: DataFrame) -> DataFrame:
    """Raw edges with ``ord``: a missing kind is containment; no evidence is inferred without confidence, evidence without confidence a best effort."""
    rows = docs.select("document_id", F.posexplode("d.edges").alias("pos", "x")).where("x is not null")
    told = F.struct(
        F.coalesce("x.evidence.kind", F.lit("syntax")).alias("kind"), F.coalesce("x.evidence.adapterName", F.lit("")).alias("adapter_name"),
        F.coalesce("x.evidence.sourceSpan", F.lit("")).alias("source_span"), F.coalesce("x.evidence.confidence", F.lit("bestEffort")).alias("confidence"),
    )
    none = F.struct(F.lit("inferred").alias("kind"), F.lit("unknown").alias("adapter_name"), F.lit("").alias("source_span"), F.lit("none").alias("confidence"))
    site = F.struct(
        F.col("x.callSite.filePath").alias("file_path"), F.col("x.callSite.line").alias("line"), F.col("x.callSite.column").alias("col"),
        F.col("x.callSite.endLine").alias("end_line"), F.col("x.callSite.endColumn").alias("end_col"), F.col("x.callSite.containingSymbolId").alias("containing_symbol_id"),
    )
    return rows.select(
        "document_id", "pos", F.coalesce("x.sourceId", F.lit("")).alias("source_id"), F.coalesce("x.targetId", F.lit("")).alias("target_id"),
        edge_kind(F.coalesce("x.kind", F.lit("contains"))).alias("kind"), F.when(F.col("x.evidence").isNull(), none).otherwise(told).alias("evidence"),
        F.coalesce("x.properties", F.create_map().cast("map<string,string>")).alias("properties"), F.when(F.col("x.callSite").isNotNull(), site).alias("call_site"),
        F.col("x.profiles").alias("profiles"), F.struct("document_id", "pos").alias("ord"),
    )


def adapters_of(docs: DataFrame) -> DataFrame:
    """The capabilities of each document's adapter; a missing level is none."""
    levels = [x.split()[0] for x in _LEVELS.split(", ")]
    cap = "d.adapter.capabilities."
    return docs.select(
        "document_id", F.coalesce("d.version", F.lit("1.0")).alias("version"), F.coalesce("d.language", F.lit("")).alias("language"), F.coalesce("d.adapter.name", F.lit("")).alias("name"),
        F.coalesce("d.adapter.version", F.lit("")).alias("adapter_version"), F.coalesce(cap + "discoverSymbols", F.lit(False)).alias("discovers"), *[F.coalesce(cap + x, F.lit("none")).alias(x) for x in levels],
    )


def _map(c: str) -> Column:
    return F.when(F.size(c) > 0, F.col(c))


def in_parts(symbols: DataFrame, edges: DataFrame, document: str, rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``part``: documents of more than ``rows`` rows are cut into parts of about as many, so that none is too large for a task."""
    sizes = symbols.select(document).unionByName(edges.select(document)).groupBy(document).agg(F.ceil(F.count("*") / rows).cast("int").alias("_n"))
    cut = lambda df, *key: df.join(sizes, document).withColumn("part", F.concat(F.col(document), F.when(F.col("_n") > 1, F.concat(F.lit("#"), F.pmod(F.xxhash64(*key), F.col("_n")).cast("string"))).otherwise(""))).drop("_n")
    return cut(symbols, "id"), cut(edges, "source_id", "target_id", "kind", "role")


def to_documents(symbols: DataFrame, edges: DataFrame, document_of: Column, edge_document_of: Column, version: str = "1.0", language: str = "") -> DataFrame:
    """``document_id, payload``: one JSON document per value of ``document_of``; nulls and empty properties are left out.

    A document is one row, so the columns must cut the graph into parts that fit a task, such as modules.
    """
    s = symbols.select(document_of.alias("document_id"), F.struct(
        "id", "name", F.col("qualified_name").alias("qualifiedName"), "kind", F.col("file_path").alias("filePath"), "line", F.col("parent_id").alias("parentId"), "visibility",
        F.col("is_abstract").alias("isAbstract"), F.col("is_static").alias("isStatic"), _map("properties").alias("properties"),
    ).alias("x")).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col("x.id").alias("k"), F.to_json("x").alias("j")))).alias("a"))
    site = F.when(F.col("call_site").isNotNull(), F.struct(
        F.col("call_site.file_path").alias("filePath"), F.col("call_site.line").alias("line"), F.col("call_site.col").alias("column"), F.col("call_site.end_line").alias("endLine"),
        F.col("call_site.end_col").alias("endColumn"), F.col("call_site.containing_symbol_id").alias("containingSymbolId"),
    ))
    proof = F.struct(F.col("evidence.kind").alias("kind"), F.col("evidence.adapter_name").alias("adapterName"), F.col("evidence.source_span").alias("sourceSpan"), F.col("evidence.confidence").alias("confidence"))
    row = F.struct(F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"), "kind", proof.alias("evidence"), _map("properties").alias("properties"), site.alias("callSite"), "profiles")
    e = edges.select(edge_document_of.alias("document_id"), F.to_json(row).alias("j")).groupBy("document_id").agg(F.sort_array(F.collect_list("j")).alias("b"))
    joined = s.join(e, "document_id", "full_outer")
    body = F.concat(
        F.lit(f'{{"version":"{version}","language":"{language}","symbols":['), F.coalesce(F.array_join(F.col("a.j"), ","), F.lit("")), F.lit('],"edges":['),
        F.coalesce(F.array_join("b", ","), F.lit("")), F.lit("]}"),
    )
    return joined.select("document_id", body.alias("payload"))
