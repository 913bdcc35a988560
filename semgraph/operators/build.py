"""From raw symbols and edges to a graph: upsert, dangling drop, containment, dedup, derived file edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.functions.paths import path_bucket
from semgraph.schema import CALL_SITE, EDGE_KINDS, EVIDENCE, ROLE_KEYS
from semgraph.session import materialize, new_folder


@dataclass(frozen=True)
class Graph:
    """The two tables of a graph; ``generation`` counts its rebuilds."""

    symbols: DataFrame
    edges: DataFrame
    generation: int = 1

    @property
    def links(self) -> DataFrame:
        """Edges that are not containment."""
        return self.edges.where("kind <> 'contains'")

    @property
    def contains(self) -> DataFrame:
        return self.edges.where("kind = 'contains'")


def kind_ord(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind).cast("int") - 1


def edge_kind(kind: Column) -> Column:
    """The kind in its usual spelling; another word stays as it is, in lower case."""
    k = F.lower(kind)
    return F.when(k == "dependson", "dependsOn").otherwise(k)


def edge_role(properties: Column) -> Column:
    """What tells edges of one source, target and kind apart."""
    all_ = F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\u001f")
    return F.coalesce(*[properties[k] for k in ROLE_KEYS], all_, F.lit(""))


def upsert_symbols(symbols: DataFrame) -> DataFrame:
    """The last row of each id by ``ord``."""
    keep = [c for c in symbols.columns if c not in ("id", "ord", "properties")]
    # maps cannot be ordered or compared, so they travel as arrays of entries
    row = F.struct(*keep, F.map_entries("properties").alias("properties"))
    last = symbols.where("id is not null").groupBy("id").agg(F.max_by(row, "ord").alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in keep], F.map_from_entries("r.properties").alias("properties"))


def drop_dangling(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends both exist.

    The ends that do not exist are found first and written, so that their size
    is known: where they are few, edges are not shuffled for the test, and a
    target of very many edges is no key of a join.
    """
    edges = edges.where("source_id is not null and target_id is not null")
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    gone = materialize(ends.join(ids, "id", "left_anti"), new_folder(edges.sparkSession, "gone"))
    return edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")


#: the ordinal of inferred edges, after all that are told
LAST = 2**62


def synthesize_contains(symbols: DataFrame, edges: DataFrame, last: Column | None = None) -> DataFrame:
    """A containment edge for every parent that exists and has no explicit one to the child.

    ``symbols`` are the raw rows: an id may name several parents.
    """
    pairs = symbols.where("parent_id is not null and parent_id <> id").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id")).distinct()
    known = symbols.select(F.col("id").alias("source_id")).distinct()
    told = edges.where("kind = 'contains'").select("source_id", "target_id").distinct()
    pairs = pairs.join(known, "source_id", "left_semi").join(told, ["source_id", "target_id"], "left_anti")
    return _inferred(pairs, "contains", F.lit(None).cast("map<string,string>"), last)


def _inferred(pairs: DataFrame, kind: str, properties: Column, last: Column | None) -> DataFrame:
    evidence = F.struct(F.lit("inferred").alias("kind"), F.lit("GraphBuilder").alias("adapter_name"), F.lit(None).cast("string").alias("source_span"), F.lit("proven").alias("confidence"))
    return pairs.select(
        "source_id", "target_id", F.lit(kind).alias("kind"), edge_role(properties).alias("role"), evidence.cast(EVIDENCE).alias("evidence"),
        properties.alias("properties"), F.lit(None).cast(CALL_SITE).alias("call_site"), F.lit(None).cast("array<string>").alias("profiles"), (F.lit(LAST) if last is None else last).alias("ord"),
    )


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each identity (source, target, kind, role), with the profiles of all; none at all stay none."""
    row = F.struct("evidence", F.map_entries("properties").alias("properties"), "call_site")
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("profiles"))))
    one = edges.groupBy("source_id", "target_id", "kind", "role").agg(
        F.min_by(row, "ord").alias("r"), F.min("ord").alias("ord"), merged.alias("m"), F.count("profiles").alias("n")
    )
    return one.select(
        "source_id", "target_id", "kind", "role", "r.evidence", F.map_from_entries("r.properties").alias("properties"), "r.call_site",
        F.when(F.col("n") > 0, F.col("m")).alias("profiles"), "ord",
    )


def file_id() -> Column:
    """The id that the file symbol of a symbol would have."""
    return F.when(F.col("kind") == "file", F.col("id")).when(F.coalesce("file_path", F.lit("")) != "", F.concat(F.lit("file:"), F.translate("file_path", "\\", "/")))


def file_of(symbols: DataFrame) -> DataFrame:
    """``id, file_id``: the file symbol of each symbol that has one."""
    named = symbols.select("id", file_id().alias("file_id"))
    return named.join(symbols.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id", "file_id")


def derive_file_edges(symbols: DataFrame, edges: DataFrame, last: Column | None = None) -> DataFrame:
    """A reference between two files for the edges between what lies in them, unless one is told."""
    files = file_of(symbols)
    sf = files.select(F.col("id").alias("source_id"), F.col("file_id").alias("sf"))
    tf = files.select(F.col("id").alias("target_id"), F.col("file_id").alias("tf"))
    # edges are counted per pair of ends first, so a hot end is joined once per source
    ends = edges.where("kind <> 'contains'").groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    pairs = ends.join(sf, "source_id").join(tf, "target_id").where("sf <> tf").groupBy(F.col("sf").alias("source_id"), F.col("tf").alias("target_id")).agg(F.sum("n").alias("n"))
    told = edges.where("kind = 'references' and source_id like 'file:%' and target_id like 'file:%'").select("source_id", "target_id").distinct()
    pairs = pairs.join(told, ["source_id", "target_id"], "left_anti")
    return _inferred(pairs, "references", F.create_map(F.lit("edgeCount"), F.col("n").cast("string")), last)


def build(symbols: DataFrame, edges: DataFrame) -> Graph:
    """Raw ``symbols`` and ``edges`` with an ordinal ``ord`` -> the graph.

    Symbols: the last row of an id holds, but every parent named counts.
    Edges: those with a missing end are dropped, containment is completed,
    equal identities are merged, file references are derived.  Ordinals are
    numbers below ``LAST`` or of any other type that has an order; those of
    inferred edges come last.
    """
    last, kind = None, edges.schema["ord"].dataType
    if kind.simpleString() != "bigint":
        edges = edges.withColumn("ord", F.struct(F.lit(0).alias("inferred"), F.col("ord").alias("at")))
        last = F.struct(F.lit(1).alias("inferred"), F.lit(None).cast(kind).alias("at"))
    syms = upsert_symbols(symbols).withColumn("bucket", path_bucket(F.col("file_path")))
    ids = syms.select("id")
    cols = ["source_id", "target_id", "kind", "role", "evidence", "properties", "call_site", "profiles", "ord"]
    told = edges.withColumn("kind", edge_kind(F.col("kind"))).withColumn("role", edge_role(F.col("properties"))).select(*cols)
    told = drop_dangling(materialize(told, new_folder(edges.sparkSession, "told")), ids)
    made = synthesize_contains(symbols.select("id", "parent_id"), told, last)
    whole = dedup_edges(told.unionByName(made))
    whole = whole.unionByName(derive_file_edges(syms, whole, last))
    return Graph(syms, whole.withColumn("kind_ord", kind_ord(F.col("kind"))))


def canonical_order(edges: DataFrame) -> DataFrame:
    """Edges sorted by source, target, kind and role; a distributed sort."""
    return edges.orderBy("source_id", "target_id", "kind_ord", "role")


def written(g: Graph) -> Graph:
    """The graph written once, so that no reader builds it again."""
    base = new_folder(g.symbols.sparkSession, "graph")
    return Graph(materialize(g.symbols, f"{base}/symbols"), materialize(g.edges, f"{base}/edges"), g.generation)
