"""The graph of the delivered tables, in Spark and as the SQL prefix of its oracle.

Symbols are the newest living rows of ``symbols`` and ``shared_symbols``,
edges the newest rows of ``edges``. Two properties that the tables lack are
projected: methods below ``tests/`` carry the attribute ``Test``, and modules
whose name has an even length are of direct closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import clean_id, table
from semgraph.operators.analysis import cycles
from semgraph.operators.build import Graph, build, edge_kind, edge_role, written
from semgraph.operators.deliveries import newest, newest_of_few
from semgraph.schema import TEST_ATTRIBUTES
from semgraph.session import materialize, new_folder

_built: dict[tuple, Graph] = {}


def _key(spark: SparkSession, d: str) -> tuple:
    """What the built graph of a folder depends on: the application and the sizes and times of its files."""
    out: list = [spark.sparkContext.applicationId, d]
    for name in ("symbols", "shared_symbols", "edges"):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(out)


def _symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of both symbol tables, properties as entries, ``src`` 0 for the own one."""
    ids = [clean_id("id").alias("id"), "name", "qualified_name", "kind", "file_path", "line", clean_id("parent_id").alias("parent_id"), F.coalesce("visibility", F.lit("internal")).alias("visibility")]
    own = table(spark, d, "symbols").select(*ids, "is_abstract", "is_static", F.map_entries("properties").alias("properties"), "is_deleted", "loaded_at", "row_no", F.lit(0).alias("src"))
    none = F.lit(None)
    shared = table(spark, d, "shared_symbols").select(*ids, none.cast("boolean").alias("is_abstract"), none.cast("boolean").alias("is_static"), none.cast(own.schema["properties"].dataType).alias("properties"), "is_deleted", "loaded_at", "row_no", F.lit(1).alias("src"))
    return own.unionByName(shared)


_ORDER = ["loaded_at", "row_no", "src"]


def _with_properties(rows: DataFrame) -> DataFrame:
    props = F.coalesce(F.map_from_entries("properties"), F.create_map().cast("map<string,string>"))
    test = (F.col("kind") == "method") & F.coalesce(F.col("file_path").startswith("tests/"), F.lit(False))
    direct = (F.col("kind") == "module") & (F.length("name") % 2 == 0)
    tagged = F.map_concat(F.map_filter(props, lambda k, v: k != "attributes"), F.create_map(F.lit("attributes"), F.concat_ws(";", props["attributes"], F.lit("Test"))))
    closed = F.map_concat(F.map_filter(props, lambda k, v: k != "referenceClosure"), F.create_map(F.lit("referenceClosure"), F.lit("DirectOnly")))
    return rows.withColumn("properties", F.when(test, tagged).when(direct, closed).otherwise(props))


def raw_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The newest living row of each id, with ``ord``."""
    rows = _symbol_rows(spark, d)
    rows = newest(rows, "id", _ORDER, [c for c in rows.columns if c not in ("id", *_ORDER)]).where(~F.coalesce("is_deleted", F.lit(False)))
    return _with_properties(rows).withColumn("ord", F.lit(0)).drop("is_deleted")


def delivered_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row that is no deletion, in the order of delivery: an id may be told several times, under several parents."""
    rows = _symbol_rows(spark, d).where(~F.coalesce("is_deleted", F.lit(False)))
    return _with_properties(rows).withColumn("ord", F.struct(*_ORDER)).drop("is_deleted", *_ORDER)


def delivered_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered row, numbered as delivered."""
    cols = [clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), "kind", "evidence", "properties", "call_site", "profiles", F.col("row_no").alias("ord")]
    return table(spark, d, "edges").select(*cols)


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each edge; the edge's number is its ordinal."""
    cols = [clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), "kind", "evidence", F.map_entries("properties").alias("properties"), "call_site", "profiles"]
    rows = table(spark, d, "edges").select("edge_id", *cols, "loaded_at", "row_no")
    last = newest(rows, "edge_id", ["loaded_at", "row_no"], [c for c in rows.columns if c not in ("edge_id", "loaded_at", "row_no")])
    return last.withColumn("properties", F.map_from_entries("properties")).withColumnRenamed("edge_id", "ord")


def graph(spark: SparkSession, d: str) -> Graph:
    """The built graph, written once per application and state of the data folder."""
    key = _key(spark, d)
    if key not in _built:
        _built[key] = written(build(raw_symbols(spark, d), raw_edges(spark, d)))
    return _built[key]


def slim_symbols(spark: SparkSession, d: str) -> DataFrame:
    """``id, kind, face, file_path, parent_id`` of the newest living row of each id, with a number ``no``; written."""
    rows = _symbol_rows(spark, d)
    face = F.exists("properties", lambda p: (p["key"] == "typeKind") & F.coalesce(p["value"] == "interface", F.lit(False)))
    rows = rows.withColumn("face", F.coalesce(face, F.lit(False)))
    rows = newest(rows, "id", _ORDER, ["kind", "face", "file_path", "parent_id", "is_deleted"]).where(~F.coalesce("is_deleted", F.lit(False)))
    return materialize(rows.drop("is_deleted").withColumn("no", F.monotonically_increasing_id()), new_folder(spark, "slim"))


def slim_edges(spark: SparkSession, d: str) -> DataFrame:
    """``source_id, target_id, kind, role`` of the newest row of each edge, dangling ones too."""
    cols = [clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), edge_kind(F.col("kind")).alias("kind"), edge_role(F.col("properties")).alias("role")]
    rows = table(spark, d, "edges").select("edge_id", *cols, "loaded_at", "row_no")
    return newest_of_few(rows, "edge_id", ["loaded_at", "row_no"], ["source_id", "target_id", "kind", "role"]).drop("edge_id")


def marked_symbols(spark: SparkSession, d: str, marks: list | None = None) -> DataFrame:
    """``id, kind, file_path, parent_id, test`` and ``marks``, without any what tests are called, of the newest living row of each id."""
    rows = _symbol_rows(spark, d)
    tagged = F.exists("properties", lambda p: (p["key"] == "attributes") & F.coalesce(F.arrays_overlap(F.split(p["value"], ";"), F.array(*map(F.lit, TEST_ATTRIBUTES))), F.lit(False)))
    test = (F.col("kind") == "method") & (F.coalesce(F.col("file_path").startswith("tests/"), F.lit(False)) | F.coalesce(tagged, F.lit(False)))
    test = F.coalesce(test, F.lit(False))
    text = F.when(test, F.coalesce("qualified_name", "name"))
    rows = rows.select("id", "kind", "file_path", "parent_id", test.alias("test"), *(marks or [text.alias("text")]), "is_deleted", *_ORDER)
    return newest(rows, "id", _ORDER, [c for c in rows.columns if c not in ("id", *_ORDER)]).where(~F.coalesce("is_deleted", F.lit(False))).drop("is_deleted")


def named_edges(spark: SparkSession, d: str) -> DataFrame:
    """``source_id, target_id, kind, role, skip, ord`` of the newest links, dangling ones too; kinds are told apart only as far as references between files go."""
    e = table(spark, d, "edges")
    kind = edge_kind(F.col("kind"))
    rows = e.select("edge_id", clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), F.when(kind == "references", "references").when(kind != "contains", "").alias("kind"), "loaded_at", "row_no")
    last = newest_of_few(rows, "edge_id", ["loaded_at", "row_no"], ["source_id", "target_id", "kind"]).where("kind is not null")
    return last.select("source_id", "target_id", "kind", F.lit("").alias("role"), F.lit(False).alias("skip"), F.lit(0).alias("ord"))


def marked_edges(spark: SparkSession, d: str) -> DataFrame:
    """``source_id, target_id, kind, role, skip, ord`` of the newest row of each edge, dangling ones too; ``skip``: no step of a cycle."""
    cols = [clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), edge_kind(F.col("kind")).alias("kind"), edge_role(F.col("properties")).alias("role")]
    group = F.coalesce(F.col("properties")["initializerOwner"] == "methodGroup", F.lit(False)) & F.coalesce(F.lower("kind") == "references", F.lit(False))
    rows = table(spark, d, "edges").select("edge_id", *cols, group.alias("skip"), "loaded_at", "row_no")
    return newest_of_few(rows, "edge_id", ["loaded_at", "row_no"], ["source_id", "target_id", "kind", "role", "skip"]).withColumnRenamed("edge_id", "ord")


_cycles: dict[tuple, DataFrame] = {}


def cycle_members(spark: SparkSession, d: str) -> DataFrame:
    """The components of the built graph, found once per application and state of the data folder."""
    key = _key(spark, d)
    if key not in _cycles:
        _cycles[key] = materialize(cycles(graph(spark, d)), new_folder(spark, "cycles"))
    return _cycles[key]


_CLEAN = "nullif(replace(trim({}, ' \t'), '\\', '/'), '')"
_GEN = "['obj', 'bin', 'generated']"
_VEN = "['packages', 'packagecache', 'samples', 'samples~', 'sample', 'thirdparty', 'third-party', 'third_party', 'vendor', 'vendored', 'external']"
_BUCKET = f"""case when ends_with(lp, '.g.cs') or contains(lp, '.generated.') or list_has_any(string_split(lp, '/'), {_GEN}) then 'Generated'
    when list_has_any(string_split(lp, '/'), {_VEN}) or len(list_filter(string_split(lp, '/'), lambda x: starts_with(x, 'examples'))) > 0 then 'Vendored'
    when list_contains(string_split(lp, '/'), 'tests') or ends_with(lp, 'tests.cs') or ends_with(lp, 'test.cs') then 'Test'
    when list_contains(string_split(lp, '/'), 'editor') then 'Editor' else 'Production' end"""
_COLS = "name, qualified_name, kind, file_path, line, {parent} parent_id, coalesce(visibility, 'internal') visibility"
#: symbols s, edges with their ends told, identities merged (dd), file edges (fe), all edges e, links l, containment c
PREFIX = f"""with recursive
raws as (select {_CLEAN.format("id")} id, {_COLS.format(parent=_CLEAN.format("parent_id"))}, is_abstract, is_static, properties p, is_deleted, loaded_at, row_no, 0 src from symbols
  union all select {_CLEAN.format("id")}, {_COLS.format(parent=_CLEAN.format("parent_id"))}, null, null, null, is_deleted, loaded_at, row_no, 1 from shared_symbols),
s as materialized (select *, {_BUCKET} bucket, case when kind = 'method' and starts_with(file_path, 'tests/') then coalesce(p['attributes'] || ';', '') || 'Test' else p['attributes'] end attrs,
    kind = 'module' and length(name) % 2 = 0 direct
  from (select *, lower(replace(coalesce(file_path, ''), '\\', '/')) lp, row_number() over (partition by id order by loaded_at desc, row_no desc, src desc) rn from raws where id is not null) where rn = 1 and not is_deleted),
rawe as (select edge_id ord, {_CLEAN.format("source_id")} s, {_CLEAN.format("target_id")} t, case when lower(kind) = 'dependson' then 'dependsOn' else lower(kind) end k,
    coalesce(properties['native.referenceKind'], properties['native.kind'], properties['native.callKind'],
      array_to_string(list_transform(list_sort(map_entries(properties)), lambda x: x.key || '=' || x.value), chr(31)), '') role,
    properties['initializerOwner'] init, properties['edgeCount'] ec, profiles, evidence, call_site
  from edges qualify row_number() over (partition by edge_id order by loaded_at desc, row_no desc) = 1),
told as (select * from rawe where s in (select id from s) and t in (select id from s)),
made as (select parent_id s, id t from s where parent_id is not null and parent_id <> id and parent_id in (select id from s) and (parent_id, id) not in (select s, t from told where k = 'contains')),
dd as materialized (select s, t, k, role, min(ord) ord, arg_min(init, ord) init, arg_min(ec, ord) ec, case when count(profiles) > 0 then array_to_string(list_sort(list_distinct(flatten(list(profiles) filter (where profiles is not null)))), ',') end profiles
  from (select s, t, k, role, ord, init, ec, profiles from told union all select s, t, 'contains', '', 4611686018427387904, null, null, null from made) group by s, t, k, role),
filed as (select a.id, a.f from (select id, case when kind = 'file' then id when coalesce(file_path, '') <> '' then 'file:' || replace(file_path, '\\', '/') end f from s) a where a.f in (select id from s)),
fe as (select a.f s, b.f t, count(*) n from dd join filed a on dd.s = a.id join filed b on dd.t = b.id where k <> 'contains' and a.f <> b.f
  and (a.f, b.f) not in (select s, t from dd where k = 'references' and starts_with(s, 'file:') and starts_with(t, 'file:')) group by 1, 2),
e as materialized (select s, t, k, role, ord, init, ec, profiles from dd union all select s, t, 'references', 'edgeCount=' || n, 4611686018427387904, null, n::varchar, null from fe),
l as (select * from e where k <> 'contains'), c as (select * from e where k = 'contains')"""


def delivered_prefix(keep_symbols: str = "true", keep_edges: str = "true") -> str:
    """The prefix for the graph of all delivered rows (or those that fit) instead of the newest ones."""
    out = PREFIX.replace("from raws where id is not null) where rn = 1 and not is_deleted)", "from raws where id is not null and not is_deleted) where rn = 1)")
    out = out.replace("is_deleted, loaded_at, row_no, 0 src from symbols", f"is_deleted, loaded_at, row_no, 0 src from (select * from symbols where {keep_symbols})")
    out = out.replace("from edges qualify row_number() over (partition by edge_id order by loaded_at desc, row_no desc) = 1)", f"from (select * from edges where {keep_edges}))").replace("select edge_id ord", "select row_no ord")
    out = out.replace("from s where parent_id is not null and parent_id <> id", "from (select distinct id, parent_id from raws where id is not null and not is_deleted) where parent_id is not null and parent_id <> id")
    return out
