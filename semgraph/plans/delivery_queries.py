"""Queries over all delivered rows and documents as they came: repeated ids, several parents, dirt, and incremental runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import table
from semgraph.operators import audits
from semgraph.operators import reads as R
from semgraph.operators.build import Graph, build
from semgraph.operators.validate import validate
from semgraph.plans.graph_queries import _LABEL
from semgraph.plans.graph_source import PREFIX, delivered_edges, delivered_prefix, delivered_symbols, graph
from semgraph.session import materialize, new_folder
from semgraph.sources import graph_json as J
from semgraph.streaming import incremental as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{prefix} {sql}"
        return f

    return add


def _graph(spark: SparkSession, d: str) -> Graph:
    return build(delivered_symbols(spark, d), delivered_edges(spark, d))


@query("select id, name, kind, parent_id, visibility, bucket from s", delivered_prefix())
def delivered_graph_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Of an id told several times the last row holds."""
    return _graph(spark, d).symbols.select("id", "name", "kind", "parent_id", "visibility", "bucket")


@query("select s source_id, t target_id, k kind, role, ord, profiles from e", delivered_prefix())
def delivered_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every parent that an id was told under contains it; of an edge told several times the first holds, with the profiles of all."""
    return _graph(spark, d).edges.select("source_id", "target_id", "kind", "role", "ord", F.array_join("profiles", ",").alias("profiles"))


@query("select t id, count(*) n_parents, array_to_string(list_sort(list(s)), '|') parents from (select distinct s, t from e where k = 'contains') group by 1 having count(*) > 1", delivered_prefix())
def several_parents(spark: SparkSession, d: str) -> DataFrame:
    pairs = _graph(spark, d).contains.select("source_id", "target_id").distinct()
    rows = pairs.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_parents"), F.array_join(F.array_sort(F.collect_set("source_id")), "|").alias("parents"))
    return rows.where("n_parents > 1")


@query("select parent_id, name, count(*) n, array_to_string(list_sort(list(id)), '|') ids from s where kind = 'method' and parent_id is not null group by 1, 2 having count(*) > 1", delivered_prefix())
def overloads(spark: SparkSession, d: str) -> DataFrame:
    return R.overloads(_graph(spark, d))


@query(
    f"""select 'DANGLING_EDGE_SOURCE' code, {_LABEL} subject from rawe where s is not null and s not in (select id from s)
  union all select 'DANGLING_EDGE_TARGET', {_LABEL} from rawe where t is not null and t not in (select id from s)
  union all select 'EMPTY_EDGE_SOURCE', {_LABEL} from rawe where s is null union all select 'EMPTY_EDGE_TARGET', {_LABEL} from rawe where t is null
  union all select 'SELF_REFERENCING_EDGE', {_LABEL} from rawe where s = t and k <> 'calls'
  union all select 'DUPLICATE_EDGE', {_LABEL} from (select *, row_number() over (partition by s, t, k, role order by ord) n from rawe) where n > 1
  union all select 'EMPTY_SYMBOL_ID', coalesce(name, '') from raws where id is null and not is_deleted
  union all select 'DUPLICATE_SYMBOL_ID', id from (select id, row_number() over (partition by id order by loaded_at, row_no, src) n from raws where id is not null and not is_deleted) where n > 1
  union all select 'EMPTY_SYMBOL_NAME', coalesce(id, '') from raws where coalesce(name, '') = '' and not is_deleted
  union all select 'DANGLING_PARENT_ID', coalesce(id, '') from raws where parent_id is not null and not is_deleted and parent_id not in (select id from s)""",
    delivered_prefix(),
)
def validate_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return validate(delivered_symbols(spark, d), delivered_edges(spark, d))


_DOCS = """with docs as (select graph_id, p::json j from (select graph_id, regexp_replace(payload, '^[\\x{FEFF}\\s]+', '') p from graph_documents) where json_valid(p) and json_type(p::json) = 'OBJECT'),
  sy as (select graph_id, generate_subscripts(a, 1) - 1 pos, unnest(a) x from (select graph_id, cast(json_extract(j, '$.symbols') as json[]) a from docs where json_type(j, '$.symbols') = 'ARRAY')),
  raws as (select graph_id, pos, coalesce(x->>'id', '') id, coalesce(x->>'name', '') name, coalesce(x->>'parentId', '') parent_id from sy where json_type(x) = 'OBJECT')"""


@query(
    """select 'EMPTY_SYMBOL_ID' code, name subject from raws where id = '' union all select 'EMPTY_SYMBOL_NAME', id from raws where name = ''
  union all select 'DUPLICATE_SYMBOL_ID', id from (select id, row_number() over (partition by id order by graph_id, pos) n from raws where id <> '') where n > 1
  union all select 'DANGLING_PARENT_ID', id from raws where parent_id <> '' and parent_id not in (select id from raws)""",
    _DOCS,
)
def validate_documents(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the symbols of all received documents together."""
    docs = J.parse(table(spark, d, "graph_documents"), "graph_id", "payload")
    found = validate(J.symbols_of(docs), J.edges_of(docs).limit(0))
    return found.select("code", F.col("subject"))


# --- incremental runs

CUT = "2025-09-01"
_MANIFEST = "(select file_path path, md5(array_to_string(list_sort(list_distinct(list(id))), '|')) h, max(loaded_at) t from symbols where file_path is not null and {where} group by 1)"
_MOVED = f"""moved_{{mode}} as (select b.path from {_MANIFEST.format(where="true")} b left join {_MANIFEST.format(where=f"loaded_at < timestamp '{CUT}'")} a on a.path = b.path where a.path is null or a.h <> b.h{{touched}})"""
_STATUS = {"hash": _MOVED.format(mode="hash", touched=""), "time": _MOVED.format(mode="time", touched=" or a.t < b.t")}


def _drift_sql() -> str:
    rows = "select 'symbol' what, id a, kind b, coalesce(name, '') c, coalesce(parent_id, '') d from s union all select 'edge', s, t, k, role from e"
    tables, parts = [f"g_full as materialized ({delivered_prefix()} {rows})"], []
    for mode, moved in _STATUS.items():
        fits = lambda path: f"(loaded_at < timestamp '{CUT}' or coalesce({path}, '') = '' or {path} in (select path from moved_{mode}))"  # noqa: E731, B023
        tables += [moved, f"g_{mode} as materialized ({delivered_prefix(fits('file_path'), fits('call_site.file_path'))} {rows})"]
        for side, x, y in (("full", "g_full", f"g_{mode}"), ("incremental", f"g_{mode}", "g_full")):
            parts.append(f"select '{mode}' \"mode\", w.what, '{side}' side, coalesce(n, 0) n from (values ('symbol'), ('edge')) w(what) left join (select what, count(*) n from (select * from {x} except all select * from {y}) group by 1) q using (what)")
    return f"with {', '.join(tables)} {' union all '.join(parts)}"


def _parts(rows: DataFrame, path) -> DataFrame:
    """Rows with the file that they belong to; what belongs to none is read anew in every run."""
    return rows.withColumn("part", F.coalesce(path, F.lit("")))


@query(_drift_sql())
def incremental_drift(spark: SparkSession, d: str) -> DataFrame:
    """A graph made of the parts before a day, those of changed files replaced, against one of all parts.

    In mode ``hash`` a file counts as changed if its symbols do, so one whose
    rows changed otherwise is missed and shows as drift; in mode ``time`` also
    if anything in it is newer.
    """
    from semgraph.plans.fact_queries import _manifest

    cut = F.lit(CUT).cast("timestamp")
    symbols = _parts(delivered_symbols(spark, d), F.col("file_path"))
    edges = _parts(delivered_edges(spark, d).join(table(spark, d, "edges").select(F.col("row_no").alias("ord"), "loaded_at"), "ord"), F.col("call_site.file_path"))
    at = F.col("ord.loaded_at")
    base = new_folder(spark, "drift")

    def made(tag: str, s: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
        """What is compared of a graph, built once."""
        g = build(s.drop("part"), e.drop("part", "loaded_at"))
        rows = {"symbol": g.symbols.select("id", "kind", "name", "parent_id"), "edge": g.edges.select("source_id", "target_id", "kind", "role")}
        return {k: materialize(df, f"{base}/{tag}-{k}") for k, df in rows.items()}

    full = made("full", symbols, edges)
    diff = T.manifest_diff(_manifest(spark, d, CUT), _manifest(spark, d, None))
    everything = spark.createDataFrame([("", "", "changed")], diff.select("path", "module", "status").schema)
    found = []
    for mode in ("hash", "time"):
        status = F.when((F.col("status") == "touched") & F.lit(mode == "time"), "changed").otherwise(F.col("status"))
        moved = diff.withColumn("status", status).unionByName(everything)
        inc = made(mode, T.replace_files(symbols.where(at < cut), symbols, moved, "part"), T.replace_files(edges.where(F.col("loaded_at") < cut), edges, moved, "part"))
        for what, a in full.items():
            n = T.drift(a, inc[what], a.columns).groupBy("side").agg(F.count("*").alias("n"))
            sides = spark.createDataFrame([("full",), ("incremental",)], "side string")
            found.append(sides.join(n, "side", "left").select(F.lit(mode).alias("mode"), F.lit(what).alias("what"), "side", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# --- documentation told by documents


_NOTES = "notes as (select symbol_id, arg_max(text, (created_at, doc_id)) filter (where created_at is not null) summary from documents where symbol_id is not null and text <> '' and lower(trim(source)) = 'xmldoc' group by 1)"


def documented(spark: SparkSession, d: str) -> Graph:
    """The graph with the newest doc comment of each symbol as its documentation."""
    g = graph(spark, d)
    notes = table(spark, d, "documents").where("symbol_id is not null and text <> '' and created_at is not null and lower(trim(source)) = 'xmldoc'")
    notes = notes.groupBy(F.col("symbol_id").alias("id")).agg(F.max_by("text", F.struct("created_at", "doc_id")).alias("_summary"))
    rows = g.symbols.join(notes, "id", "left")
    told = F.when(F.col("_summary").isNull(), F.col("properties")).otherwise(F.map_concat(F.map_filter("properties", lambda k, v: k != "xmlDocSummary"), F.create_map(F.lit("xmlDocSummary"), F.col("_summary"))))
    return Graph(rows.withColumn("properties", told).drop("_summary"), g.edges)


_DOCUMENTED = f"{PREFIX}, {_NOTES}, sd as (select s.*, coalesce(n.summary, p['xmlDocSummary']) doc from s left join notes n on n.symbol_id = s.id)"
_CAMEL_OF = "list_transform(string_split(regexp_replace(name, '([^\\p{Lu}])(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: lower(x))"
WORDS = ("shard", "planner", "profile")


@query("select id, coalesce(doc, '') summary from sd where kind in ('type', 'method')", _DOCUMENTED)
def documentation(spark: SparkSession, d: str) -> DataFrame:
    return documented(spark, d).symbols.where("kind in ('type', 'method')").select("id", F.coalesce(F.col("properties")["xmlDocSummary"], F.lit("")).alias("summary"))


@query("select id symbol_id, file_path, line, name display_name, doc documentation from sd where file_path is not null", _DOCUMENTED)
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    s = documented(spark, d).symbols.where("file_path is not null")
    return audits.find_definitions(s.select(F.col("id").alias("symbol_id"), "file_path", "line", F.col("name").alias("display_name"), F.col("properties")["xmlDocSummary"].alias("documentation")))


def _any(test: str) -> str:
    return "(" + " or ".join(test.format(w=w) for w in WORDS) + ")"


_SCORE = " + ".join(f"case when contains(n, '{w}') then 10 else 0 end + case when len(list_filter(camel, lambda x: starts_with(x, '{w}'))) > 0 then 5 else 0 end + case when not contains(n, '{w}') and contains(q, '{w}') then 3 else 0 end + case when contains(lower(doc), '{w}') then 5 else 0 end" for w in WORDS)
_SNIP = "case " + " ".join(f"when contains(lower(doc), '{w}') then case when strpos(lower(doc), '{w}') > 41 then '…' else '' end || substr(doc, greatest(1, strpos(lower(doc), '{w}') - 40), least(length(doc), strpos(lower(doc), '{w}') + {len(w)} + 39) - greatest(1, strpos(lower(doc), '{w}') - 40) + 1) || case when strpos(lower(doc), '{w}') + {len(w)} + 39 < length(doc) then '…' else '' end" for w in WORDS) + " end"


@query(
    f"""select id, kind, name, score, case when hn::int + hq::int + hd::int > 1 then 'Multiple' when hn then 'Name' when hq then 'QualifiedName' else 'XmlDoc' end match_kind,
  array_to_string(list_filter([case when hn then 'name: ' || name end, case when hq then 'qualifiedName: ' || qualified_name end, case when hd then 'xmlDoc: ' || {_SNIP} end], lambda x: x is not null), ' | ') snippets
  from (select *, {_SCORE} score, {_any("contains(n, '{w}')")} hn, {_any("(not contains(n, '{w}') and contains(q, '{w}'))")} hq, {_any("contains(lower(doc), '{w}')")} hd from (select id, kind, name, qualified_name, coalesce(doc, '') doc, lower(name) n, lower(coalesce(qualified_name, '')) q, {_CAMEL_OF} camel from sd where coalesce(name, '') <> ''))
  where score > 0 order by score desc, id limit 20""",
    _DOCUMENTED,
)
def search(spark: SparkSession, d: str) -> DataFrame:
    rows = R.search(documented(spark, d), " ".join(WORDS))
    return rows.withColumn("snippets", F.array_join("snippets", " | "))


@query(
    f"""select id, kind, score + 2 score, match from (select id, kind, {_SCORE} score, case when {_any("contains(lower(doc), '{w}')")} and not {_any("contains(n, '{w}')")} then 'told' else 'named' end match from (select id, kind, name, coalesce(doc, '') doc, lower(name) n, lower(coalesce(qualified_name, '')) q, {_CAMEL_OF} camel from sd where coalesce(name, '') <> '' and kind = 'method')) where score > 0 order by score desc, id limit 2000""",
    _DOCUMENTED,
)
def search_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods only, and whether a documentation or the name was met."""
    rows = R.search(documented(spark, d), " ".join(WORDS), ("method",), 2000)
    named = F.exists("snippets", lambda x: x.startswith("name: "))
    return rows.select("id", "kind", "score", F.when(F.exists("snippets", lambda x: x.startswith("xmlDoc: ")) & ~named, "told").otherwise("named").alias("match"))
