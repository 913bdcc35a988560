"""Queries of the general data problems over the delivered tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import clean_id, table
from semgraph.operators.deliveries import newest
from semgraph.operators.diff import table_diff
from semgraph.operators.flatten import flat_tables, json_triples, unusable_records
from semgraph.operators.hierarchy import descendants, hierarchy
from semgraph.operators.hot_keys import CHUNK_ROWS, chunk_states, per_key_counts
from semgraph.operators.orphans import current_orphans, orphan_references, orphans_by_period

ARRIVAL = ["loaded_at", "row_no"]


def living_symbols(spark: SparkSession, d: str) -> DataFrame:
    """``id, parent`` of the ids whose newest row is not deleted."""
    rows = table(spark, d, "symbols").select(clean_id("id").alias("id"), clean_id("parent_id").alias("parent"), "is_deleted", *ARRIVAL)
    return newest(rows, "id", ARRIVAL, ["parent", "is_deleted"]).where(~F.coalesce("is_deleted", F.lit(False))).select("id", "parent")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(living_symbols(spark, d)).drop("on_cycle")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path from the root, or from a cycle, to each symbol, ids joined by `` > ``."""
    tree = hierarchy(living_symbols(spark, d), with_paths=True)
    return tree.select("id", F.array_join("path", " > ").alias("path"), "on_cycle")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol and each symbol above it; a cycle stands under its smallest id."""
    return descendants(hierarchy(living_symbols(spark, d), with_paths=True))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of ``edges`` and ``symbols``; ``ref``: 0 source_id, 1 target_id, 2 parent_id."""
    edges = table(spark, d, "edges").select("row_no", "loaded_at", "source_id", "target_id")
    ends = edges.select("row_no", "loaded_at", F.posexplode(F.array("source_id", "target_id")).alias("ref", "key"))
    parents = table(spark, d, "symbols").where(~F.coalesce("is_deleted", F.lit(False))).select("row_no", "loaded_at", F.lit(2).alias("ref"), F.col("parent_id").alias("key"))
    return ends.unionByName(parents).select(F.col("ref").cast("byte").alias("ref"), clean_id("key").alias("key"), "loaded_at", "row_no")


def _records(spark: SparkSession, d: str) -> DataFrame:
    cols = [clean_id("id").alias("key"), "loaded_at", "row_no", "is_deleted"]
    return table(spark, d, "symbols").select(*cols).unionByName(table(spark, d, "shared_symbols").select(*cols))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_references(_records(spark, d), _references(spark, d))
    month = F.col("month")
    return found.select(
        F.when(F.col("ref") == 2, "symbols").otherwise("edges").alias("ref_table"),
        "row_no",
        F.when(F.col("ref") == 0, "source_id").when(F.col("ref") == 1, "target_id").otherwise("parent_id").alias("ref_field"),
        F.concat(F.floor(month / 100).cast("string"), F.lit("-"), F.lpad((month % 100).cast("string"), 2, "0")).alias("load_month"),
        "ref_state",
    )


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, month and state."""
    return p2_found(spark, d).groupBy("ref_table", "ref_field", "load_month", "ref_state").agg(F.count("*").alias("n_references"))


def _counts(spark: SparkSession, d: str) -> list[tuple[int, DataFrame]]:
    refs = _references(spark, d).select(F.when(F.col("ref") == 2, "symbols").otherwise("edges").alias("ref_table"), "key", "loaded_at")
    return orphans_by_period(_records(spark, d), refs, ["edges", "symbols"])


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referenced now and do not exist now, from signed counts kept over the months of delivery."""
    return current_orphans(_counts(spark, d)[-1][1])


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    """The orphan report as it stood after each month: keys without a record and the references to them, per table."""
    parts = []
    for m, counts in _counts(spark, d):
        orphans = counts.where("n_existing <= 0").select(F.explode(F.array(*[F.struct(F.lit(t).alias("ref_table"), F.col(f"n_{t}").alias("n")) for t in ("edges", "symbols")])).alias("r"))
        found = orphans.where("r.n > 0").groupBy("r.ref_table").agg(F.count("*").alias("n_keys"), F.sum("r.n").alias("n_references"))
        parts.append(found.select(F.lit(f"{m // 100}-{m % 100:02}").alias("month"), "ref_table", "n_keys", "n_references"))
    return reduce(DataFrame.unionByName, parts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = [clean_id("source_id").alias("source_id"), clean_id("target_id").alias("target_id"), F.nullif(F.lower("kind"), F.lit("")).alias("kind")]
    a = table(spark, d, "edges").select("edge_id", *fields, "loaded_at", "row_no")
    b = table(spark, d, "edge_copy").select("edge_id", *fields, "synced_at", "copy_row")
    found = table_diff(a, b, "edge_id", ["source_id", "target_id", "kind"], ["loaded_at", "row_no"], ["synced_at", "copy_row"], "only_in_edges", "only_in_copy")
    return found.withColumnRenamed("key", "edge_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = json_triples(table(spark, d, "graph_documents"), "graph_id", "payload")
    return rows.select(F.col("record_id").alias("graph_id"), "record_type", "owner_pos", "field_path")


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return flat_tables(json_triples(table(spark, d, "graph_documents"), "graph_id", "payload", rows=True))


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables; a row's key and its fields, ``name:type=value``, as text."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    entry = lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit("="), e["value"]["value"])
    return _flat(spark, d).select(
        F.col("record_id").alias("graph_id"), "record_type", "owner_pos", "table_name", text("ordinals").alias("ordinals"), "parent_name",
        text("parent_ordinals").alias("parent_ordinals"), F.array_join(F.array_sort(F.transform(F.map_entries("fields"), entry)), "\u001f").alias("fields"),
        F.size(F.coalesce("retold", F.array())).alias("n_retold"),
    )


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Per table its rows and those whose parent row is found by its key; the two differ only in tables of parts, which have no parent."""
    flat = _flat(spark, d).select("record_id", "record_type", "owner_pos", "table_name", "ordinals", "parent_name", "parent_ordinals")
    key = ["record_id", "record_type", "owner_pos"]
    above = flat.select(*key, F.col("table_name").alias("parent_name"), F.col("ordinals").alias("parent_ordinals"), F.lit(1).alias("found"))
    met = flat.join(above, [*key, "parent_name", "parent_ordinals"], "left")
    return met.groupBy("record_type", "table_name").agg(F.count("*").alias("n_rows"), F.count("found").alias("n_with_parent"))


def p4_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose payload is not one complete JSON object."""
    return unusable_records(json_triples(table(spark, d, "graph_documents"), "graph_id", "payload", rows=True)).select(F.col("record_id").alias("graph_id"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges").select(clean_id("target_id").alias("target_id"), clean_id("source_id").alias("source_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    counts = per_key_counts(_targets(spark, d), "target_id", "source_id")
    return counts.select(F.col("key").alias("target_id"), F.col("n_rows").alias("n_edges"), F.col("n_values").alias("n_sources"))


def p5_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How the distinct rows of each target were cut: chunks, the most in one, the rows behind them and new sources, merged per key."""
    states = chunk_states(_targets(spark, d), "target_id", "source_id")
    return states.groupBy(F.col("key").alias("target_id")).agg(
        F.count("*").alias("n_chunks"), F.max("n_distinct").alias("largest"), F.max(F.col("first_row") + F.col("n_rows")).alias("last_row"), F.sum("n_values").alias("n_sources")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p2_found, p2_report, p2_current, p2_periods, p3_found, p4_found, p4_tables, p4_links, p4_rejects, p5_found, p5_chunks)}

_CLEAN = "nullif(replace(trim({}, ' \t'), '\\', '/'), '')"
_ID, _PARENT, _SOURCE, _TARGET = (_CLEAN.format(c) for c in ("id", "parent_id", "source_id", "target_id"))
_LIVING = f"""living as (select id, parent from (select {_ID} id, {_PARENT} parent, is_deleted,
    row_number() over (partition by {_ID} order by loaded_at desc, row_no desc) rn from symbols where {_ID} is not null) where rn = 1 and not is_deleted),
  tree as (select a.id, b.id parent from living a left join living b on a.parent = b.id)"""
#: paths that begin at roots and at nodes of cycles, which are cut out of their cycles
_RINGS = f"""{_LIVING}, climb(id, a, step) as (select id, id, 0 from tree union all select c.id, t.parent, c.step + 1 from climb c join tree t on c.a = t.id where t.parent is not null and c.step < 300),
  ring as (select distinct id from climb where a = id and step > 0), least as (select id, min(a) least from climb where id in (select id from ring) group by id),
  ways(id, path) as (select id, id from tree where parent is null or id in (select id from ring) union all select t.id, w.path || ' > ' || t.id from ways w join tree t on t.parent = w.id where t.id not in (select id from ring))"""
_REFS = f"""refs as (select 'edges' ref_table, row_no, 'source_id' ref_field, {_SOURCE} k, loaded_at from edges
    union all select 'edges', row_no, 'target_id', {_TARGET}, loaded_at from edges
    union all select 'symbols', row_no, 'parent_id', {_PARENT}, loaded_at from symbols where not is_deleted),
  recs as (select {_ID} k, loaded_at, row_no, is_deleted from symbols union all select {_ID}, loaded_at, row_no, is_deleted from shared_symbols)"""
_P2 = f"""{_REFS}, looked as (select r.ref_table, r.row_no, r.ref_field, r.loaded_at, count(s.k) n, count(s.k) filter (where s.loaded_at <= r.loaded_at) n_before,
    arg_max(s.is_deleted, (s.loaded_at, s.row_no)) filter (where s.loaded_at <= r.loaded_at) gone from refs r left join recs s on r.k = s.k where r.k is not null group by all),
  found as (select ref_table, row_no, ref_field, strftime(loaded_at, '%Y-%m') load_month, case when n = 0 then 'missing' when n_before = 0 then 'late' when gone then 'deleted' end ref_state from looked)"""

_P4 = """docs as (select graph_id, p::json j from (select graph_id, regexp_replace(payload, '^[\\x{FEFF}\\s]+', '') p from graph_documents) where json_valid(p) and json_type(p::json) = 'OBJECT'),
  owned as (select graph_id, 'property' record_type, generate_subscripts(a, 1) - 1 owner_pos, unnest(a) x from (select graph_id, cast(json_extract(j, '$.symbols') as json[]) a from docs where json_type(j, '$.symbols') = 'ARRAY')
    union all select graph_id, 'evidence', generate_subscripts(a, 1) - 1, unnest(a) from (select graph_id, cast(json_extract(j, '$.edges') as json[]) a from docs where json_type(j, '$.edges') = 'ARRAY')),
  parts as materialized (select row_number() over () n, * from (select graph_id, 'adapter' record_type, 0::bigint owner_pos, json_extract(j, '$.adapter') v from docs
    union all select graph_id, record_type, owner_pos, json_extract(x, case record_type when 'property' then '$.properties' else '$.evidence' end) from owned where json_type(x) = 'OBJECT') where v is not null),
  nodes as materialized (select p.n, t.id, t.parent, t.key, t.type, t.value from parts p, lateral (select * from json_tree(p.v)) t)"""
#: every element of an array is a row; what lies deeper without an array between is a field of it
_P4_ROWS = f"""{_P4}, named as (select *, coalesce(nullif(replace(replace(replace(replace(key, '\\', '\\\\'), '.', '\\d'), '[', '\\l'), ']', '\\r'), ''), '\\e') safe from nodes),
  walk(n, id, type, value, tbl, ords, up, up_ords, fld) as (select n, id, type, value, '', '', null::varchar, null::varchar, '' from named where parent is null
    union all select w.n, c.id, c.type, c.value, case when w.type = 'ARRAY' then w.tbl || w.fld || '[]' else w.tbl end, case when w.type = 'ARRAY' then case when w.ords = '' then c.key else w.ords || ',' || c.key end else w.ords end,
      case when w.type = 'ARRAY' then w.tbl else w.up end, case when w.type = 'ARRAY' then w.ords else w.up_ords end, case when w.type = 'ARRAY' then '' when w.fld = '' then c.safe else w.fld || '.' || c.safe end
      from walk w join named c on c.n = w.n and c.parent = w.id),
  told as (select graph_id, record_type, owner_pos::int owner_pos, tbl table_name, ords ordinals, up parent_name, up_ords parent_ordinals, fld, type, value from walk join parts using (n) where type <> 'NULL' and (type not in ('OBJECT', 'ARRAY') or fld = '')),
  flat as (select graph_id, record_type, owner_pos, table_name, ordinals, parent_name, parent_ordinals,
      coalesce(string_agg(fld || ':' || case when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' else 'number' end || '=' || (value->>'$'), chr(31) order by fld) filter (where type not in ('OBJECT', 'ARRAY')), '') fields from told group by all)"""

SQL = {
    "p4_tables": f"with recursive {_P4_ROWS} select *, 0 n_retold from flat",
    "p4_links": f"with recursive {_P4_ROWS} select record_type, table_name, count(*) n_rows, count(parent_name) n_with_parent from flat group by 1, 2",
    "p4_rejects": "select graph_id from (select graph_id, regexp_replace(payload, '^[\\x{FEFF}\\s]+', '') p from graph_documents) where coalesce(not json_valid(p) or json_type(try_cast(p as json)) <> 'OBJECT', true)",
    "p1_found": f"""with recursive {_LIVING}, above(id, anc, step) as (select id, id, 0 from tree union all select a.id, t.parent, a.step + 1 from above a join tree t on a.anc = t.id where t.parent is not null and a.step < 1000),
  pairs as (select id, anc, min(step) step, max(step) far from above group by all),
  kind as (select id, max(far) >= 1000 endless, max(step) depth, min(anc) filter (where far > 600) ring, arg_max(anc, step) top from pairs group by id),
  below as (select anc id, count(distinct id) - 1 n from pairs group by anc)
  select k.id, case when endless then ring else top end root_id, (case when endless then -1 else depth end)::int tree_depth, b.n n_below from kind k join below b on k.id = b.id""",
    "p1_paths": f"""with recursive {_RINGS} select id, path, id in (select id from ring) on_cycle from ways""",
    "p1_descendants": f"""with recursive {_RINGS}, named as (select w.id, string_split(w.path, ' > ') p, r.least from ways w left join least r on r.id = string_split(w.path, ' > ')[1])
  select coalesce(case when i = 1 then least end, p[i]) ancestor_id, id, (len(p) - i)::int distance from named, lateral (select unnest(generate_series(1, len(p))) i) where i < len(p) or (id in (select id from ring) and id <> least)""",
    "p4_found": f"""with recursive {_P4},
  walk(n, id, type, path) as (select n, id, type, '' from nodes where parent is null
    union all select w.n, c.id, c.type, case when w.type = 'ARRAY' then w.path || '[' || c.key || ']' when w.path = '' then c.key else w.path || '.' || c.key end from walk w join nodes c on c.n = w.n and c.parent = w.id)
  select graph_id, record_type, owner_pos::int owner_pos, path field_path from walk join parts using (n) where type not in ('OBJECT', 'ARRAY', 'NULL')""",
    "p2_found": f"with {_P2} select * from found where ref_state is not null",
    "p2_report": f"with {_P2} select ref_table, ref_field, load_month, ref_state, count(*) n_references from found where ref_state is not null group by all",
    "p2_current": f"""with {_REFS}, alive as (select k from recs group by k having not arg_max(is_deleted, (loaded_at, row_no)))
  select k as key, count(*) n_references from refs where k is not null and k not in (select k from alive where k is not null) group by k""",
    "p2_periods": f"""with {_REFS}, months as (select distinct strftime(loaded_at, '%Y-%m') m from (select loaded_at, k from refs union all select loaded_at, k from recs) where k is not null),
  grid as (select k, m from (select distinct k from refs where k is not null), months),
  cum as (select g.k, g.m, r.ref_table, count(*) n from grid g join refs r on r.k = g.k and strftime(r.loaded_at, '%Y-%m') <= g.m group by all),
  gone as (select g.k, g.m from grid g left join recs r on r.k = g.k and strftime(r.loaded_at, '%Y-%m') <= g.m group by all having coalesce(arg_max(r.is_deleted, (r.loaded_at, r.row_no)) filter (where r.k is not null), true))
  select m as "month", ref_table, count(*) n_keys, sum(n)::bigint n_references from cum join gone using (k, m) group by 1, 2""",
    "p3_found": f"""with a as (select edge_id, {_SOURCE} s, {_TARGET} t, nullif(lower(kind), '') k from edges qualify row_number() over (partition by edge_id order by loaded_at desc, row_no desc) = 1),
  b as (select edge_id, {_SOURCE} s, {_TARGET} t, nullif(lower(kind), '') k from edge_copy qualify row_number() over (partition by edge_id order by synced_at desc, copy_row desc) = 1)
  select edge_id, 'only_in_edges' finding from a where edge_id not in (select edge_id from b) union all select edge_id, 'only_in_copy' from b where edge_id not in (select edge_id from a)
  union all select a.edge_id, 'source_id' from a join b using (edge_id) where a.s is distinct from b.s
  union all select a.edge_id, 'target_id' from a join b using (edge_id) where a.t is distinct from b.t
  union all select a.edge_id, 'kind' from a join b using (edge_id) where a.k is distinct from b.k""",
    "p5_found": f"select {_TARGET} target_id, count(*) n_edges, count(distinct {_SOURCE}) n_sources from edges where {_TARGET} is not null group by 1",
    "p5_chunks": f"""select t target_id, (count(*) + {CHUNK_ROWS} - 1) // {CHUNK_ROWS} n_chunks, least(count(*), {CHUNK_ROWS}) largest, sum(n)::bigint last_row, count(s) n_sources
  from (select {_TARGET} t, {_SOURCE} s, count(*) n from edges where {_TARGET} is not null group by 1, 2) group by 1""",
}
