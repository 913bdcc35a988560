"""Queries of audits, documents and change handling over facts projected from the delivered tables, and their SQL.

Call sites of edges are reference facts; members of types come from
containment; reads, writes, subscriptions and calls are told by the kind of
the link that comes in. The projections serve to run the verdicts at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import table
from semgraph.operators import audits as A
from semgraph.plans.graph_source import PREFIX, graph, raw_edges
from semgraph.session import new_folder
from semgraph.sources import graph_json as J
from semgraph.streaming import incremental as T
from semgraph.tools import module_order as order_of_modules
from semgraph.tools import static_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", prefix: str = PREFIX):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{prefix}{more} {sql}"
        return f

    return add


def _sites(spark: SparkSession, d: str) -> DataFrame:
    e = raw_edges(spark, d).where("call_site is not null and target_id is not null")
    return e.select("target_id", "call_site.file_path", "call_site.line", "call_site.col", "call_site.containing_symbol_id", F.col("source_id"), F.col("ord").alias("site_id"))


_REF = ", rf as (select t, call_site.file_path f, call_site.line ln, call_site.col cl, call_site.containing_symbol_id cs from rawe where call_site is not null and t is not null), fr as (select t, f, ln, coalesce(nullif(cs, ''), ':col' || cl) place, min(cl) cl from rf group by 1, 2, 3, 4)"


@query("select t target_id, f file_path, ln line, place, cl col, false is_declaration from fr", _REF)
def find_references(spark: SparkSession, d: str) -> DataFrame:
    return A.find_references(_sites(spark, d))


@query("select distinct t target_id, f file_path, ln line, cl col, length(name) length, name || 'New' new_text from fr join s on s.id = fr.t where s.kind = 'method'", _REF)
def rename(spark: SparkSession, d: str) -> DataFrame:
    names = graph(spark, d).symbols.where("kind = 'method'").select(F.col("id").alias("target_id"), "name")
    return A.rename_edits(_sites(spark, d), names, F.concat("name", F.lit("New")))


@query("select root, node from walk where node <> root", ", im as (select distinct t a, s b from e where k in ('implements', 'inherits', 'overrides')), walk(root, node) as (select a, b from im where a in (select id from s where kind = 'type') union select w.root, im.b from walk w join im on w.node = im.a)")
def find_implementations(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.find_implementations(g, g.symbols.where("kind = 'type'").select("id"))


_ENUM = ", em as (select distinct c.s enum_id, c.t member_id from c join s on s.id = c.s and s.kind = 'type' and s.p['typeKind'] = 'enum'), er as (select l.t, case l.role when 'returnType' then 'produced' when 'parameterType' then 'comparison' when 'localType' then 'switch' else 'other' end cls, l.k = 'overrides' tab from l)"


@query(
    "select enum_id, em.member_id, total, produced, comparison, switch, dispatch, case when total = 0 then 'unreferenced' when produced = 0 then 'unproduced' else 'covered' end verdict from em join (select member_id, count(er.t) total, count(*) filter (where cls = 'produced') produced, count(*) filter (where cls = 'comparison') comparison, count(*) filter (where cls = 'switch') switch, count(*) filter (where tab) dispatch from (select distinct member_id from em) m left join er on er.t = m.member_id group by 1) q on q.member_id = em.member_id",
    _ENUM,
)
def enum_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    enums = g.symbols.where("kind = 'type' and properties['typeKind'] = 'enum'").select(F.col("id").alias("source_id"))
    members = g.contains.join(enums, "source_id", "left_semi").select(F.col("source_id").alias("enum_id"), F.col("target_id").alias("member_id")).distinct()
    site = F.when(F.col("role") == "returnType", "produced").when(F.col("role") == "parameterType", "comparison").when(F.col("role") == "localType", "switch").otherwise("other")
    refs = g.links.select(F.col("target_id").alias("member_id"), site.alias("site_class"), (F.col("kind") == "overrides").alias("in_static_table"))
    return A.enum_coverage(members, refs)


def _accesses(g) -> DataFrame:
    word = F.when(F.col("kind") == "references", "read").when(F.col("kind") == "calls", "write").when(F.col("kind") == "dependsOn", "subscribe").otherwise("fire")
    return g.links.select(F.col("target_id").alias("member_id"), word.alias("access"))


@query(
    """select unnest(list_filter([case when w + ini = 0 and r > 0 and kind = 'field' then 'FieldReadWithoutWrite' end, case when w + ini = 0 and ft = 'object' then 'DelegateSlotNeverAssigned' end, case when kind = 'property' and su > 0 and fi = 0 then 'EventSubscribedNeverRaised' end, case when kind = 'property' and su = 0 and fi > 0 then 'EventRaisedNeverSubscribed' end], lambda x: x is not null)) finding, id member_id, file_path, line from ac""",
    ", ac as (select s.id, s.kind, s.file_path, s.line, (s.p['constantValue'] is not null)::int ini, coalesce(s.p['fieldType'], '') ft, count(l.s) filter (where l.k = 'references') r, count(l.s) filter (where l.k = 'calls') w, count(l.s) filter (where l.k = 'dependsOn') su, count(l.s) filter (where l.k not in ('references', 'calls', 'dependsOn')) fi from s left join l on l.t = s.id where s.kind in ('field', 'property') group by all)",
)
def wire_audit(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    c = g.symbols.where("kind in ('field', 'property')").select(
        F.col("id").alias("member_id"), "file_path", "line", (F.coalesce(F.col("properties")["fieldType"], F.lit("")) == "object").alias("is_delegate"), (F.col("kind") == "property").alias("is_event"),
        (F.col("kind") == "field").alias("is_rw_candidate"), F.col("properties")["constantValue"].isNotNull().alias("has_initializer"),
    )
    return A.wire_audit(c, _accesses(g))


@query(
    "select m.id member_id, coalesce(f.n, 0) n_flips, case when f.n is null then 'AlwaysDefaultInGraph' when f.live then 'RuntimeMutable' else 'TestOnlyActivation' end verdict from bm m left join (select l.t, count(*) n, bool_or(x.bucket = 'Production') live from l join s x on x.id = l.s join bm on bm.id = l.t where l.k = 'calls' and (x.bucket <> 'Production' or x.id in (select t from l where k = 'calls')) group by 1) f on f.t = m.id where m.id in (select t from l where k = 'references')",
    ", bm as (select id from s where kind in ('field', 'property') and coalesce(p['fieldType'], p['propertyType'], '') = 'bool')",
)
def feature_switch_audit(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    members = g.symbols.where("kind in ('field', 'property') and coalesce(properties['fieldType'], properties['propertyType'], '') = 'bool'").select(F.col("id").alias("member_id"), F.lit(False).alias("default_value"))
    calls = g.edges.where("kind = 'calls'")
    writes = calls.join(g.symbols.select(F.col("id").alias("source_id"), "bucket"), "source_id").select(F.col("target_id").alias("member_id"), F.col("source_id").alias("containing_member_id"), F.lit("method").alias("containing_kind"), "bucket", F.lit(None).cast("boolean").alias("assigned_value"))
    callers = calls.groupBy(F.col("target_id").alias("member_id")).agg(F.count("*").alias("n"))
    return A.feature_switch_audit(members, writes, g.edges.where("kind = 'references'").select(F.col("target_id").alias("member_id")), callers)


@query(
    "select h type_id, count(*) filter (where kind <> 'type') reflection_declared, count(*) filter (where not imp) source_symbols, count(*) filter (where is_static) statics, count(*) filter (where not imp and kind = 'method') n_method, count(*) filter (where not imp and kind = 'field') n_field, count(*) filter (where not imp and kind = 'property') n_property, 0::bigint n_event, 0::bigint n_constructor from mb group by 1",
    ", mb as (select distinct c.s h, x.id, x.kind, x.is_static, coalesce(x.p['synthesized'], '') = 'true' imp from c join s x on x.id = c.t join s h on h.id = c.s and h.kind = 'type')",
)
def member_count(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    types = g.symbols.where("kind = 'type'").select(F.col("id").alias("source_id"))
    m = g.contains.select("source_id", "target_id").distinct().join(types, "source_id", "left_semi").join(g.symbols.withColumnRenamed("id", "target_id"), "target_id")
    return A.member_count(m.select(F.col("source_id").alias("type_id"), F.col("kind").alias("member_kind"), "is_static", (F.coalesce(F.col("properties")["synthesized"], F.lit("")) == "true").alias("is_implicit"), F.lit(False).alias("is_accessor")))


@query("select parent_id type_id, 'constants' table_id, rn - 1 row_no, n n_rows, name || '=' || v cells from (select parent_id, name, p['constantValue'] v, row_number() over (partition by parent_id order by id) rn, count(*) over (partition by parent_id) n from s where kind = 'field' and parent_id is not null and p['constantValue'] is not null)")
def static_tables(spark: SparkSession, d: str) -> DataFrame:
    """The constants of each type as a table of name and value."""
    rows = A.static_tables(static_rows(graph(spark, d)))
    cells = F.array_join(F.transform("cells", lambda c: F.regexp_replace(c, "^[a-z]+:", "")), "=")
    return rows.select("type_id", "table_id", "row_no", "n_rows", cells.alias("cells"))


_MOD_DEPS = ", md as (select distinct e.s, e.t from e join s a on a.id = e.s and a.kind = 'module' join s b on b.id = e.t and b.kind = 'module' where e.k = 'dependsOn')"


@query(
    "select id, max(n)::int as level from cm join lv on lv.c = cm.c group by id",
    _MOD_DEPS + ", rc(a, b) as (select s, t from md where s <> t union select r.a, m.t from rc r join md m on m.s = r.b), cm as materialized (select x.id, coalesce((select greatest(max(r.b), x.id) from rc r where r.a = x.id and exists (select 1 from rc q where q.a = r.b and q.b = x.id)), x.id) c from s x where x.kind = 'module'), ce as (select distinct a.c a, b.c b from md join cm a on a.id = md.s join cm b on b.id = md.t where a.c <> b.c), lv(c, n) as (select distinct c, 0 from cm union select ce.a, lv.n + 1 from lv join ce on ce.b = lv.c)",
)
def module_order(spark: SparkSession, d: str) -> DataFrame:
    """Modules by the longest chain of dependencies below them."""
    return order_of_modules(graph(spark, d))


#: fixed values: sizes of primitives in bytes
SIZES = {"bool": 1, "int": 4, "long": 8, "double": 8, "byte[]": 8, "string": 8, "object": 8}


_SIZES = "case p['fieldType'] when 'bool' then 1 when 'int' then 4 when 'long' then 8 when 'double' then 8 when 'byte[]' then 8 when 'string' then 8 when 'object' then 8 end"


@query(
    "select type_id, (((arg_max(fin, o) + arg_max(mx, o) - 1) // arg_max(mx, o)) * arg_max(mx, o))::int size, arg_max(mx, o)::int alignment, arg_max(offs, o) offsets, case when bool_and(ex) then 'Exact' else 'Advisory' end exactness from lay join fd using (type_id, o) group by 1",
    f", fd as materialized (select parent_id type_id, row_number() over (partition by parent_id order by o0) o, sz, p['fieldType'] not in ('string', 'object', 'byte[]') ex from (select parent_id, p, {_SIZES} sz, row_number() over (partition by parent_id order by coalesce(line, 0), id) o0 from s where kind = 'field' and parent_id is not null and p['fieldType'] is not null) where sz is not null), lay(type_id, o, fin, mx, offs) as (select type_id, o, sz, sz, '0' from fd where o = 1 union all select l.type_id, f.o, ((l.fin + f.sz - 1) // f.sz) * f.sz + f.sz, greatest(l.mx, f.sz), l.offs || ',' || ((l.fin + f.sz - 1) // f.sz) * f.sz from lay l join fd f on f.type_id = l.type_id and f.o = l.o + 1)",
)
def struct_layout(spark: SparkSession, d: str) -> DataFrame:
    """Types with fields as if they were structs; fields in order of line and id."""
    from pyspark.sql import Window

    g = graph(spark, d)
    sizes = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])
    f = g.symbols.where("kind = 'field' and parent_id is not null and properties['fieldType'] is not null")
    n = F.row_number().over(Window.partitionBy("parent_id").orderBy(F.coalesce("line", F.lit(0)), "id"))
    size = sizes[F.col("properties")["fieldType"]]
    f = f.select(F.col("parent_id").alias("type_id"), n.alias("ordinal"), "name", size.alias("size"), size.alias("alignment"), (~F.col("properties")["fieldType"].isin("string", "object", "byte[]")).alias("is_exact"), F.lit(None).cast("int").alias("explicit_offset"))
    return A.struct_layout(f.where("size is not null"))


@query(
    """select q.file_path, q.line, q.col, arg_min(sp.id, (sp.b - sp.a, -sp.a, -sp.ca, sp.id)) symbol_id
  from (select distinct file_path, line + d line, c col from s, (values (0, 3), (0, null), (1, 5), (20, 90)) w(d, c) where kind = 'method' and file_path is not null and line is not null) q
  left join sp on sp.file_path = q.file_path and q.line between sp.a and sp.b and (q.col is null or ((q.line > sp.a or q.col >= sp.ca) and (q.line < sp.b or q.col <= sp.cb))) group by 1, 2, 3""",
    ", sp as (select id, file_path, line a, length(name) % 8 ca, line + case when kind = 'type' then 500 else 20 end b, 80 cb from s where file_path is not null and line is not null and kind in ('type', 'method', 'property', 'field'))",
)
def symbol_at_position(spark: SparkSession, d: str) -> DataFrame:
    """Four places around each method; spans begin at a column told by the name and end at column 80."""
    s = graph(spark, d).symbols.where("file_path is not null and line is not null and kind in ('type', 'method', 'property', 'field')")
    spans = s.select(F.col("id").alias("symbol_id"), "file_path", F.col("line").alias("start_line"), (F.length("name") % 8).alias("start_col"), (F.col("line") + F.when(F.col("kind") == "type", 500).otherwise(20)).alias("end_line"), F.lit(80).alias("end_col"))
    places = F.array(*[F.struct((F.col("line") + n).alias("line"), F.lit(c).cast("int").alias("col")) for n, c in ((0, 3), (0, None), (1, 5), (20, 90))])
    at = s.where("kind = 'method'").select("file_path", F.explode(places).alias("p")).select("file_path", "p.line", "p.col")
    return A.symbol_at_position(spans, at)


@query(
    "select t target_id, ordinal, parameter_name, count(*) filter (where sup) n_supplied, count(*) filter (where not sup) n_omitted from ca group by 1, 2, 3",
    ", ca as (select t, o.ordinal, 'p' || o.ordinal parameter_name, (ord + o.ordinal) % 3 <> 0 sup from rawe, (values (0), (1)) o(ordinal) where call_site is not null and t is not null and k = 'calls')",
)
def callsite_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Two parameters per called target, the second given at two sites of three."""
    return A.callsite_arguments(_call_facts(spark, d))[1]


def _call_facts(spark: SparkSession, d: str) -> DataFrame:
    calls = _sites(spark, d).join(raw_edges(spark, d).where("lower(kind) = 'calls'").select(F.col("ord").alias("site_id")), "site_id", "left_semi")
    facts = calls.select("target_id", "site_id", "source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    return facts.select("target_id", "site_id", "ordinal", F.concat(F.lit("p"), "ordinal").alias("parameter_name"), ((F.col("site_id") + F.col("ordinal")) % 3 != 0).alias("supplied"), F.repeat(F.concat(F.lit("see "), F.coalesce("source_id", F.lit(""))), F.lit(3)).alias("raw_text"))


@query(
    "select t target_id, ord site_id, ordinal, 'p' || ordinal parameter_name, sup supplied, case when length(x) > 160 then left(x, 159) || '…' else x end text, count(distinct ord) over (partition by t) n_sites from ca",
    ", ca as (select t, ord, o.ordinal, (ord + o.ordinal) % 3 <> 0 sup, repeat('see ' || coalesce(s, ''), 3) x from rawe, (values (0), (1)) o(ordinal) where call_site is not null and t is not null and k = 'calls')",
)
def callsite_argument_rows(spark: SparkSession, d: str) -> DataFrame:
    """The arguments of all call sites; long ones are clipped."""
    return A.callsite_arguments(_call_facts(spark, d))[0]


@query(
    "select t type_id, ord site_id, x.id slot, case when wr is null then 'Absent' when wr then 'AssignedNull' else 'Assigned' end state, '' limitations, 'Proven' confidence from st join s x on x.parent_id = st.t and x.kind in ('field', 'property') left join lateral (select case when (ord + length(x.name)) % 4 = 0 then null else (ord + length(x.name)) % 4 = 1 end wr) on true",
    ", st as (select ord, t from rawe where t in (select id from s where kind = 'type'))",
)
def assignment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Edges to types as construction sites, fields as slots; a slot is written by a rule of the numbers."""
    g = graph(spark, d)
    types = g.symbols.where("kind = 'type'").select(F.col("id").alias("type_id"))
    sites = raw_edges(spark, d).select(F.col("ord").alias("site_id"), F.col("target_id").alias("type_id")).join(types, "type_id", "left_semi")
    slots = g.symbols.where("kind in ('field', 'property')").select(F.col("parent_id").alias("type_id"), F.col("id").alias("slot"), F.length("name").alias("len")).where("type_id is not null")
    n = (F.col("site_id") + F.col("len")) % 4
    writes = sites.join(slots, "type_id").where(n != 0).select("site_id", "slot", F.lit(1).alias("pos"), (n == 1).alias("is_null"), F.lit(False).alias("in_branch"), F.lit(False).alias("after_escape"))
    return A.assignment_coverage(sites, slots.drop("len"), writes)


# --- documents

_DOCS = """with docs as (select graph_id, p::json j from (select graph_id, regexp_replace(payload, '^[\\x{FEFF}\\s]+', '') p from graph_documents) where json_valid(p) and json_type(p::json) = 'OBJECT'),
  sy as (select graph_id, generate_subscripts(a, 1) - 1 pos, unnest(a) x from (select graph_id, cast(json_extract(j, '$.symbols') as json[]) a from docs where json_type(j, '$.symbols') = 'ARRAY')),
  ed as (select graph_id, generate_subscripts(a, 1) - 1 pos, unnest(a) x from (select graph_id, cast(json_extract(j, '$.edges') as json[]) a from docs where json_type(j, '$.edges') = 'ARRAY'))"""


@query("select graph_id document_id, pos::int pos, coalesce(x->>'id', '') id, coalesce(x->>'name', '') name, lower(coalesce(x->>'kind', 'module')) kind, nullif(x->>'parentId', '') parent_id, lower(coalesce(x->>'visibility', 'public')) visibility, coalesce(try_cast(x->>'line' as int), 0) line from sy", prefix=_DOCS)
def json_symbols(spark: SparkSession, d: str) -> DataFrame:
    docs = J.parse(table(spark, d, "graph_documents"), "graph_id", "payload")
    return J.symbols_of(docs).select("document_id", "pos", "id", "name", "kind", "parent_id", "visibility", "line")


@query("select graph_id document_id, pos::int pos, coalesce(x->>'sourceId', '') source_id, coalesce(x->>'targetId', '') target_id, case lower(coalesce(x->>'kind', 'contains')) when 'dependson' then 'dependsOn' else lower(coalesce(x->>'kind', 'contains')) end kind, json_type(x, '$.evidence') is not distinct from 'OBJECT' has_evidence from ed", prefix=_DOCS)
def json_edges(spark: SparkSession, d: str) -> DataFrame:
    docs = J.parse(table(spark, d, "graph_documents"), "graph_id", "payload")
    return J.edges_of(docs).select("document_id", "pos", "source_id", "target_id", "kind", (F.col("evidence.adapter_name") != "unknown").alias("has_evidence"))


def _export(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    owner = g.symbols.select(F.col("id").alias("source_id"), F.coalesce("file_path", "id").alias("document"))
    symbols, edges = J.in_parts(g.symbols.withColumn("document", F.coalesce("file_path", "id")), g.edges.join(owner, "source_id"), "document")
    return J.to_documents(symbols, edges, F.col("part"), F.col("part"))


@query("select coalesce(file_path, id) document_id, count(*) n_symbols from s group by 1")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    """The graph as one document per file that symbols lie in, large ones in parts; a symbol without a file has its own."""
    docs = J.parse(_export(spark, d), "document_id", "payload")
    return docs.groupBy(F.regexp_replace("document_id", r"#\d+$", "").alias("document_id")).agg(F.coalesce(F.sum(F.size("d.symbols")), F.lit(0)).alias("n_symbols"))


@query("select 'symbol' what, id a, coalesce(name, '') b, kind c, coalesce(parent_id, '') d from s union all select 'edge', s, t, k, coalesce(profiles, '') from e")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The graph exported and read again."""
    docs = J.parse(_export(spark, d), "document_id", "payload")
    s = J.symbols_of(docs).select(F.lit("symbol").alias("what"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("kind").alias("c"), F.coalesce("parent_id", F.lit("")).alias("d"))
    e = J.edges_of(docs).select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("kind").alias("c"), F.coalesce(F.array_join("profiles", ","), F.lit("")).alias("d"))
    return s.unionByName(e)


# --- change handling

_CUT = "2025-09-01"


def _manifest(spark: SparkSession, d: str, until: str | None) -> DataFrame:
    rows = table(spark, d, "symbols").where("file_path is not null")
    if until:
        rows = rows.where(F.col("loaded_at") < F.lit(until).cast("timestamp"))
    ids = F.array_join(F.array_sort(F.collect_set("id")), "|")
    return rows.groupBy(F.col("file_path").alias("path")).agg(F.split(F.first("file_path"), "/")[1].alias("module"), F.md5(ids).alias("content_hash"), F.max("loaded_at").alias("modified_at"))


def _man(where: str) -> str:
    return f"(select file_path path, string_split(file_path, '/')[2] module, md5(array_to_string(list_sort(list_distinct(list(id))), '|')) h, max(loaded_at) t from symbols where file_path is not null and {where} group by 1)"


@query(
    f"select coalesce(a.path, b.path) path, coalesce(b.module, a.module) module, case when a.path is null then 'added' when b.path is null then 'removed' when a.h <> b.h then 'changed' when a.t < b.t then 'touched' else 'same' end status from {_man(f'''loaded_at < timestamp '{_CUT}' ''')} a full join {_man('true')} b on a.path = b.path",
    prefix="",
)
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    """The files of the graph as of a day and now."""
    return T.manifest_diff(_manifest(spark, d, _CUT), _manifest(spark, d, None))


@query("select edge_id, row_no from edges qualify row_number() over (partition by edge_id order by loaded_at desc, row_no desc) = 1", prefix="")
def stream_newest_edges(spark: SparkSession, d: str) -> DataFrame:
    """The newest row of each edge, kept by a stream over the delivered files."""
    schema = table(spark, d, "edges").select("edge_id", "row_no", "loaded_at").schema
    out = new_folder(spark, "stream")
    changes = spark.readStream.schema(schema).parquet(f"{d}/edges.parquet*")
    T.upsert_stream(changes, f"{out}/table", ["edge_id"], ["loaded_at", "row_no"], f"{out}/checkpoint").awaitTermination()
    return T.newest_of(spark, f"{out}/table", ["edge_id"], ["loaded_at", "row_no"]).select("edge_id", "row_no")
