"""Queries of the graph operators over the delivered tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.operators import analysis as A
from semgraph.operators import build as B
from semgraph.operators import numbers as N
from semgraph.operators import reads as R
from semgraph.operators.validate import validate
from semgraph.plans.graph_source import PREFIX, cycle_members, graph, marked_edges, marked_symbols, named_edges, raw_edges, raw_symbols, slim_edges, slim_symbols
from semgraph.session import discard

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Registers a query; its SQL stands on the graph prefix."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{PREFIX}{more} {sql}"
        return f

    return add


def _roots(g: B.Graph) -> DataFrame:
    """The roots of the whole analysis: types and modules of three dependants."""
    return A.coupling(g, ("type", "module")).where("fan_in >= 3").select("id")


# --- construction and validation


@query("select id, name, kind, parent_id, visibility, bucket from s")
def graph_symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).symbols.select("id", "name", "kind", "parent_id", "visibility", "bucket")


@query("select s source_id, t target_id, k kind, role, profiles from e")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).edges.select("source_id", "target_id", "kind", "role", F.array_join("profiles", ",").alias("profiles"))


@query("select s source_id, t target_id from made")
def contains_synthesis(spark: SparkSession, d: str) -> DataFrame:
    s, e = raw_symbols(spark, d), raw_edges(spark, d)
    told = B.drop_dangling(e.withColumn("kind", B.edge_kind(F.col("kind"))), s.select("id"))
    return B.synthesize_contains(s, told).select("source_id", "target_id")


@query("select s source_id, t target_id, n edge_count from fe")
def file_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph(spark, d).edges.where("evidence.adapter_name = 'GraphBuilder' and kind = 'references'")
    return e.select("source_id", "target_id", F.col("properties")["edgeCount"].cast("long").alias("edge_count"))


@query("select s source_id, t target_id, k kind, role, count(*) n_rows, min(ord) first_edge from told group by all having count(*) > 1")
def dedup_edges(spark: SparkSession, d: str) -> DataFrame:
    """Identities that several delivered edges have."""
    e = raw_edges(spark, d).withColumn("kind", B.edge_kind(F.col("kind"))).withColumn("role", B.edge_role(F.col("properties")))
    told = B.drop_dangling(e, raw_symbols(spark, d).select("id"))
    rows = told.groupBy("source_id", "target_id", "kind", "role").agg(F.count("*").alias("n_rows"), F.min("ord").alias("first_edge"))
    return rows.where("n_rows > 1").select("source_id", "target_id", "kind", "role", "n_rows", "first_edge")


_LABEL = "coalesce(s, '') || ' -> ' || coalesce(t, '')"


@query(
    f"""select 'DANGLING_EDGE_SOURCE' code, {_LABEL} subject from rawe where s is not null and s not in (select id from s)
  union all select 'DANGLING_EDGE_TARGET', {_LABEL} from rawe where t is not null and t not in (select id from s)
  union all select 'EMPTY_EDGE_SOURCE', {_LABEL} from rawe where s is null union all select 'EMPTY_EDGE_TARGET', {_LABEL} from rawe where t is null
  union all select 'SELF_REFERENCING_EDGE', {_LABEL} from rawe where s = t and k <> 'calls'
  union all select 'DUPLICATE_EDGE', {_LABEL} from (select *, row_number() over (partition by s, t, k, role order by ord) n from rawe) where n > 1
  union all select 'EMPTY_SYMBOL_NAME', id from s where coalesce(name, '') = ''
  union all select 'DANGLING_PARENT_ID', id from s where parent_id is not null and parent_id not in (select id from s)"""
)
def validate_graph(spark: SparkSession, d: str) -> DataFrame:
    return validate(raw_symbols(spark, d), raw_edges(spark, d))


# --- lookup, buckets, profiles


@query("select bucket, kind, count(*) n from s group by all")
def path_buckets(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).symbols.groupBy("bucket", "kind").agg(F.count("*").alias("n"))


@query("select c.s parent_id, c.t id, x.kind from c join s x on c.t = x.id group by all")
def children_of(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.contained_pairs(g).join(g.symbols.select(F.col("id").alias("child"), "kind"), "child").select(F.col("parent").alias("parent_id"), F.col("child").alias("id"), "kind")


@query("select id, kind, name from s where lower(name) = 'resolve'")
def short_name(spark: SparkSession, d: str) -> DataFrame:
    return R.find_short_name(graph(spark, d), "Resolve")


@query("select id, kind, name from s where contains(lower(name), 'builder')")
def short_name_contains(spark: SparkSession, d: str) -> DataFrame:
    return R.find_short_name(graph(spark, d), "Builder", contains=True)


@query("select profile, count(*) n_edges from (select unnest(string_split(profiles, ',')) profile from e where profiles <> '') group by 1")
def profile_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.profile_counts(graph(spark, d))


@query("select k kind, count(*) n from e where profiles is null or list_has_any(string_split(profiles, ','), ['Editor', 'Server']) group by 1")
def profile_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.of_profiles(graph(spark, d).edges, ["Editor", "Server"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    """select t id, count(distinct lower(path)) n_files, array_to_string(list_sort(list(distinct path)), '|') files,
  arg_min(path, (rank, case when rank = 1 then length(path) else 0 end, lower(path))) primary_file
  from (select c.t, f.path, case when stem = lower(x.name) then 0 when starts_with(stem, lower(x.name) || '.') then 1 else 2 end rank
    from c join (select id, coalesce(file_path, substr(id, 6)) path, lower(regexp_replace(string_split(coalesce(file_path, substr(id, 6)), '/')[-1], '\\.[^.]*$', '')) stem from s where kind = 'file') f on c.s = f.id join s x on x.id = c.t and x.kind = 'type') group by 1"""
)
def declaration_files(spark: SparkSession, d: str) -> DataFrame:
    return R.partial_files(graph(spark, d))


# --- coupling and figures

_COUPLING = """, ends as (select distinct s, t from l), cp as materialized (select x.id, x.kind, coalesce(i.n, 0) fan_in, coalesce(o.n, 0) fan_out,
  case when coalesce(i.n, 0) + coalesce(o.n, 0) = 0 then 0.0::double else coalesce(o.n, 0) / (coalesce(i.n, 0) + coalesce(o.n, 0)) end instability
  from s x left join (select t, count(*) n from ends group by t) i on x.id = i.t left join (select s, count(*) n from ends group by s) o on x.id = o.s)"""


@query("select id, kind, fan_in, fan_out, round(instability, 6) instability from cp", _COUPLING)
def coupling(spark: SparkSession, d: str) -> DataFrame:
    return A.coupling(graph(spark, d)).withColumn("instability", F.round("instability", 6))


@query("select id, fan_in, fan_out, round(instability, 6) instability from cp where kind in ('type', 'module') order by instability desc, fan_out desc, id limit 50", _COUPLING)
def instability_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = A.coupling(graph(spark, d), ("type", "module")).select("id", "fan_in", "fan_out", F.round("instability", 6).alias("instability"))
    return rows.orderBy(F.desc("instability"), F.desc("fan_out"), "id").limit(50)


@query("select count(*) symbols, count(*) filter (where kind = 'file') files, count(*) filter (where kind = 'type') types, count(*) filter (where kind = 'module') modules, count(*) filter (where kind = 'method') methods, (select count(*) from e) edges from s")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_metrics(graph(spark, d))


# --- single-hop reads


@query("select distinct t root, s node from l")
def dependants(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.neighbours(g, g.symbols.select("id"), True).select("root", "node").distinct()


@query("select distinct s root, t node from l where s in (select id from s where kind = 'type')")
def dependencies(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.neighbours(g, g.symbols.where("kind = 'type'").select("id"), False).select("root", "node").distinct()


@query("select s root, t node, k kind, role, x.bucket, profiles from l join s x on x.id = t where s in (select id from s where kind = 'module')")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.neighbours(g, g.symbols.where("kind = 'module'").select("id"), False).drop("call_site").withColumn("profiles", F.array_join("profiles", ","))


@query("select s root, t node, k kind, role, cs.file_path file_path, cs.line line, cs.col col from (select s, t, k, role, arg_min_null(call_site, ord) cs from told where k <> 'contains' group by all) where cs is not null")
def edge_sites(spark: SparkSession, d: str) -> DataFrame:
    """Every link with the place where it was first seen."""
    g = graph(spark, d)
    rows = A.neighbours(g, g.symbols.select("id"), False).where("call_site is not null")
    return rows.select("root", "node", "kind", "role", "call_site.file_path", "call_site.line", "call_site.col")


@query(
    "select root, n_links, coalesce(n_shown, 0) n_shown from (select t root, count(*) n_links, count(*) filter (where x.bucket not in ('Test', 'Generated') and (profiles is null or list_has_any(string_split(profiles, ','), ['Editor', 'Server']))) n_shown from l join s x on x.id = l.s group by 1)"
)
def filtered_dependants(spark: SparkSession, d: str) -> DataFrame:
    """For each target its incoming links before and after tests, generated code and other profiles are filtered."""
    g = graph(spark, d)
    rows = A.neighbours(g, g.symbols.select("id"), True)
    shown = A.of_profiles(rows, ["Editor", "Server"]).where(~F.col("bucket").isin("Test", "Generated")).groupBy("root").agg(F.count("*").alias("n_shown"))
    return rows.groupBy("root").agg(F.count("*").alias("n_links")).join(shown, "root", "left").fillna(0)

_UP = """, up(id, a, n) as (select id, id, 1 from s union all select u.id, x.parent_id, n + 1 from up u join s x on u.a = x.id where x.kind <> '{kind}' and x.parent_id in (select id from s) and n < {hops}),
  {name} as materialized (select u.id, u.a m from up u join s x on u.a = x.id where x.kind = '{kind}')"""
_MODULE = _UP.format(kind="module", hops=16, name="mo")
_MODULE32 = _UP.format(kind="module", hops=32, name="near") + """, lost(id, a, n) using key (id, a) as (select id, id, 0 from s where id not in (select id from near)
    union select w.id, c.s, min(n + 1) from lost w join s x on x.id = w.a and x.kind <> 'module' join c on c.t = w.a where not exists (select 1 from recurring.lost r where r.id = w.id and r.a = c.s) group by 1, 2),
  mo as materialized (select id, m from near union all select lost.id, arg_min(a, (n, a)) from lost join s x on x.id = lost.a and x.kind = 'module' group by 1)"""
_TYPE16 = _UP.format(kind="type", hops=16, name="ty")
_GROUPS = "select root, {g}, count(*) n, count(*) filter (where dist = 1) n_direct, array_to_string(list(node order by dist, node)[1:5], '|') preview from rows group by all"


@query(_GROUPS.format(g="bucket"), ", rows as (select distinct t root, s node, 1 dist, x.bucket from l join s x on x.id = l.s)")
def edges_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rows = A.neighbours(g, g.symbols.select("id"), True).select("root", "node", F.lit(1).alias("dist"), "bucket").distinct()
    return A.grouped(rows, ["root", "bucket"])


@query(
    _GROUPS.format(g="module_name"),
    f"{_MODULE}, rows as (select distinct l.t root, l.s node, 1 dist, coalesce(x.name, '(unknown)') module_name from l left join mo on mo.id = l.s left join s x on x.id = mo.m)",
)
def edges_by_module(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rows = A.neighbours(g, g.symbols.select("id"), True).select("root", "node", F.lit(1).alias("dist")).distinct().join(A.module_name_of(g).withColumnRenamed("id", "node"), "node")
    return A.grouped(rows, ["root", "module_name"])


@query("select s source_id, t target_id, sum(coalesce(try_cast(ec as int), 1))::bigint edge_count from e where k = 'references' and s in (select id from s where kind = 'file') and t in (select id from s where kind = 'file') group by 1, 2")
def file_impact(spark: SparkSession, d: str) -> DataFrame:
    return A.file_impact(graph(spark, d))


# --- traversals


def _reach(steps: str, seeds: str, depth: int) -> str:
    return f", steps as (select distinct {steps}), walk(root, node, dist) using key (root, node) as (select root, node, 0 from ({seeds}) q union select w.root, p.b, min(w.dist + 1) from walk w join steps p on w.node = p.a where w.dist < {depth} and not exists (select 1 from recurring.walk r where r.root = w.root and r.node = p.b) group by 1, 2), got as (select root, node, min(dist) dist from walk group by root, node)"


_BACK = "t a, s b from l"
_MODTYPES = "select id root, id node from s where kind in ('type', 'module') and id in (select id from cp where fan_in >= 3)"
_BLAST = _COUPLING + _reach(_BACK, _MODTYPES, 10)


@query("select * from got where dist > 0 and node <> root", _BLAST)
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.blast_radius(g, _roots(g))


@query("select root, bucket, count(*) n, count(*) filter (where dist = 1) n_direct, array_to_string(list(node order by dist, node)[1:5], '|') preview from got join s x on x.id = node where dist > 0 and node <> root group by all", _BLAST)
def blast_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rows = A.blast_groups(g, _roots(g), g.symbols.select(F.col("id").alias("node"), F.col("bucket").alias("label")))
    return rows.select("root", F.col("label").alias("bucket"), "n", "n_direct", "preview")


@query(
    "select root, coalesce(x.name, '(unknown)') module_name, count(*) n, count(*) filter (where dist = 1) n_direct, array_to_string(list(node order by dist, node)[1:5], '|') preview from got left join mo on mo.id = node left join s x on x.id = mo.m where dist > 0 and node <> root group by all",
    _MODULE + _BLAST,
)
def blast_by_module(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    rows = A.blast_groups(g, _roots(g), A.module_name_of(g).select(F.col("id").alias("node"), F.col("module_name").alias("label")))
    return rows.select("root", F.col("label").alias("module_name"), "n", "n_direct", "preview")


_ORDER = "list_position(['contains', 'dependsOn', 'implements', 'inherits', 'calls', 'references', 'overrides'], {})"


@query(
    f"""select t root, s node, severity, case when severity = 4 then 'SignatureChange' else 'BindingRemoval' end break_kind, reason from
  (select t, s, max(case when k in ('implements', 'inherits', 'overrides') then 4 else 2 end) severity, array_to_string(list(k order by {_ORDER.format("k")}), ',') reason from (select distinct s, t, k from l) group by t, s)"""
)
def blast_breaks(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.breaks(g, g.symbols.select("id"))


@query("select root, count(*) n, max(dist) deepest from got where dist > 0 and node <> root group by 1", _BLAST)
def blast_all_hot(spark: SparkSession, d: str) -> DataFrame:
    """Blast radii of all types and modules with three dependants, as deep as the whole analysis goes."""
    g = graph(spark, d)
    return A.blast_groups(g, _roots(g), preview=0).select("root", "n", "deepest")


@query("select root, count(*) n, max(dist) deepest from got where node <> root group by 1", _reach("s a, t b from c", "select id root, id node from s where kind = 'module'", 500))
def descendants(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.descendants(g, g.symbols.where("kind = 'module'").select("id")).groupBy("root").agg(F.count("*").alias("n"), F.max("dist").alias("deepest"))


_TEST = "kind = 'method' and list_has_any(string_split(coalesce(attrs, ''), ';'), ['Test', 'TestCase', 'TestCaseSource', 'Theory', 'UnityTest', 'Fact', 'Xunit.Fact', 'Xunit.Theory'])"
_TARGETS = "select id from s where kind = 'type'"


@query(
    f"""select root, m test_class, min(dist) distance, case min(dist) when 1 then 'Direct' when 2 then 'OneHop' else 'Transitive' end confidence,
  array_to_string(list_sort(list(distinct coalesce(x.qualified_name, x.name))), ';') tests from got join s x on x.id = node and {_TEST} join ty on ty.id = node group by root, m""",
    _TYPE16 + _reach(_BACK, f"select id root, id node from s where id in ({_TARGETS}) union select c.s, c.t from c where c.s in ({_TARGETS})", 12),
)
def test_impact(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.test_impact(g, g.symbols.where("kind = 'type'").select("id"))


@query(
    f"""select root, m test_class, min(dist) distance, case min(dist) when 1 then 'Direct' when 2 then 'OneHop' else 'Transitive' end confidence,
  array_to_string(list_sort(list(distinct coalesce(x.qualified_name, x.name))), ';') tests from got join s x on x.id = node and {_TEST} join ty on ty.id = node group by root, m""",
    _TYPE16 + _reach(_BACK, "select f root, id node from filed", 12),
)
def test_impact_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Tests that reach anything in each file."""
    numbers = N.numbered(marked_symbols(spark, d), named_edges(spark, d))
    if numbers.n_steps <= N.HELD:
        return A.test_impact(numbers, numbers.symbols.where("kind = 'file'").select("id"))
    discard(spark, numbers.base)
    g = graph(spark, d)
    return A.test_impact(g, g.symbols.where("kind = 'file'").select("id"))


_CLOSURE = ", inh as (select distinct s a, t b from e where k = 'inherits'), clo(root, node) as (select a, b from inh union select c.root, i.b from clo c join inh i on c.node = i.a)"


@query("select root, node from clo", _CLOSURE)
def interface_closure(spark: SparkSession, d: str) -> DataFrame:
    return R.interface_closure(graph(spark, d))


_CONTRACTS = ", con as (select distinct x.id, e.t contract from e join s x on e.s = x.id where x.kind = 'type' and case when coalesce(x.p['typeKind'], '') = 'interface' then e.k = 'inherits' else e.k = 'implements' end)"


@query("select id, contract from con", _CONTRACTS)
def direct_contracts(spark: SparkSession, d: str) -> DataFrame:
    return R.direct_contracts(graph(spark, d))


# --- cycles, tiers, rules

_SCC = ", st as (select distinct s a, t b from l where s <> t and not (k = 'references' and coalesce(init, '') = 'methodGroup')), rc(a, b) as (select a, b from st union select r.a, x.b from rc r join st x on r.b = x.a), scc as materialized (select a node, greatest(max(b), a) component from rc r where exists (select 1 from rc q where q.a = r.b and q.b = r.a) group by a having count(distinct b) > 1)"


@query("select node id, component from scc", _SCC)
def cycles(spark: SparkSession, d: str) -> DataFrame:
    return cycle_members(spark, d).select(F.col("node").alias("id"), "component")


_CLASSES = f"""{_SCC}{_UP.format(kind="type", hops=32, name="tu")}, sz as (select component, count(*) n from scc group by 1),
  enc as (select distinct scc.component, scc.node, coalesce(f.t, tu.m) ty from scc join s x on x.id = scc.node left join (select c.s, c.t from c join s y on y.id = c.t and y.kind = 'type') f on x.kind = 'file' and f.s = x.id left join tu on x.kind <> 'file' and tu.id = x.id),
  sh as (select distinct component from (select component, ty, count(distinct node) k from enc where ty is not null group by 1, 2) join sz using (component) where k = n),
  cls as (select component, n n_members, case when component in (select component from scc join s x on x.id = scc.node where x.bucket = 'Generated') then 'GeneratedOrStaticAnalysisArtifact' when component in (select component from sh) then 'PartialClassCluster' else 'LikelyRealLoop' end class from sz)"""


@query("select * from cls", _CLASSES)
def cycle_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.cycle_taxonomy(g, cycle_members(spark, d))


@query("select class, count(*) n_cycles, sum(n_members)::bigint n_symbols, max(n_members) largest from cls group by 1", _CLASSES)
def cycle_stats(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return A.cycle_stats(A.cycle_taxonomy(g, cycle_members(spark, d)))


_TIERS = f", holds(id) as (select id from s where {_TEST} union select c.s from holds h join c on c.t = h.id), tiers as (select id, case when id not in (select s from l) then 'Pure' when id in (select id from holds) then 'Tooling' when id in (select t from l) then 'Boundary' else 'Runtime' end tier from s where kind in ('module', 'type'))"


@query(
    f"""select id, tier, case tier when 'Pure' then 'No outgoing dependencies' when 'Tooling' then 'Contains a method tagged with a test-framework attribute'
  when 'Boundary' then 'Has both incoming and outgoing dependencies' else 'Has outgoing dependencies, no dependants' end reason from tiers""",
    _TIERS,
)
def tiers(spark: SparkSession, d: str) -> DataFrame:
    return A.tiers(graph(spark, d))


#: rules that fit the names of the delivered graph: (id, source, must not, may only)
RULES = [
    ("LAYER-001", "*.Billing", "*.Export", None), ("LAYER-002", "*.Policy", "*.Telemetry", None), ("LAYER-003", "*.Routing", None, "Tarnwick.Core.*"),
    ("LAYER-004", "Tarnwick.Core.*", "*.Render", None), ("LAYER-005", "*.Search", "Tarnwick.Legacy", None), ("LAYER-006", "*", "Tarnwick.Legacy.*", None),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_ord int, id string, source string, must_not_reference string, may_only_reference string")


def _fits(n: str, p: str) -> str:
    t = f"substr({p}, 3)"
    h = f"left({p}, length({p}) - 2)"
    return f"(case when {p} = '*' then true when starts_with({p}, '*.') then ends_with({n}, '.' || {t}) or contains({n}, '.' || {t} || '.') or starts_with({n}, {t} || '.') or {n} = {t} when ends_with({p}, '.*') then starts_with({n}, {h} || '.') or {n} = {h} else {n} = {p} or starts_with({n}, {p} || '.') end)"


_RULES = ", ".join(f"({i}, '{r[0]}', '{r[1]}', {repr(r[2]) if r[2] else 'null'}, {repr(r[3]) if r[3] else 'null'})" for i, r in enumerate(RULES))
_VIO = f""", rl(o, rule_id, src, must, may) as (values {_RULES}),
  br as (select l.s, l.t, l.k, l.role, r.o, r.rule_id, r.rule_id || ': ' || n.nm || case when r.must is not null and {_fits("lower(m.nm)", "lower(r.must)")} then ' must_not_reference ' || r.must else ' may_only_reference ' || r.may end message
    from l join (select id, coalesce(nullif(qualified_name, ''), id) nm from s) n on n.id = l.s join (select id, coalesce(nullif(qualified_name, ''), id) nm from s) m on m.id = l.t join rl r on {_fits("lower(n.nm)", "lower(r.src)")}
    where (r.must is not null and {_fits("lower(m.nm)", "lower(r.must)")}) or (r.may is not null and not {_fits("lower(m.nm)", "lower(r.may)")} and not {_fits("lower(m.nm)", "lower(r.src)")}))"""


@query("select s source_id, t target_id, k kind, role, arg_min(rule_id, o) rule_id, arg_min(message, o) message from br group by s, t, k, role", _VIO)
def violations(spark: SparkSession, d: str) -> DataFrame:
    return A.violations(graph(spark, d), rules(spark))


@query(
    f"""select a.m source_module, b.m target_module, count(*) n_edges, arg_min(l.s || ' -> ' || l.t, (l.s, l.t, {_ORDER.format("l.k")}, l.role)) first_edge
  from l join mo a on l.s = a.id join mo b on l.t = b.id where l.k <> 'dependsOn' and a.m <> b.m and a.m in (select id from s where direct) and (a.m, b.m) not in (select s, t from e where k = 'dependsOn')
  and l.s in (select id from s where bucket <> 'Test') group by 1, 2""",
    _MODULE32,
)
def module_boundary(spark: SparkSession, d: str) -> DataFrame:
    return A.module_boundary(graph(spark, d), ("Test",))


_PIPELINE = "(select count(*) from cp where fan_in + fan_out > 0) coupled, (select count(*) from tiers where tier = 'Tooling') tooling, (select count(*) from tiers where tier = 'Boundary') boundary, (select count(distinct root) from got where dist > 0 and node <> root) blast_roots, (select count(*) from got where dist > 0 and node <> root) blast_pairs"


@query(
    f"select count(*) symbols, count(*) filter (where kind = 'file') files, count(*) filter (where kind = 'type') types, count(*) filter (where kind = 'module') modules, count(*) filter (where kind = 'method') methods, (select count(*) from e) edges, (select count(*) from (select distinct s, t, k, role from br)) violations, (select count(distinct component) from scc) cycles, {_PIPELINE} from s",
    _SCC + _VIO + _BLAST + _TIERS,
)
def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The figures of the whole analysis, and of each of its parts."""
    name = F.coalesce(F.nullif("qualified_name", F.lit("")), "id")
    marks = N.rule_marks(name, RULES)
    numbers = N.numbered(marked_symbols(spark, d, marks), marked_edges(spark, d), len(marks) // 2)
    if numbers.n_steps <= N.HELD:
        return N.metrics(numbers)
    discard(spark, numbers.base)
    g = graph(spark, d)
    tiers_ = A.tiers(g).agg(F.count_if(F.col("tier") == "Tooling").alias("tooling"), F.count_if(F.col("tier") == "Boundary").alias("boundary"))
    blast = A.blast_groups(g, _roots(g), preview=0).agg(F.count("*").alias("blast_roots"), F.coalesce(F.sum("n"), F.lit(0)).alias("blast_pairs"))
    coupled = A.coupling(g).agg(F.count_if(F.col("fan_in") + F.col("fan_out") > 0).alias("coupled"))
    whole = A.graph_metrics(g, A.violations(g, rules(spark)), cycle_members(spark, d).select("component").distinct())
    return whole.crossJoin(coupled).crossJoin(tiers_).crossJoin(blast)  # a row each


# --- dead code, ports, authorities

_DEAD = f""", att as (select id, list_filter(string_split(coalesce(attrs, ''), ';'), lambda a: a in ({", ".join(repr(a) for a in R.ENTRYPOINT_ATTRIBUTES)})) tags from s),
  alive as (select id from att where len(tags) > 0 union select c.s from c join att on att.id = c.t and len(tags) > 0),
  mem as (select distinct c.s h, x.* from c join s x on x.id = c.t),
  scaf as (select id from s where kind = 'type' and is_static and visibility <> 'public' and id in (select h from mem group by h having bool_and(coalesce((kind = 'method' and list_contains(string_split(coalesce(attrs, ''), ';'), 'Conditional')) or (kind = 'field' and coalesce(is_static, false) and coalesce(p['fieldType'] in ('string', 'System.String'), false) and p['constantValue'] is not null), false)))),
  dead as (select *, coalesce(id in (select id from scaf) or parent_id in (select id from scaf), false) sc from s where kind in ('method', 'type', 'property', 'field') and visibility <> 'public' and bucket <> 'Test' and not (kind = 'method' and name = '.cctor') and coalesce(p['synthesized'], '') <> 'true'
    and id not in (select t from l) and id not in (select s from e where k = 'implements') and id not in (select id from alive))"""


@query("select id, kind, file_path, line, case when sc then 'Scaffolding' else bucket end bucket, 'non-public ' || kind || case when sc then ' scaffolding' else '' end || ' with no incoming semantic references' reason, 0::bigint direct_dependants from dead", _DEAD)
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return R.dead_code(graph(spark, d))


@query("select kind, case when sc then 'Scaffolding' else bucket end bucket, count(*) n from dead group by all", _DEAD)
def dead_code_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return R.dead_code(graph(spark, d)).groupBy("kind", "bucket").agg(F.count("*").alias("n"))


@query(
    "select id, kind, file_path, line, case when sc then 'Scaffolding' else bucket end bucket, 'non-public ' || kind || case when sc then ' scaffolding with no incoming semantic references' when n > 0 then ' with only same-class consumers (' || n || ')' else ' with no incoming semantic references' end reason, n direct_dependants from (select *, (select count(*) from l where l.t = dead.id) n from dead)",
    _DEAD.replace("id not in (select t from l)", "id not in (select l.t from l join s a on a.id = l.s join s b on b.id = l.t where a.parent_id is null or b.parent_id is null or a.parent_id <> b.parent_id)"),
)
def dead_code_same_class(spark: SparkSession, d: str) -> DataFrame:
    """Dead code where links from within one parent keep nothing alive."""
    return R.dead_code(graph(spark, d), same_class=True)


_FACE = "(select id from s where kind = 'type' and coalesce(p['typeKind'], '') = 'interface')"
_MEMBERS = ", dm as (select distinct c.s h, c.t m from c join s x on x.id = c.t where x.kind <> 'type')"


@query(
    """select f.id, coalesce(n, 0) members, coalesce(own, 0) direct_members, coalesce(live, 0) live_members, round_even(coalesce(live / n, 0.0), 3) liveness,
  case when coalesce(n, 0) = 0 then 'empty' when live / n >= 0.75 then 'healthy' when live / n >= 0.25 then 'mixed' else 'vestigial' end verdict from fc f left join agg on f.id = agg.root""",
    _CLOSURE + _MEMBERS + f""", fc as {_FACE}, each as (select root, m, max(own) own from (select id root, m, 1 own from fc join dm on dm.h = id union all select root, m, 0 from clo join dm on dm.h = clo.node where root in (select id from fc)) group by root, m),
  agg as (select root, count(*) n, sum(own)::bigint own, count(*) filter (where m in (select t from l) or m in (select s from e where k = 'implements')) live from each group by root)""",
)
def port_health(spark: SparkSession, d: str) -> DataFrame:
    return R.port_health(graph(spark, d))


@query(
    """select x.id, coalesce(nc, 0) n_contracts, coalesce(ps, 0) public_surface, coalesce(me, 0) methods, case when coalesce(cl, 0) = 0 or coalesce(me, 0) = 0 then -1.0 else round_even(fw / me, 3) end forwarder_ratio,
  coalesce(cross_n, 0) cross_modules, coalesce(same_n, 0) same_consumers, case when coalesce(x.p['typeKind'], '') = 'interface' then coalesce(im, 0) = 1 end single_implementer
  from s x left join (select id, count(*) nc from con group by id) a on a.id = x.id
  left join (select h, count(*) filter (where y.kind in ('method', 'property', 'field') and y.visibility = 'public') ps, count(*) filter (where y.kind = 'method') me, count(*) filter (where y.kind = 'method' and y.p['classification'] is not null) cl, count(*) filter (where y.kind = 'method' and y.p['classification'] = 'PureForwarder') fw from dm join s y on y.id = dm.m group by h) b on b.h = x.id
  left join (select h, count(distinct case when sm <> own then sm end) cross_n, count(distinct case when sm = own then src end) same_n from us group by h) u on u.h = x.id
  left join (select t, count(distinct s) im from e where k = 'implements' group by t) i on i.t = x.id where x.kind = 'type'""",
    _CONTRACTS + _MEMBERS + _MODULE + """, part as (select id h, id m from s where kind = 'type' union all select h, m from dm where h in (select id from s where kind = 'type')),
  us as (select distinct part.h, e.s src, a.m own, b.m sm from part join e on e.t = part.m and e.k in ('calls', 'references') join mo a on a.id = part.h join mo b on b.id = e.s)""",
)
def authority_report(spark: SparkSession, d: str) -> DataFrame:
    return R.authority_report(graph(spark, d))


@query(
    """select con.id, con.contract, coalesce(n, 0) direct_members, coalesce(inh_n, 0) inherited_members, coalesce(n, 0) + coalesce(inh_n, 0) all_members, coalesce(cons, 0) consumers from con
  left join sz on sz.h = con.contract left join (select root, sum(n)::bigint inh_n from clo join sz on sz.h = clo.node group by root) q on q.root = con.contract left join (select root, count(distinct e.s) cons from pt join e on e.t = pt.part and e.k in ('calls', 'references') group by root) w on w.root = con.contract""",
    _CLOSURE + _CONTRACTS + _MEMBERS + """, sz as (select h, count(*) n from dm group by h), nd as (select contract root, contract node from con union select root, node from clo where root in (select contract from con)),
  pt as (select root, node part from nd union select root, m from nd join dm on dm.h = nd.node)""",
)
def interface_usage(spark: SparkSession, d: str) -> DataFrame:
    return R.interface_usage_of(slim_symbols(spark, d), slim_edges(spark, d))


@query(None)
def authority_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether public types reach the guard of the base library, or its result type instead."""
    g = graph(spark, d)
    pick = lambda *ids: g.symbols.where(F.col("id").isin(*ids)).select("id")
    return R.authority_coverage(g, g.symbols.where("kind = 'type' and visibility = 'public'").select("id"), pick("type:Tarnwick.Core.Guard"), pick("type:Tarnwick.Core.Result"), buckets=("Production",))


_BELOW = "select {root} root, id node from s where {where} union select b.root, c.t from {name} b join c on c.s = b.node"


@query(
    "select x.id, case when x.id not in (select root from seeds) then 'NoSubjectSeeds' when b.b is null then 'MissingRequired' when b.b.alt = 0 then 'RequiredReached' else 'AllowedAlternativeReached' end status, b.b.dist distance from s x left join (select root, min({'alt': alt, 'dist': dist}) b from walk join parts on parts.node = walk.node group by 1) b on b.root = x.id where x.kind = 'type' and x.visibility = 'public'",
    f""", wide(root, node) as ({_BELOW.format(root="id", where="kind = 'type' and visibility = 'public'", name="wide")}), seeds as materialized (select root, w.node from wide w join s x on x.id = w.node where x.kind = 'method' and x.bucket = 'Production'),
  below(root, node) as ({_BELOW.format(root="id", where="id in ('type:Tarnwick.Core.Guard', 'type:Tarnwick.Core.Result')", name="below")}), parts as (select case root when 'type:Tarnwick.Core.Guard' then 0 else 1 end alt, node from below),
  st as (select distinct s a, t b from l), walk(root, node, dist) as (select root, node, 0 from seeds union select w.root, st.b, w.dist + 1 from walk w join st on st.a = w.node where w.dist < 6)""",
)
def authority_status(spark: SparkSession, d: str) -> DataFrame:
    return authority_coverage(spark, d).select("id", "status", "distance")


# --- search and identifiers

_CAMEL = "list_transform(string_split(regexp_replace(name, '([^\\p{Lu}])(\\p{Lu})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: lower(x))"
_WORD = "(case when contains(lower(name), '{w}') then 10 else 0 end + case when len(list_filter(camel, lambda x: starts_with(x, '{w}'))) > 0 then 5 else 0 end + case when not contains(lower(name), '{w}') and contains(lower(coalesce(qualified_name, '')), '{w}') then 3 else 0 end)"


@query(
    "select id, name, score from nm where score > 0 order by score desc, id limit 5",
    f", cm as (select *, {_CAMEL} camel from s), nm as (select id, name, case when lower(name) = 'shardplaner' then 1000 else case when contains(lower(name), 'shardplaner') then 10 else 0 end + case when len(list_filter(camel, lambda x: starts_with(x, 'shardplaner'))) > 0 then 5 else 0 end + greatest(0, length(name) - levenshtein('shardplaner', lower(name))) * 3 end score from cm where coalesce(name, '') <> '')",
)
def near_match(spark: SparkSession, d: str) -> DataFrame:
    return R.near_matches(graph(spark, d), "type:Some.Where.ShardPlaner")


@query(f"select id, array_to_string({_CAMEL}, '|') tokens from s where kind = 'type'")
def camel_tokens(spark: SparkSession, d: str) -> DataFrame:
    s = graph(spark, d).symbols.where("kind = 'type'")
    return s.select("id", F.lower(F.array_join(R.camel_tokens(F.col("name")), "|")).alias("tokens"))


_RESOLVE = """, asked as (select distinct x input from (select s x from rawe union all select t from rawe union all select name from s) where x is not null),
  q as (select *, regexp_replace(q, '^[a-z]+:', '') stem, regexp_extract(q, '^([a-z]+):', 1) kind, not regexp_matches(q, '[:.(]') bare, string_split(regexp_replace(regexp_replace(q, '^[a-z]+:', ''), '\\(.*$', ''), '.')[-1] last from (select input, trim(input, ' ') q from asked)),
  sy as (select id, kind skind, name, regexp_replace(id, '\\(.*$', '') no_args, regexp_replace(id, '^[a-z]+:', '') sstem from s),
  rung as (select input, 1 r, id from q join sy on q.q = sy.id union select input, 2, id from q join sy on q.kind = 'method' and not contains(q.q, '(') and skind = 'method' and q.q = no_args
    union select input, 3, id from q join sy on q.kind in ('method', 'field', 'property', 'type') and skind <> 'method' and regexp_replace(q.stem, '\\(.*$', '') = sstem
    union select input, 4, id from q join sy on q.bare and lower(q.q) = lower(name)
    union select input, 5, id from q join sy on not q.bare and q.last <> '' and lower(q.last) = lower(name) and (q.kind = '' or skind = case q.kind when 'mod' then 'module' when 'ns' then 'namespace' else q.kind end)),
  best as (select input, r, count(*) n, min(id) id from rung group by 1, 2 qualify row_number() over (partition by input order by r) = 1)"""


@query("select a.input, case when b.r is null then 'NotFound' when b.n > 1 then 'Ambiguous' when b.r = 1 then 'Exact' else 'Lenient' end outcome, case when b.n = 1 then b.id end id, coalesce(b.n, 0) n_candidates from asked a left join best b using (input)", _RESOLVE)
def resolve(spark: SparkSession, d: str) -> DataFrame:
    """Resolves every id of the edges as it stands, and every symbol's bare name."""
    g = graph(spark, d)
    asked = raw_edges(spark, d).select(F.explode(F.array("source_id", "target_id")).alias("input")).where("input is not null")
    return R.resolve(g, asked.unionByName(g.symbols.where("name is not null").select(F.col("name").alias("input"))))


_SIGNED = ", dm as (select distinct c.s h, c.t m, x.name, case when x.kind = 'method' then regexp_extract(x.id, '\\((.*)\\)$', 1) end sig from c join s x on x.id = c.t where x.kind not in ('type', 'namespace')), ty as (select id, name from s where kind = 'type')"


@query(
    """select a.h type_id, a.name member, a.sig signature, case when n > 1 then 'MultipleMatches' when n = 1 then 'Unique' else 'NotFound' end outcome, n n_matches, case when n = 1 then m end id
  from (select a.h, a.name, a.sig, count(dm.m) n, min(dm.m) m from (select distinct h, name, sig from dm where sig is not null and h in (select id from ty) union select distinct h, name, 'gone' from dm where sig is not null and h in (select id from ty)) a left join dm on dm.h = a.h and dm.name = a.name and (dm.sig is null or dm.sig = a.sig) group by 1, 2, 3) a""",
    _SIGNED,
)
def resolve_member_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Every method of every type by its own signature, and by one that it does not have."""
    g = graph(spark, d)
    m = R.direct_members(g).join(g.symbols.where("kind = 'method'").select(F.col("id").alias("member"), "name"), "member").join(g.symbols.where("kind = 'type'").select(F.col("id").alias("type")), "type", "left_semi")
    m = m.select(F.col("type").alias("type_id"), F.col("name").alias("_n"), F.explode(F.array(F.regexp_extract("member", r"\((.*)\)$", 1), F.lit("gone"))).alias("signature"))
    return R.resolve_members(g, m.select("type_id", F.col("_n").alias("member"), "signature"))


@query(
    """select q.name type_name, q.member, null::varchar signature, case when k > 1 then 'AmbiguousContainingType' when n > 1 then 'MultipleMatches' when n = 1 then 'Unique' else 'NotFound' end outcome, case when k > 1 then 0 else n end n_matches, case when k = 1 and n = 1 then m end id
  from (select q.name, q.member, count(distinct ty.id) k, count(dm.m) n, min(dm.m) m from (select distinct ty.name, w.member from ty, (values ('Resolve'), ('Save')) w(member)) q join ty on ty.name = q.name left join dm on dm.h = ty.id and dm.name = q.member group by 1, 2) q
  union all select 'NoSuchType', member, null, 'TypeNotFound', 0, null from (values ('Resolve'), ('Save')) w(member)""",
    _SIGNED,
)
def resolve_member_names(spark: SparkSession, d: str) -> DataFrame:
    """Two member names in every type by its short name, which may be that of several types, and in one that is not there."""
    g = graph(spark, d)
    names = g.symbols.where("kind = 'type'").select(F.col("name").alias("type_name")).distinct().unionByName(spark.createDataFrame([("NoSuchType",)], "type_name string"))
    asked = names.select("type_name", F.explode(F.array(F.lit("Resolve"), F.lit("Save"))).alias("member"), F.lit(None).cast("string").alias("signature"))
    return R.resolve_members_by_name(g, asked)


_SPELT = ", sp as (select distinct id, replace(replace(replace(regexp_replace(regexp_replace(id, '([(,])int([,)])', '\\1System.Int32\\2', 'g'), '([(,])bool([,)])', '\\1System.Boolean\\2', 'g'), '(string', '(System.String'), ',string', ',System.String'), '(object', '(System.Object') x from s where kind = 'method')"


@query("select x input, 'Exact' outcome, id, 1::bigint n_candidates from sp where x <> id", _SPELT)
def resolve_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Ids of methods with system names of primitives in place of how ids spell them."""
    g = graph(spark, d)
    x = F.regexp_replace(F.regexp_replace("id", r"([(,])int([,)])", "$1System.Int32$2"), r"([(,])bool([,)])", "$1System.Boolean$2")
    for a, b in (("(string", "(System.String"), (",string", ",System.String"), ("(object", "(System.Object")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return R.resolve(g, g.symbols.where("kind = 'method'").select(x.alias("input"), "id").where("input <> id").select("input"))


@query(
    "select w.h type_id, w.name member, case when count(dm.m) > 1 then 'MultipleMatches' when count(dm.m) = 1 then 'Unique' else 'NotFound' end outcome, count(dm.m) n_matches, case when count(dm.m) = 1 then min(dm.m) end id from w left join dm on dm.h = w.h and dm.name = w.name group by 1, 2",
    ", dm as (select distinct c.s h, c.t m, x.name from c join s x on x.id = c.t where x.kind not in ('type', 'namespace')), w as (select id h, 'Resolve' name from s where kind = 'type')",
)
def resolve_member(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return R.resolve_members(g, g.symbols.where("kind = 'type'").select(F.col("id").alias("type_id"), F.lit("Resolve").alias("member")))
