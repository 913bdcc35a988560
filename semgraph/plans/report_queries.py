"""Queries of context reports, native figures and invariants, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import table
from semgraph.operators import analysis as A
from semgraph.operators import context as C
from semgraph.operators import invariants as I
from semgraph.operators import native_metrics as N
from semgraph.plans.graph_queries import _COUPLING, _MODULE, _SCC, _TIERS, _VIO, rules
from semgraph.plans.graph_source import PREFIX, cycle_members, graph, slim_edges, slim_symbols

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, more: str = "", prefix: str = PREFIX):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{prefix}{more} {sql}"
        return f

    return add


_KIDS = ", kids as (select distinct f.id, f.file_path path, c.t child from s f left join c on c.s = f.id where f.kind = 'file' and coalesce(f.file_path, '') <> '')"


@query(
    "select kids.id, path, sum(fan_in)::bigint fan_in, round(max(instability), 6) instability, coalesce(arg_min(tier, child) filter (where tier is not null), '') tier from kids join cp on cp.id = child left join tiers tr on tr.id = child group by 1, 2 having sum(fan_in) > 0 order by fan_in desc, kids.id limit 50",
    _COUPLING + _TIERS + _KIDS,
)
def high_value_files(spark: SparkSession, d: str) -> DataFrame:
    return C.high_value_files(graph(spark, d)).withColumn("instability", F.round("instability", 6))


@query("select kids.id, path, round(coalesce(min(instability), 1.0), 6) instability, coalesce(sum(fan_in), 0)::bigint fan_in from kids left join cp on cp.id = child group by 1, 2", _COUPLING + _KIDS)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return C.reading_order(graph(spark, d)).withColumn("instability", F.round("instability", 6))


@query("select id, fan_in + fan_out degree, round(instability, 6) instability from cp where not starts_with(id, 'mod:') and fan_in + fan_out > 5 and instability > 0.5 order by degree desc, id limit 20", _COUPLING)
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return C.hotspots(graph(spark, d)).withColumn("instability", F.round("instability", 6))


@query("select s.id, s.name, tr.tier, coalesce(array_to_string(list_sort(list(x.name) filter (where x.id is not null)), ','), '') depends_on, count(x.id) = 0 is_pure from s left join tiers tr on tr.id = s.id left join e on e.s = s.id and e.k = 'dependsOn' left join s x on x.id = e.t where s.kind = 'module' group by 1, 2, 3", _TIERS)
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return C.boundaries(graph(spark, d))


@query(
    "select p.s source_id, p.t target_id, greatest(coalesce(n, 1), 1)::bigint n_edges from e p left join (select a.root sm, b.root tm, count(*) n from l join ins a on a.node = l.s join ins b on b.node = l.t group by 1, 2) q on q.sm = p.s and q.tm = p.t where p.k = 'dependsOn' and p.s in (select id from s where kind = 'module')",
    ", ins(root, node) as (select c.s, c.t from c where c.s in (select id from s where kind = 'module') union select i.root, c.t from ins i join c on c.s = i.node)",
)
def dependency_matrix(spark: SparkSession, d: str) -> DataFrame:
    return C.dependency_matrix_of(slim_symbols(spark, d), slim_edges(spark, d))


@query(
    """select id || ' is pure (zero dependencies)' statement from tiers where tier = 'Pure' and starts_with(id, 'mod:')
  union all select case n when 0 then 'No architecture violations detected' else n || ' architecture violations found' end from (select count(*) n from (select distinct s, t, k, role from br))
  union all select n || ' circular dependency cycles detected' from (select count(distinct component) n from scc) where n > 0""",
    _TIERS + _SCC + _VIO,
)
def inferred_invariants(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return C.inferred_invariants(g, cycle_members(spark, d).select("component").distinct().count(), A.violations(g, rules(spark)).count())


# --- native figures

_RC = ", cl as (select s, t, k, role, case when k = 'references' and role in ({}) then role end rc from l)".format(", ".join(f"'{r}'" for r in N.ROLES))


def _sql_counts(prefix: str) -> str:
    parts = [f"count(*) filter (where k = 'references') {prefix}_references", f"count(*) filter (where k = 'calls') {prefix}_calls"]
    parts += [f'count(*) filter (where rc = \'{r}\') "{prefix}_{r}"' for r in N.ROLES]
    return ", ".join([*parts, f"count(*) filter (where rc in ({', '.join(repr(r) for r in N.TYPE_ROLES)})) {prefix}_type_references"])


_FILED = "count(*) filter (where k = 'calls' and sf = tf) sc, count(*) filter (where k = 'calls' and sf <> tf) cc"


def _zero(alias: str, prefix: str) -> str:
    names = [f"{prefix}_{x}" for x in ("references", "calls", *N.ROLES, "type_references")]
    return ", ".join(f'coalesce({alias}."{n}", 0) "{n}"' for n in names)


@query(
    f"select s.id, coalesce(dc.n, 0) declared, {_zero('o', 'out')}, coalesce(o.oc, 0) out_cross_calls, coalesce(o.lc, 0) local_calls, {_zero('i', 'in')}, coalesce(i.ic, 0) in_cross_calls from s left join dc on dc.f = s.id left join o on o.sf = s.id left join i on i.tf = s.id where s.kind = 'file'",
    _RC + f""", el as (select cl.*, a.f sf, b.f tf from cl left join filed a on a.id = cl.s left join filed b on b.id = cl.t), dc as (select f, count(*) n from filed where id <> f group by f),
  o as (select sf, {_sql_counts('out')}, count(*) filter (where k = 'calls' and sf <> tf) oc, count(*) filter (where k = 'calls' and sf = tf) lc from el where sf is not null group by sf),
  i as (select tf, {_sql_counts('in')}, count(*) filter (where k = 'calls' and sf <> tf) ic from el where tf is not null group by tf)""",
)
def native_file_metrics(spark: SparkSession, d: str) -> DataFrame:
    return N.file_metrics(graph(spark, d))


@query(
    f"select s.id, coalesce(sy.n, 0) symbols, coalesce(o.edges, 0) edges, {_zero('o', 'out')}, coalesce(o.sc, 0) same_file_calls, coalesce(o.cc, 0) cross_file_calls from s left join sy on sy.m = s.id left join o on o.m = s.id where s.kind = 'module'",
    _MODULE + _RC + f""", sy as (select m, count(*) n from mo where id <> m group by m),
  o as (select mo.m, count(*) edges, {_sql_counts('out')}, count(*) filter (where k = 'calls' and a.f = b.f) sc, count(*) filter (where k = 'calls' and a.f <> b.f) cc from cl join mo on mo.id = cl.s left join filed a on a.id = cl.s left join filed b on b.id = cl.t group by mo.m)""",
)
def native_module_metrics(spark: SparkSession, d: str) -> DataFrame:
    return N.module_metrics(graph(spark, d))


@query(
    f"select coalesce(o.s, i.t) id, {_zero('o', 'out')}, {_zero('i', 'in')}, coalesce(o.sc, 0) out_same_file_calls, coalesce(o.cc, 0) out_cross_file_calls, coalesce(i.sc, 0) in_same_file_calls, coalesce(i.cc, 0) in_cross_file_calls from o full join i on o.s = i.t",
    _RC + f", el as (select cl.*, a.f sf, b.f tf from cl left join filed a on a.id = cl.s left join filed b on b.id = cl.t), o as (select s, {_sql_counts('out')}, {_FILED} from el group by s), i as (select t, {_sql_counts('in')}, {_FILED} from el group by t)",
)
def native_symbol_metrics(spark: SparkSession, d: str) -> DataFrame:
    return N.symbol_metrics(graph(spark, d))


# --- invariants; the documents open a block without a bullet, which is put before it

_INV = r"""with lines as (select doc_id source, generate_subscripts(ls, 1) pos, unnest(ls) x from (select doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '(^|\n)\*\*INV-', '\1- **INV-', 'g'), chr(10)) ls from documents where text is not null)),
  marked as (select *, regexp_extract(x, '^\s*-\s+\*\*(INV-[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-\d+)', 1) id, regexp_matches(x, '^#{1,6}\s') head from lines),
  cut as (select *, sum((id <> '' or head)::int) over (partition by source order by pos) block from marked),
  blocks as (select source, block, arg_min(id, pos) id, min(pos) line, trim(string_agg(x, chr(10) order by pos)) body from cut group by source, block),
  inv as (select source, id, regexp_extract(id, '^INV-(.+)-\d+$', 1) category, line, regexp_replace(trim(regexp_replace(regexp_extract(body, '(?s)\*\*INV-[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-\d+\.\s+(.+?)\*\*', 1), '\s+', ' ', 'g')), '[. ]+$', '') t0, regexp_replace(regexp_replace(string_split(body, chr(10))[1], '^[-\s*]+', ''), '[*\s]+$', '') t1, case when t0 = '' then t1 else t0 end t from blocks where id <> '')"""


def _invariants(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"(^|\n)\*\*INV-", "$1- **INV-").alias("text"))
    return I.parse_invariants(docs, "doc_id", "text")


@query("select source, id, category, line::int line, case when length(t) > 140 then left(t, 139) || '…' else t end title from inv", prefix=_INV)
def invariants(spark: SparkSession, d: str) -> DataFrame:
    return _invariants(spark, d).select("source", "id", "category", "line", "title")


@query("select category, count(*) n_ids, sum(n)::bigint n_declared, count(*) filter (where n > 1) n_duplicated from (select category, id, count(*) n from inv group by 1, 2) group by 1", prefix=_INV)
def invariant_audit(spark: SparkSession, d: str) -> DataFrame:
    return I.audit(_invariants(spark, d))


@query("select count(*) n_ids, coalesce(sum(n), 0)::bigint n_declared, coalesce(sum(n - 1), 0)::bigint n_repeated from (select id, count(*) n from inv group by 1)", prefix=_INV)
def invariant_totals(spark: SparkSession, d: str) -> DataFrame:
    return I.totals(_invariants(spark, d))


@query("select source, count(*) n_declared from inv group by 1", prefix=_INV)
def invariant_sources(spark: SparkSession, d: str) -> DataFrame:
    return I.per_source(_invariants(spark, d))


@query("select id, source, line::int line, case when length(t) > 140 then left(t, 139) || '…' else t end title from inv where id in (select id from inv group by id having count(*) > 1)", prefix=_INV)
def invariant_sites(spark: SparkSession, d: str) -> DataFrame:
    return I.sites(_invariants(spark, d))


@query("select id, count(*) n, arg_min(source, (source, line)) source, arg_min(line, (source, line))::int line, arg_min(case when length(t) > 140 then left(t, 139) || '…' else t end, (source, line)) title from inv group by id having count(*) > 1", prefix=_INV)
def invariant_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(_invariants(spark, d))


@query("select rule_id, count(*) n_links from (select arg_min(rule_id, o) rule_id from br group by s, t, k, role) group by 1", _VIO)
def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    return C.broken_rules(A.violations(graph(spark, d), rules(spark)))
