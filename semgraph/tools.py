"""One function per tool over a loaded session, with the tools' arguments and defaults.

Every answer is a DataFrame or a small dictionary of DataFrames, lazily
planned; lists with a cap have ``full_count`` beside each row. ``envelope`` says how far an answer can be trusted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semgraph import envelope as E
from semgraph.operators import analysis as A
from semgraph.operators import audits
from semgraph.operators import context as C
from semgraph.operators import invariants as I
from semgraph.operators import reads as R
from semgraph.operators.build import Graph
from semgraph.operators.traverse import reach
from semgraph.sources.files import asset_calls

#: default caps of lists: full and summarized
CAPS = {"blast_radius": (500, 25), "dead_code": (500, 25), "file_impact": (500, 25), "asmdef_check": (200, 25), "wire_audit": (200, 25), "feature_switch_audit": (200, 25), "cycles": (500, 25)}
SECTIONS = ("summary", "high_value_files", "boundaries", "hotspots", "reading_order", "dependency_matrix")
SECTION_CAPS = {"high_value_files": 25, "boundaries": 50, "hotspots": 20, "reading_order": 50, "dependency_matrix": 100}


def capped(df: DataFrame, n: int, *order) -> tuple[DataFrame, int]:
    """The first ``n`` rows in order and the full count; below 0 all, 0 none."""
    total = df.count()
    ordered = df.orderBy(*order) if order else df
    return (ordered if n < 0 else ordered.limit(n)), total


def module_order(g: Graph) -> DataFrame:
    """``id, level``: modules after what they depend on; modules of one cycle share a level.

    The level is the longest chain of dependencies below, found by relaxing
    edges between components until nothing rises.
    """
    from semgraph.operators.scc import components
    from semgraph.session import materialize, new_folder

    mods = g.symbols.where("kind = 'module'").select("id")
    deps = g.edges.where("kind = 'dependsOn'").join(mods.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(mods.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id").distinct()
    comp = components(deps.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))
    base = new_folder(mods.sparkSession, "order")
    named = materialize(mods.join(comp, mods["id"] == comp["node"], "left").select("id", F.coalesce("component", "id").alias("c")), f"{base}/named")
    e = deps.join(named.select(F.col("id").alias("source_id"), F.col("c").alias("a")), "source_id").join(named.select(F.col("id").alias("target_id"), F.col("c").alias("b")), "target_id").where("a <> b").select("a", "b").distinct()
    e = materialize(e, f"{base}/edges")
    level = materialize(named.select("c").distinct().withColumn("level", F.lit(0)), f"{base}/0")
    i = 0
    while True:
        i += 1
        up = e.join(level, e["b"] == level["c"]).groupBy("a").agg((F.max("level") + 1).alias("got"))
        new = materialize(level.join(up, level["c"] == up["a"], "left").select("c", F.greatest("level", F.coalesce("got", F.lit(0))).alias("level"), (F.coalesce("got", F.lit(0)) > F.col("level")).alias("rose")), f"{base}/{i}")
        level = new.select("c", "level")
        if not new.where("rose").limit(1).count():
            return named.join(level, "c").select("id", "level")


def partial_view(g: Graph, files: DataFrame) -> DataFrame:
    """``id, n_files, view``: the sources of a type's files one after another. ``files(path, content)``."""
    paths = g.symbols.where("kind = 'file'").select(F.col("id").alias("source_id"), F.coalesce("file_path", F.expr("substring(id, 6)")).alias("path"))
    rows = g.contains.join(paths, "source_id").join(g.symbols.where("kind = 'type'").select(F.col("id").alias("target_id")), "target_id").select("target_id", "path").distinct().join(files.select("path", "content"), "path", "left")
    part = F.struct(F.lower("path").alias("k"), F.concat(F.lit("// "), "path", F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text"))
    return rows.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_files"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n").alias("view"))


def reflection_tests(g: Graph, files: DataFrame, target: str, covered: DataFrame) -> DataFrame:
    """Test classes that no edge links to the target but whose file names it in full, or by a short name that is unique."""
    t = g.symbols.where(F.col("id") == target).select("name", F.coalesce("qualified_name", "name").alias("full"), "kind")
    same = g.symbols.join(t.select("name", "kind"), ["name", "kind"], "left_semi").agg(F.count("*").alias("same"))
    owner = g.symbols.where(A.is_test(g.symbols)).select(F.col("parent_id").alias("test_class"), "file_path").distinct()
    rows = owner.join(covered.select("test_class"), "test_class", "left_anti").join(files.select(F.col("path").alias("file_path"), "content"), "file_path")
    # one target, so both one-row tables
    rows = rows.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(same))
    space = F.regexp_replace("full", r"\.[^.]*$", "")
    hit = F.col("content").contains(F.col("full")) | (F.col("content").contains(F.col("name")) & ((F.col("same") == 1) | F.col("content").contains(space)))
    return rows.where(hit).select(F.lit(target).alias("root"), "test_class", F.lit(2**31 - 1).alias("distance"), F.lit("Transitive").alias("confidence")).distinct()


def pipeline(g: Graph, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Coupling, cycles, tiers, blast radii of much-used types and modules, violations and the figures of all."""
    m = A.coupling(g, ("type", "module"))
    members = A.cycles(g)
    classes = A.cycle_taxonomy(g, members)
    broken = A.violations(g, rules) if rules is not None else None
    return {
        "coupling": A.coupling(g), "cycles": classes, "cycle_members": members, "tiers": A.tiers(g), "blast_radii": A.blast_radius(g, m.where("fan_in >= 3").select("id")),
        **({"violations": broken} if broken is not None else {}), "metrics": A.graph_metrics(g, broken, classes),
    }


#: nodes of parsed plans that do more than query
_DOES_MORE = ("Command", "ParsedStatement", "InsertIntoDir", "V2WriteCommand")


def _reads_only(plan) -> bool:
    """Whether a parsed plan and all in it are queries: no command, no write, no view or table made."""
    loader = plan.getClass().getClassLoader()
    kinds = [plan.getClass().forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}", True, loader) for k in _DOES_MORE]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return False
        for seq in (node.children(), node.innerChildren()):
            todo += [seq.apply(i) for i in range(seq.size())]
    return True


@dataclass(frozen=True)
class Session:
    """A loaded graph with what belongs to it; ``reload`` gives the next generation."""

    g: Graph
    rules: DataFrame | None = None
    files: DataFrame | None = None
    facts: dict[str, DataFrame] | None = None
    levels: dict[str, str] | None = None

    def reload(self, g: Graph) -> Session:
        """The rules stay with the session."""
        return replace(self, g=replace(g, generation=self.g.generation + 1))

    def envelope(self, tool: str, age_s: float = 0, changed_files: int = 0) -> E.Envelope:
        return E.decorate(tool, self.levels, age_s, changed_files, self.g.generation)

    # one symbol by its identifier in any accepted spelling
    def _at(self, symbol: str) -> DataFrame:
        asked = self.g.symbols.sparkSession.createDataFrame([(symbol,)], "input string")
        return R.resolve(self.g, asked).where("id is not null").select("id")

    def capabilities(self) -> dict:
        return E.capabilities() | {"symbols": self.g.symbols.count(), "edges": self.g.edges.count(), "generation": self.g.generation}

    def analyze(self) -> dict[str, DataFrame]:
        return pipeline(self.g, self.rules)

    def context(self, sections: tuple[str, ...] = SECTIONS, **caps: int) -> dict[str, DataFrame]:
        made = {"summary": A.graph_metrics, "high_value_files": C.high_value_files, "boundaries": C.boundaries, "hotspots": C.hotspots, "reading_order": C.reading_order, "dependency_matrix": C.dependency_matrix}
        out = {}
        for s in sections:
            if s in made:
                df, n = made[s](self.g), caps.get(s, SECTION_CAPS.get(s, -1))
                out[s] = df if n < 0 else df.limit(n)
        return out

    def lookup(self, symbol: str) -> DataFrame:
        return self._at(symbol).join(self.g.symbols, "id").join(R.partial_files(self.g), "id", "left")

    def _capped(self, tool: str, rows: DataFrame, max_results: int | None, summarize: bool, *order) -> DataFrame:
        """The first rows of a list with ``full_count`` beside them; no cap is told: that of the tool, below 0 none."""
        n = max_results if max_results is not None else CAPS[tool][1 if summarize else 0]
        some, total = capped(rows, n, *order)
        return some.withColumn("full_count", F.lit(total))

    def _links(self, symbol: str, incoming: bool, profiles: list[str] | None, group_by: str | None, exclude_tests: bool, exclude_generated: bool, buckets: list[str] | None, preview: int) -> DataFrame:
        """Links with kind, profiles and call site, and how many there were before buckets were filtered; or their groups."""
        rows = A.neighbours(self.g, self._at(symbol), incoming)
        if profiles:
            rows = A.of_profiles(rows, profiles)
        if not group_by:
            rows = rows.withColumn("total_before_filter", F.lit(rows.count()))
        hidden = ["Test"] * exclude_tests + ["Generated"] * exclude_generated
        rows = rows.where(~F.col("bucket").isin(hidden)) if hidden else rows
        rows = rows.where(F.lower("bucket").isin([b.lower() for b in buckets])) if buckets else rows
        if not group_by:
            return rows
        rows = rows.select("root", "node", "bucket").distinct().withColumn("dist", F.lit(1))
        return A.grouped(self._grouped(rows, group_by), ["root", *self._groups(group_by)], preview)

    def _groups(self, by: str) -> list[str]:
        return {"bucket": ["bucket"], "module": ["module_name"], "both": ["bucket", "module_name"]}[by]

    def _grouped(self, rows: DataFrame, by: str) -> DataFrame:
        return rows.join(A.module_name_of(self.g).withColumnRenamed("id", "node"), "node") if by != "bucket" else rows

    def dependencies(self, symbol: str, profiles=None, group_by=None, exclude_tests=False, exclude_generated=False, buckets=None, preview: int = 5) -> DataFrame:
        return self._links(symbol, False, profiles, group_by, exclude_tests, exclude_generated, buckets, preview)

    def dependants(self, symbol: str, profiles=None, group_by=None, exclude_tests=False, exclude_generated=False, buckets=None, preview: int = 5) -> DataFrame:
        return self._links(symbol, True, profiles, group_by, exclude_tests, exclude_generated, buckets, preview)

    def blast_radius(self, symbol: str, max_depth: int = 10, group_by: str | None = None, preview: int = 5, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        rows = A.blast_radius(self.g, self._at(symbol), max_depth)
        if not group_by:
            return self._capped("blast_radius", rows, max_results, summarize, "dist", "node")
        rows = rows.join(self.g.symbols.select(F.col("id").alias("node"), "bucket"), "node")
        return A.grouped(self._grouped(rows, group_by), ["root", *self._groups(group_by)], preview)

    def file_impact(self, path: str, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        f = "file:" + path.replace("\\", "/")
        rows = A.file_impact(self.g).where((F.col("source_id") == f) | (F.col("target_id") == f))
        rows = rows.select(F.when(F.col("source_id") == f, "depends_on").otherwise("used_by").alias("side"), F.when(F.col("source_id") == f, F.col("target_id")).otherwise(F.col("source_id")).alias("file"), "edge_count")
        return self._capped("file_impact", rows, max_results, summarize, "side", "file")

    def asmdef_check(self, exclude_tests: bool = False, exclude_generated: bool = False, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        rows = A.module_boundary(self.g, tuple(["Test"] * exclude_tests + ["Generated"] * exclude_generated))
        return self._capped("asmdef_check", rows, max_results, summarize, "source_module", "target_module")

    def execute(self, sql: str) -> DataFrame:
        """A read-only SELECT over the tables ``{symbols}`` and ``{edges}``.

        The parsed statement is looked at, not its text: commands and writes
        are refused wherever they stand.  Views of the session stay as they are.
        """
        spark = self.g.symbols.sparkSession
        names = {"symbols": "semgraph_symbols", "edges": "semgraph_edges"}
        text = re.sub(r"\{(symbols|edges)\}", lambda m: names[m[1]], sql)
        if not _reads_only(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
            raise ValueError("only a SELECT is run")
        return spark.sql(re.sub(r"\{(?!symbols\}|edges\})|(?<!\{symbols)(?<!\{edges)\}", lambda m: m[0] * 2, sql), symbols=self.g.symbols, edges=self.g.edges)

    def resolve_member(self, type_name: str, member: str, param_types: list[str] | None = None) -> DataFrame:
        asked = self.g.symbols.sparkSession.createDataFrame([(type_name, member, None if param_types is None else ",".join(param_types))], "type_name string, member string, signature string")
        return R.resolve_members_by_name(self.g, asked)

    def resolve_short_name(self, name: str, mode: str = "exact") -> DataFrame:
        """Symbols of the name; in none of them the five nearest, told apart by ``is_near``."""
        if mode == "fuzzy":
            return R.near_matches(self.g, name, 20)
        found = R.find_short_name(self.g, name, mode == "contains").withColumn("is_near", F.lit(False))
        if found.limit(1).count():
            return found
        return R.near_matches(self.g, name, 5).join(self.g.symbols.select("id", "kind"), "id").select("id", "kind", "name", F.lit(True).alias("is_near"))

    def dead_code(self, include_kinds=("method", "type", "property", "field"), exclude_public: bool = True, exclude_tests: bool = True, path_exclude: list[str] = (), same_class: bool = False, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        """Assets among the files of the session keep what they call alive."""
        calls = asset_calls(self.files) if self.files is not None else None
        rows = R.dead_code(self.g, tuple(include_kinds), exclude_public, exclude_tests, list(path_exclude), same_class, calls)
        return self._capped("dead_code", rows, max_results, summarize, "id")

    def dead_code_breakdown(self, **args) -> DataFrame:
        """All dead code counted by kind and bucket, whatever the cap of the list."""
        return self.dead_code(**args, max_results=-1).groupBy("kind", "bucket").agg(F.count("*").alias("n"))

    def partial_view(self, symbol: str) -> DataFrame:
        return partial_view(self.g, self.files).join(self._at(symbol), "id", "left_semi")

    def invariant_check(self, mode: str = "list", id_: str | None = None) -> DataFrame:
        rows = I.parse_invariants(self.files.where("path like '%.md'"), "path", "content")
        if id_ is not None:
            return rows.where(F.col("id") == id_)
        return {"list": lambda: rows.drop("body"), "audit": lambda: I.audit(rows), "totals": lambda: I.totals(rows), "sources": lambda: I.per_source(rows), "duplicates": lambda: I.sites(rows)}[mode]()

    def authority_report(self, symbol: str) -> DataFrame:
        return R.authority_report(self.g).join(self._at(symbol), "id", "left_semi")

    def authority_coverage(self, subjects: DataFrame, required: DataFrame, alternatives: DataFrame, max_depth: int = 6, buckets: tuple[str, ...] = ()) -> DataFrame:
        return R.authority_coverage(self.g, subjects, required, alternatives, max_depth, buckets)

    def port_health(self, symbol: str) -> DataFrame:
        return R.port_health(self.g).join(self._at(symbol), "id", "left_semi")

    def cycles(self, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        return self._capped("cycles", A.cycle_taxonomy(self.g, A.cycles(self.g)), max_results, summarize, F.desc("n_members"), "component")

    def test_impact(self, target: str, reflection: bool = False) -> DataFrame:
        """The target is a symbol or the path of a file."""
        path = F.lower(F.regexp_replace(F.translate(F.coalesce("file_path", F.expr("substring(id, 6)")), "\\", "/"), "^/+", ""))
        file = self.g.symbols.where("kind = 'file'").where(path == target.replace("\\", "/").lstrip("/").lower()).select("id")
        at = file if "/" in target and ":" not in target else self._at(target)
        found = A.test_impact(self.g, at)
        if not reflection or self.files is None:
            return found
        return found.drop("tests").unionByName(reflection_tests(self.g, self.files, target, found))

    def search(self, query: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
        return R.search(self.g, query, tuple(k.lower() for k in kinds), limit)

    def documentation(self, symbol: str) -> DataFrame:
        return self._at(symbol).join(self.g.symbols.select("id", F.col("properties")["xmlDocSummary"].alias("summary")), "id")

    # tools over compiler facts; ``facts`` holds the tables by name
    def find_references(self, symbol: str, include_declarations: bool = False) -> DataFrame:
        at = self._at(symbol).withColumnRenamed("id", "target_id")
        return audits.find_references(self.facts["references"], self.facts["declarations"] if include_declarations else None).join(at, "target_id", "left_semi")

    def find_definition(self, symbol: str) -> DataFrame:
        return audits.find_definitions(self.facts["declarations"]).join(self._at(symbol).withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi")

    def find_implementations(self, symbol: str) -> DataFrame:
        return audits.find_implementations(self.g, self._at(symbol))

    def rename(self, symbol: str, new_name: str) -> DataFrame:
        names = self._at(symbol).join(self.g.symbols.select("id", "name"), "id").withColumnRenamed("id", "target_id")
        return audits.rename_edits(self.facts["references"], names, F.lit(new_name))

    def enum_coverage(self, enum: str) -> DataFrame:
        return audits.enum_coverage(self.facts["enum_members"], self.facts["enum_refs"]).where(F.col("enum_id") == enum)

    def static_tables(self, type_: str, max_tables: int = 64, max_rows: int = 32) -> DataFrame:
        return audits.static_tables(self.facts["table_cells"].where(F.col("type_id") == type_), max_tables, max_rows)

    def assignment_coverage(self, type_: str, max_sites: int = 256) -> DataFrame:
        return audits.assignment_coverage(self.facts["construction_sites"].where(F.col("type_id") == type_), self.facts["slots"], self.facts["slot_writes"], max_sites)

    def callsite_arguments(self, symbol: str, max_sites: int = 256) -> tuple[DataFrame, DataFrame]:
        return audits.callsite_arguments(self.facts["call_args"].where(F.col("target_id") == symbol), max_sites)

    def _of(self, rows: DataFrame, type_: str | None, module: str | None) -> DataFrame:
        """Rows of members of a type, or of what lies in a module."""
        if type_ is not None:
            rows = rows.join(R.direct_members(self.g).where(F.col("type") == type_).select(F.col("member").alias("member_id")), "member_id", "left_semi")
        if module is not None:
            rows = rows.join(A.module_name_of(self.g).where(F.col("module_name") == module).select(F.col("id").alias("member_id")), "member_id", "left_semi")
        return rows

    def wire_audit(self, type_: str | None = None, module: str | None = None, include: tuple[str, ...] = audits.WIRE_FINDINGS, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        found = audits.wire_audit(self.facts["wire_candidates"], self.facts["member_accesses"], self.facts.get("call_args"))
        rows = self._of(found, type_, module).where(F.col("finding").isin(*include))
        return self._capped("wire_audit", rows, max_results, summarize, "finding", "member_id")

    def feature_switch_audit(self, require_branch: bool = True, type_: str | None = None, module: str | None = None, max_results: int | None = None, summarize: bool = False) -> DataFrame:
        found = audits.feature_switch_audit(self.facts["bool_members"], self.facts["bool_writes"], self.facts["bool_branch_reads"] if require_branch else None, self.facts["callers"])
        return self._capped("feature_switch_audit", self._of(found, type_, module), max_results, summarize, "member_id")

    def member_count(self, type_: str, semantics: str = "both") -> DataFrame:
        """``semantics``: ``reflection`` or ``source`` for one of the two counts, ``both`` for all figures."""
        rows = audits.member_count(self.facts["members"].where(F.col("type_id") == type_))
        return {"reflection": rows.select("type_id", F.col("reflection_declared").alias("members")), "source": rows.select("type_id", F.col("source_symbols").alias("members")), "both": rows}[semantics]

    def struct_layout(self, type_: str) -> DataFrame:
        return audits.struct_layout(self.facts["struct_fields"].where(F.col("type_id") == type_))

    def symbol_at_position(self, path: str, line: int, column: int | None = None) -> DataFrame:
        at = self.g.symbols.sparkSession.createDataFrame([(path, line, column)], "file_path string, line int, col int")
        return audits.symbol_at_position(self.facts["spans"], at)

    def diagnose(self, module: str | None = None, severity: str | None = None) -> DataFrame:
        return audits.diagnostics(self.facts["diagnostics"], severity, module)


def static_rows(g: Graph) -> DataFrame:
    """Constants of the fields of each type as one table of two columns: ``type_id, table_id, row_no, col_no, kind, text``."""
    f = g.symbols.where("kind = 'field' and parent_id is not null and properties['constantValue'] is not null")
    n = F.row_number().over(Window.partitionBy("parent_id").orderBy("id")) - 1
    f = f.select(F.col("parent_id").alias("type_id"), F.lit("constants").alias("table_id"), n.alias("row_no"), F.array(F.struct(F.lit("string").alias("kind"), F.col("name").alias("text")), F.struct(F.lit("constant").alias("kind"), F.col("properties")["constantValue"].alias("text"))).alias("c"))
    return f.select("type_id", "table_id", "row_no", F.posexplode("c").alias("col_no", "cell")).select("type_id", "table_id", "row_no", "col_no", "cell.kind", "cell.text")


def contained(g: Graph, ids: DataFrame) -> DataFrame:
    """Everything below some symbols, at any depth."""
    down = g.contains.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return reach(down, ids.select(F.col("id").alias("root"), F.col("id").alias("node")), None).where("dist > 0")
