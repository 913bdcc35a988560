"""Queries over small planted inputs, for what the delivered tables do not hold: source and project files, assets, compiler facts, runs at different times.

Each SQL states the rows that must come out, told by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semgraph import envelope as E
from semgraph import tools
from semgraph.operators import analysis as A
from semgraph.operators import audits
from semgraph.operators import build as B
from semgraph.operators import invariants as I
from semgraph.operators import native_metrics as N
from semgraph.operators import reads as R
from semgraph.schema import CALL_SITE, EVIDENCE
from semgraph.session import new_folder
from semgraph.sources import files as S
from semgraph.sources import python_source
from semgraph.streaming import incremental as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def planted(columns: str, *rows: tuple):
    """Registers a query with the rows that must come out; ``columns`` as ``name type, ...`` of DuckDB."""

    def lit(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"

    def add(f):
        names = [c.split() for c in columns.split(", ")]
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"select {', '.join(f'{n}::{t} {n}' for n, t in names)} from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(n for n, _ in names)})"
        return f

    return add


def plant(spark: SparkSession, files: dict[str, str]) -> str:
    """Files written below a new folder of the shared work folder."""
    root = new_folder(spark, "planted")
    jvm = spark._jvm
    for name, text in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(text.encode()))
        out.close()
    return root


SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, line int, parent_id string, visibility string, is_abstract boolean, is_static boolean, properties map<string,string>, ord int"
EDGES = f"source_id string, target_id string, kind string, evidence {EVIDENCE}, properties map<string,string>, call_site {CALL_SITE}, profiles array<string>, ord long"


def sym(id_: str, kind: str, parent: str | None = None, path: str | None = None, props: dict | None = None, vis: str = "internal", name: str | None = None, qname: str | None = None, static: bool = False):
    return (id_, name or id_.split(":")[-1].split("(")[0].rsplit(".", 1)[-1], qname, kind, path, None, parent, vis, False, static, props or {}, 0)


def graph_of(spark: SparkSession, symbols: list[tuple], edges: list[tuple]) -> B.Graph:
    """A graph of planted symbols and edges ``(source, target, kind[, profiles])``."""
    rows = [(e[0], e[1], e[2], None, {}, None, e[3] if len(e) > 3 else None, i) for i, e in enumerate(edges)]
    return B.build(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(rows, EDGES))


# --- sources


@planted(
    "source_id varchar, target_id varchar, kind varchar",
    ("type:pkg.b.Sub", "type:pkg.a.Base", "inherits"), ("field:pkg.b.Sub.other", "type:pkg.a.Base", "none"), ("method:pkg.b.Sub.make()", "type:pkg.a.Base", "references"),
    ("type:pkg.b.Sub", "type:pkg.a.Base", "references"), ("file:pkg/b.py", "type:pkg.a.Base", "references"), ("file:pkg/b.py", "file:pkg/a.py", "references"), ("bad.py", "", "file"), ("build/c.py", "", "skipped"),
)
def python_sources(spark: SparkSession, d: str) -> DataFrame:
    """A folder of Python files: links between types, a field that links to nothing, a file that does not parse and one in a skipped folder."""
    root = plant(spark, {
        "pkg/a.py": "class Base:\n    x: int = 1\n    def run(self, n):\n        return n\n", "pkg/b.py": "from pkg.a import Base\n\nclass Sub(Base):\n    other: Base\n    @staticmethod\n    def make():\n        return Base()\n",
        "bad.py": "def (:", "build/c.py": "class Hidden: pass",
    })
    found = S.read_texts(spark, root, "*.py")
    g = B.build(*python_source.extract(found, "proj"))
    links = g.links.select("source_id", "target_id", "kind")
    lone = g.symbols.where("kind = 'field' and name = 'other'").join(links.select(F.col("source_id").alias("id")), "id", "left_anti").select("id", F.lit("type:pkg.a.Base"), F.lit("none"))
    read = found.join(g.symbols.where("kind = 'file'").select(F.col("file_path").alias("path"), F.lit("file").alias("k")), "path", "left").where("path in ('bad.py', 'build/c.py')").select("path", F.lit(""), F.coalesce("k", F.lit("skipped")))
    return links.union(lone).union(read)


_OLD = '<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003"><PropertyGroup><AssemblyName>Old.Game</AssemblyName><DefineConstants>A;;B</DefineConstants></PropertyGroup><ItemGroup><ProjectReference Include="..\\Core\\Core.csproj"/><Reference Include="Engine"><HintPath>..\\lib\\Engine.dll</HintPath></Reference></ItemGroup></Project>'
_PROJECTS = {
    "All.sln": 'Project("{G}") = "Core", "src\\Core\\Core.csproj", "{1}"\nEndProject\nProject("{G}") = "Game", "src\\Game\\Game.csproj", "{2}"\nEndProject\n',
    "src/Core/Core.csproj": '<Project Sdk="Microsoft.NET.Sdk"></Project>', "src/Game/Game.csproj": _OLD, "src/Lost/Lost.csproj": '<Project Sdk="X"><ItemGroup><PackageReference Include="N"/></ItemGroup></Project>',
}


@planted(
    "module varchar, depends_on varchar, dlls varchar, defines varchar, is_pure boolean, closure varchar, in_solution boolean",
    ("Core", "", "", "", True, "Transitive", True), ("Old.Game", "Core", "../lib/Engine.dll", "A,B", False, "DirectOnly", True), ("Lost", "", "", "", False, "Transitive", False),
)
def project_modules(spark: SparkSession, d: str) -> DataFrame:
    """Projects with their assemblies, defines and closure; one is in no solution."""
    found = S.read_texts(spark, plant(spark, _PROJECTS))
    text = lambda c: F.array_join(c, ",").alias(c)
    rows = S.modules_of_projects(found).join(S.modules_of_solutions(found).select("path", F.lit(True).alias("told")), "path", "left")
    return rows.select("module", text("depends_on"), text("dlls"), text("defines"), "is_pure", "closure", F.coalesce("told", F.lit(False)).alias("in_solution"))


@planted(
    "pack varchar, source_id varchar, target_id varchar, rule_id varchar",
    ("hexagonal", "type:A.Domain.Order", "type:A.Infrastructure.Db", "HEX-001"), ("hexagonal", "type:A.App.Service", "type:A.Infrastructure.Db", "HEX-004"), ("clean-architecture", "type:B.Entities.E", "type:B.UseCases.U", "CLEAN-001"),
    ("file", "type:A.Domain.Order", "type:A.Infrastructure.Db", "F-2"), ("file", "type:B.Entities.E", "type:B.UseCases.U", "F-3"),
)
def rule_packs(spark: SparkSession, d: str) -> DataFrame:
    """The built-in packs and one from a file, whose rules lie in the order of the file."""
    ids = ("A.Domain.Order", "A.Infrastructure.Db", "A.App.Service", "B.Entities.E", "B.UseCases.U", "A.Domains.Near")
    g = B.written(graph_of(spark, [sym(f"type:{x}", "type", qname=x) for x in ids], [(f"type:{a}", f"type:{b}", "calls") for a, b in (("A.Domain.Order", "A.Infrastructure.Db"), ("A.App.Service", "A.Infrastructure.Db"), ("B.Entities.E", "B.UseCases.U"), ("A.Domains.Near", "A.Infrastructure.Db"), ("A.App.Service", "A.Domain.Order"))]))
    rules = '{"name": "own", "version": "1", "rules": [{"id": "F-1", "source": "Nothing.*", "mustNotReference": "*"}, {"id": "F-2", "source": "A.Domain.Order", "mustNotReference": "*.Infrastructure"}, {"id": "F-3", "source": "B.Entities", "mayOnlyReference": "A.*"}, {"id": "F-9", "source": "A.Domain.*", "mustNotReference": "*"}]}'
    packs = {"hexagonal": S.built_in_rules(spark, "hexagonal"), "clean-architecture": S.built_in_rules(spark, "clean-architecture"), "file": S.read_rules(spark, plant(spark, {"own.json": rules}))}
    out = None
    for name, r in packs.items():
        rows = A.violations(g, r).select(F.lit(name).alias("pack"), "source_id", "target_id", "rule_id")
        out = rows if out is None else out.unionByName(rows)
    return out


_META = "guid: " + "a" * 32 + "\n"
_PREFAB = f"--- !u!114 &42\nMonoBehaviour:\n  m_Script: {{fileID: 11, guid: {'a' * 32}, type: 3}}\n--- !u!114 &43\nMonoBehaviour:\n  m_Calls:\n    m_Target: {{fileID: 42}}\n    m_MethodName: Go\n    m_Target: {{fileID: 7}}\n    m_MethodName: No\n"


@planted("id varchar, reason varchar", ("method:U.S.No()", "non-public method with no incoming semantic references"), ("type:U.Z", "non-public type with no incoming semantic references"))
def dead_code_with_assets(spark: SparkSession, d: str) -> DataFrame:
    """A prefab calls one method of a script and so keeps it and its type; a message method lives on a receiver; a path is excluded by its glob."""
    found = S.read_texts(spark, plant(spark, {"S.cs.meta": _META, "x.prefab": _PREFAB}))
    mono = {"baseType": "UnityEngine.MonoBehaviour"}
    g = graph_of(
        spark,
        [sym("type:U.S", "type", path="S.cs"), sym("method:U.S.Go()", "method", "type:U.S", "S.cs"), sym("method:U.S.No()", "method", "type:U.S", "S.cs"), sym("type:U.M", "type", props=mono, vis="public"), sym("type:U.Far", "type", vis="public"), sym("method:U.M.Update()", "method", "type:U.M"), sym("method:U.Far.Awake()", "method", "type:U.Far"), sym("type:U.Z", "type"), sym("type:U.Gone", "type", path="gen\\old\\G.cs")],
        [("type:U.Far", "type:U.M", "inherits")],
    )
    return R.dead_code(B.written(g), path_exclude=["gen/*/?.CS"], asset_calls=S.asset_calls(found)).select("id", "reason")


@planted(
    "id varchar, reason varchar",
    ("method:U.M.Update()", "MonoBehaviour magic method 'Update' on a Unity-message-receiver type"), ("method:U.Far.Awake()", "MonoBehaviour magic method 'Awake' on a Unity-message-receiver type"),
    ("method:U.T.Run()", "Reachable via [MenuItem] runtime entrypoint"), ("type:U.T", "Type contains member tagged [MenuItem] (Unity reflection entrypoint)"), ("method:U.C.Start()", "MonoBehaviour magic method 'Start' on a Unity-message-receiver type"),
)
def runtime_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Message methods on receivers near, by a chain of bases and by inheritance; tagged ones; one of the name on no receiver."""
    g = graph_of(
        spark,
        [sym("type:U.M", "type", props={"baseType": "UnityEngine.MonoBehaviour"}), sym("method:U.M.Update()", "method", "type:U.M"), sym("type:U.Far", "type"), sym("method:U.Far.Awake()", "method", "type:U.Far"), sym("type:U.T", "type"), sym("method:U.T.Run()", "method", "type:U.T", props={"attributes": "Obsolete;MenuItem"}), sym("type:U.C", "type", props={"baseTypeChain": "A;UnityEditor.Editor"}), sym("method:U.C.Start()", "method", "type:U.C"), sym("type:U.No", "type"), sym("method:U.No.Start()", "method", "type:U.No")],
        [("type:U.Far", "type:U.M", "inherits")],
    )
    return R.runtime_reachable(B.written(g))


@planted("path varchar", ("src/a.cs",), ("src/deep/b.cs",))
def excluded_files(spark: SparkSession, d: str) -> DataFrame:
    """Files read with two globs excluded; case does not count and ``*`` crosses folders."""
    root = plant(spark, {"src/a.cs": "a", "src/deep/b.cs": "b", "src/deep/c.g.cs": "c", "OBJ/x.cs": "x", "n.txt": "n"})
    return S.read_texts(spark, root, "*.cs", ["obj/*", "*.G.cs"]).select("path")


@planted("id varchar, n_files bigint, view varchar", ("type:N.P", 2, "// a.cs\npartial A\n// B.cs\npartial B"))
def partial_views(spark: SparkSession, d: str) -> DataFrame:
    """The sources of a type told in two files."""
    root = plant(spark, {"a.cs": "partial A", "B.cs": "partial B"})
    rows = [sym("file:a.cs", "file", path="a.cs"), sym("file:B.cs", "file", path="B.cs"), sym("type:N.P", "type", "file:a.cs", "a.cs"), sym("type:N.P", "type", "file:B.cs", "B.cs")]
    g = B.build(spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(rows)], SYMBOLS), spark.createDataFrame([], EDGES))
    return tools.partial_view(g, S.read_texts(spark, root, "*.cs"))


@planted("test_class varchar, confidence varchar", ("type:N.ByEdge", "Direct"), ("type:N.ByFullName", "Transitive"), ("type:N.ByName", "Transitive"))
def reflected_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests that an edge links to a type, that name it in full and by a name that is unique; one names something else."""
    names = ("ByEdge", "ByFullName", "ByName", "Other")
    root = plant(spark, {"ByEdge.cs": "", "ByFullName.cs": "typeof(N.T)", "ByName.cs": "Load(\"T\")", "Other.cs": "nothing"})
    symbols = [sym("type:N.T", "type", qname="N.T"), sym("method:N.T.Go()", "method", "type:N.T")]
    for n in names:
        symbols += [sym(f"type:N.{n}", "type", path=f"{n}.cs"), sym(f"method:N.{n}.Check()", "method", f"type:N.{n}", f"{n}.cs", {"attributes": "Fact"})]
    s = tools.Session(B.written(graph_of(spark, symbols, [("method:N.ByEdge.Check()", "method:N.T.Go()", "calls")])), files=S.read_texts(spark, root, "*.cs"))
    return s.test_impact("type:N.T", reflection=True).select("test_class", "confidence")


@planted(
    "id varchar, line int, title varchar, warning varchar",
    ("INV-A-1", 1, "First part", None), ("INV-A-2", 2, "Bold title", None), ("INV-B-C-3", 4, "Bare title", None), ("INV-A-4", 5, "With note", None), ("INV-A-5", 6, "Colon in", None),
    ("INV-B-6", 9, "INV-B-6: never closed", "line 9: the title of INV-B-6 is not closed"), ("INV-D-8", 10, "INV-D-8", "line 10: the title of INV-D-8 follows no form"),
)
def invariant_forms(spark: SparkSession, d: str) -> DataFrame:
    """All forms of titles, read from a Markdown file, and two that follow none."""
    text = "\n".join(["- **INV-A-1**: First part. Rest.", "- **INV-A-2. Bold\n  title.** Body", "**INV-B-C-3: Bare title** x", "- **INV-A-4** (note): With note. Rest", "- **INV-A-5:** Colon in. Rest", "# Head", "not in a block", "**INV-B-6: never closed", "- **INV-D-8**"])
    found = S.read_texts(spark, plant(spark, {"docs/invariants/a.md": text, "docs/b.txt": "- **INV-Z-1**: No."}), "*.md")
    return I.parse_invariants(found, "path", "content").select("id", "line", "title", "warning")


# --- incremental runs

_MANIFEST = "path string, module string, content_hash string, modified_at int"
_BEFORE = [("x", "m", "1", 1), ("y", "m", "1", 1), ("z", "m", "1", 1), ("m.csproj", "m", "1", 1), ("q", "n", "1", 1), ("n.csproj", "n", "1", 1)]
_AFTER = [("x", "m", "2", 2), ("y", "m", "1", 2), ("w", "m", "1", 1), ("m.csproj", "m", "1", 1), ("q", "n", "1", 1), ("n.csproj", "n", "2", 2)]


@planted(
    "path varchar, status varchar, forced varchar, told varchar",
    ("x", "changed", "changed", "same"), ("y", "touched", "touched", "touched"), ("z", "removed", "removed", "removed"), ("w", "added", "added", "added"), ("m.csproj", "same", "same", "same"), ("q", "same", "changed", "changed"), ("n.csproj", "changed", "changed", "changed"),
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two manifests; with the files of a module whose project changed; and with only some files authoritative."""
    diff = T.manifest_diff(spark.createDataFrame(_BEFORE, _MANIFEST), spark.createDataFrame(_AFTER, _MANIFEST))
    told = T.with_modules_forced(diff, spark.createDataFrame([("w",), ("n.csproj",)], "path string"))
    forced = T.with_modules_forced(diff).select("path", F.col("status").alias("forced"))
    return diff.join(forced, "path").join(told.select("path", F.col("status").alias("told")), "path").select("path", "status", "forced", "told")


@planted(
    "case_ varchar, mode varchar, reason varchar",
    ("first", "FullFallback", "NoPriorAnalysis"), ("scope", "Rejected", "AnalysisScopeChanged"), ("module", "FullFallback", "ModuleSetChanged"), ("project", "FullFallback", "ModuleDescriptorChanged"), ("files", "Incremental", None),
)
def run_modes(spark: SparkSession, d: str) -> DataFrame:
    """How a run goes on: from nothing, with another scope, other modules, another project file, and changed files only."""
    a, b = spark.createDataFrame(_BEFORE, _MANIFEST), spark.createDataFrame(_AFTER, _MANIFEST)
    one = lambda df: df.where("module = 'm'")
    cases = {"first": T.choose_mode(None, b), "scope": T.choose_mode(a, b, "s", "t", allow_full=False), "module": T.choose_mode(one(a), b), "project": T.choose_mode(a, b), "files": T.choose_mode(one(a), one(b))}
    return spark.createDataFrame([(k, *v) for k, v in cases.items()], "case_ string, mode string, reason string")


@planted("source_id varchar, target_id varchar, profiles varchar", ("a", "b", "Editor,Player"), ("b", "a", "Player"), ("a", "c", "Editor"))
def profiled_edges(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of other profiles: edges of both are one with both profiles."""
    s = spark.createDataFrame([sym(x, "type") for x in "abc"], SYMBOLS)
    run = lambda pairs, profile, at: T.tag_profile(spark.createDataFrame([(x, y, "calls", None, {}, None, None, at + i) for i, (x, y) in enumerate(pairs)], EDGES), profile)
    g = B.build(s, run([("a", "b"), ("a", "c")], "Editor", 0).unionByName(run([("b", "a"), ("a", "b")], "Player", 10)))
    return g.links.select("source_id", "target_id", F.array_join("profiles", ",").alias("profiles"))


@planted("case_ varchar, age_s bigint, changed_files bigint, stale boolean", ("soon", 60, 0, False), ("late", 7200, 0, True), ("changed", 60, 3, True))
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """A minute and two hours after a run without changes, and a minute after with two files newer and one more."""
    a, b = spark.createDataFrame(_BEFORE, _MANIFEST), spark.createDataFrame([r for r in _AFTER if r[1] == "m"], _MANIFEST)
    when = lambda s: F.lit(s).cast("timestamp")
    cases = (("soon", a, "2025-01-01 00:01:00"), ("late", a, "2025-01-01 02:00:00"), ("changed", b, "2025-01-01 00:01:00"))
    out = None
    for name, now, at in cases:
        row = T.staleness(a, now, when("2025-01-01 00:00:00"), when(at)).select(F.lit(name).alias("case_"), "age_s", "changed_files", "stale")
        out = row if out is None else out.unionByName(row)
    return out


# --- compiler facts


@planted("method_id varchar, classification varchar", ("a", "PureForwarder"), ("b", "ThinWrapper"), ("c", "RealLogic"), ("d", "RealLogic"))
def method_classes(spark: SparkSession, d: str) -> DataFrame:
    return audits.method_classes(spark.createDataFrame([("a", 1, 1, True), ("b", 5, 1, False), ("c", 6, 1, False), ("d", 2, 2, False)], "method_id string, n_statements int, n_calls int, only_forwards boolean"))


@planted("id varchar", ("e2",), ("e3",))
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of one module."""
    facts = spark.createDataFrame([("e1", "error", "n"), ("e2", "error", "m"), ("e3", "error", "m"), ("w1", "warning", "m"), ("x", None, "m")], "id string, severity string, module string")
    return audits.diagnostics(facts, "error", "m").select("id")


@planted("module varchar, units bigint, parsed bigint, failed bigint, diagnostics bigint, defines bigint, standards varchar", ("m", 2, 1, 1, 1, 3, "c11,c99"), ("n", 1, 1, 0, 0, 0, "c17"))
def build_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.unit_summary(spark.createDataFrame([("m", True, 1, 2, "c11"), ("m", None, 0, 1, "c99"), ("n", True, 0, 0, "c17")], "module string, parsed boolean, n_diagnostics int, n_defines int, standard string"))


@planted("parent_id varchar, name varchar, n bigint, ids varchar", ("type:N.T", "Go", 2, "method:N.T.Go()|method:N.T.Go(int)"))
def planted_overloads(spark: SparkSession, d: str) -> DataFrame:
    """Two methods of one name in one type; one in another type and one of another name are none."""
    return R.overloads(graph_of(spark, [sym("type:N.T", "type"), sym("type:N.U", "type"), sym("method:N.T.Go()", "method", "type:N.T"), sym("method:N.T.Go(int)", "method", "type:N.T"), sym("method:N.U.Go()", "method", "type:N.U"), sym("method:N.T.Run()", "method", "type:N.T"), sym("property:N.T.Go", "property", "type:N.T")], []))


@planted(
    "finding varchar, member_id varchar",
    ("DegenerateConstantCallSites", "b"), ("DelegateSlotNeverAssigned", "d"), ("EventRaisedNeverSubscribed", "g"), ("EventSubscribedNeverRaised", "e"), ("FieldReadWithoutWrite", "a"),
)
def planted_wires(spark: SparkSession, d: str) -> DataFrame:
    """Every finding once, with constant call sites; a field with an initializer is written."""
    c = spark.createDataFrame([("a", True, False, False, False), ("b", True, False, False, True), ("d", False, True, False, False), ("e", False, False, True, False), ("g", False, False, True, False)], "member_id string, is_rw_candidate boolean, is_delegate boolean, is_event boolean, has_initializer boolean").withColumn("file_path", F.lit("f")).withColumn("line", F.lit(1))
    acc = spark.createDataFrame([("a", "read"), ("b", "read"), ("e", "subscribe"), ("g", "fire")], "member_id string, access string")
    args = spark.createDataFrame([("b", 0, True, "1"), ("b", 0, True, "1"), ("a", 0, True, "1"), ("a", 0, True, "2")], "target_id string, ordinal int, is_constant boolean, raw_text string")
    return audits.wire_audit(c, acc, args).select("finding", "member_id")


@planted(
    "site_id int, slot varchar, state varchar, limitations varchar, confidence varchar",
    (1, "a", "Assigned", "", "Proven"), (1, "b", "Absent", "BranchedMayAssign", "Advisory"), (2, "a", "AssignedNull", "", "Proven"), (2, "b", "Absent", "EscapedBeforeWrite", "Advisory"),
)
def planted_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Writes one after another, in a branch and after the object has left."""
    sites = spark.createDataFrame([(1, "T"), (2, "T")], "site_id int, type_id string")
    slots = spark.createDataFrame([("T", "a"), ("T", "b")], "type_id string, slot string")
    w = spark.createDataFrame([(1, "a", 1, True, False, False), (1, "a", 2, False, False, False), (1, "b", 1, False, True, False), (2, "a", 1, False, False, False), (2, "a", 2, True, False, False), (2, "b", 1, False, False, True)], "site_id int, slot string, pos int, is_null boolean, in_branch boolean, after_escape boolean")
    return audits.assignment_coverage(sites, slots, w).drop("type_id")


@planted(
    "type_id varchar, size int, alignment int, offsets varchar, exactness varchar",
    ("S", 24, 8, "0,8,16", "Exact"), ("U", 16, 8, "0,2", "Advisory"), ("D", 32, 4, "0", "Exact"),
)
def planted_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Fields one after another, at explicit offsets, and in a struct of a declared size."""
    rows = [("S", 1, "a", 1, 1, True, None, None), ("S", 2, "b", 8, 8, True, None, None), ("S", 3, "c", 2, 2, True, None, None), ("U", 1, "a", 4, 4, True, 0, None), ("U", 2, "b", 8, 8, False, 2, None), ("D", 1, "a", 4, 4, True, None, 30)]
    return audits.struct_layout(spark.createDataFrame(rows, "type_id string, ordinal int, name string, size int, alignment int, is_exact boolean, explicit_offset int, declared_size int"))


@planted("target_id varchar, line int, place varchar, col int, is_declaration boolean", ("t", 1, "m", 2, False), ("t", 1, ":col5", 5, False), ("t", 3, "", 1, True))
def references_and_declarations(spark: SparkSession, d: str) -> DataFrame:
    refs = spark.createDataFrame([("t", "f", 1, 5, "m"), ("t", "f", 1, 2, "m"), ("t", "f", 1, 5, None), ("t", "f", 1, 5, "")], "target_id string, file_path string, line int, col int, containing_symbol_id string")
    return audits.find_references(refs, spark.createDataFrame([("t", "d", 3, 1)], "symbol_id string, file_path string, line int, col int")).select("target_id", "line", "place", "col", "is_declaration")


# --- session, envelope and order


@planted("tool varchar, n bigint, full_count bigint", ("dead_code", 2, 5), ("dead_code all", 5, 5), ("dead_code none", 0, None), ("blast_radius summarized", 1, 1), ("breakdown", 1, 5))
def capped_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists with a cap and the full count beside it; below 0 all rows, 0 none."""
    g = B.written(graph_of(spark, [sym(f"type:N.T{i}", "type") for i in range(6)], [("type:N.T1", "type:N.T0", "calls")]))
    s = tools.Session(g)
    cases = {"dead_code": s.dead_code(max_results=2), "dead_code all": s.dead_code(max_results=-1), "dead_code none": s.dead_code(max_results=0), "blast_radius summarized": s.blast_radius("type:N.T0", summarize=True)}
    out = None
    for name, rows in cases.items():
        row = rows.agg(F.count("*").alias("n"), F.max("full_count").cast("long").alias("full_count")).select(F.lit(name).alias("tool"), "n", "full_count")
        out = row if out is None else out.unionByName(row)
    return out.unionByName(s.dead_code_breakdown().agg(F.count("*").alias("n"), F.sum("n").alias("full_count")).select(F.lit("breakdown").alias("tool"), "n", "full_count"))


@planted(
    "tool varchar, tier varchar, band varchar, n_limits int, stale boolean",
    ("lookup", "Semantic", "Proven", 0, False), ("lookup weak", "Semantic", "Advisory", 1, False), ("dead_code", "Heuristic", "Advisory", 1, False), ("search late", "Heuristic", "Advisory", 1, True), ("unknown", "Heuristic", "Speculative", 0, False),
)
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """How far answers can be trusted, by tool, adapter levels and age; capabilities name every tool that has an envelope."""
    made = {"lookup": E.decorate("lookup"), "lookup weak": E.decorate("lookup", {"typeResolution": "bestEffort"}), "dead_code": E.decorate("dead_code", {"typeResolution": "proven"}), "search late": E.decorate("search", age_s=4_000), "unknown": E.decorate("what")}
    assert {"lookup", "dead_code", "search"} <= set(E.capabilities()["tools"])
    return spark.createDataFrame([(k, e.tier, e.band, len(e.limitations), e.stale) for k, e in made.items()], "tool string, tier string, band string, n_limits int, stale boolean")


@planted("place bigint, source_id varchar, target_id varchar, kind varchar", (0, "a", "b", "contains"), (1, "a", "b", "calls"), (2, "a", "c", "dependsOn"), (3, "b", "a", "overrides"))
def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    """Edges in their order of source, target and kind, numbered by it."""
    g = graph_of(spark, [sym(x, "type") for x in "abc"], [("b", "a", "overrides"), ("a", "c", "dependsOn"), ("a", "b", "calls"), ("a", "b", "contains")])
    return B.canonical_order(g.edges).withColumn("id", F.monotonically_increasing_id()).select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("place"), "source_id", "target_id", "kind")


@planted("asked varchar, name varchar, is_near boolean", ("go", "Go", False), ("Gop", "Go", True), ("Gop", "Longer", True), ("Gone", "Longer", True))
def near_names(spark: SparkSession, d: str) -> DataFrame:
    """A short name that is there, and two that are not and so have near ones."""
    s = tools.Session(B.written(graph_of(spark, [sym("type:N.T", "type"), sym("method:N.T.Go()", "method", "type:N.T"), sym("type:N.Longer", "type")], [])))
    out = None
    for asked in ("go", "Gop", "Gone"):
        rows = s.resolve_short_name(asked).select(F.lit(asked).alias("asked"), "name", "is_near")
        out = rows if out is None else out.unionByName(rows)
    return out
