"""Files as tables: sources, rule packs, Markdown, project files and asset files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.paths import matches_glob


def read_texts(spark: SparkSession, root: str, glob: str = "*", exclude: list[str] = ()) -> DataFrame:
    """``path`` (below ``root``), ``content`` and ``modified_at`` of every file; excluded globs are filtered on the listing's metadata."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^file:/+", "/"), "^" + root.replace("file://", "").rstrip("/") + "/", "")
    rows = rows.select(path.alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))
    return rows.where(~matches_glob(F.col("path"), list(exclude))) if exclude else rows


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule pack: ``rule_ord, id, description, source, must_not_reference, may_only_reference``."""
    schema = "name string, description string, version string, rules array<struct<id: string, description: string, source: string, mustNotReference: string, mayOnlyReference: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("rules").alias("rule_ord", "r"))
    return rows.select("rule_ord", "r.id", "r.description", "r.source", F.col("r.mustNotReference").alias("must_not_reference"), F.col("r.mayOnlyReference").alias("may_only_reference"))


# The built-in rule packs, (id, source, must not reference) each.
BUILT_IN = {
    "hexagonal": (
        ("HEX-001", "*.Domain", "*.Infrastructure"), ("HEX-002", "*.Domain", "*.Adapters"), ("HEX-003", "*.Domain", "*.Presentation"),
        ("HEX-004", "*.App", "*.Infrastructure"), ("HEX-005", "*.Domain", "UnityEngine"), ("HEX-006", "*.Domain", "System.Net.*"),
    ),
    "clean-architecture": (
        ("CLEAN-001", "*.Entities", "*.UseCases"), ("CLEAN-002", "*.Entities", "*.Adapters"), ("CLEAN-003", "*.Entities", "*.Frameworks"),
        ("CLEAN-004", "*.UseCases", "*.Adapters"), ("CLEAN-005", "*.UseCases", "*.Frameworks"),
    ),
}


def built_in_rules(spark: SparkSession, pack: str) -> DataFrame:
    """A built-in rule pack by its name."""
    rows = [(i, rule, source, must, None) for i, (rule, source, must) in enumerate(BUILT_IN[pack])]
    return spark.createDataFrame(rows, "rule_ord int, id string, source string, must_not_reference string, may_only_reference string")


def _stem(p):
    return F.regexp_replace(F.substring_index(F.translate(p, "\\", "/"), "/", -1), r"\.csproj$", "")


def modules_of_projects(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of project XML -> ``module, path, depends_on, packages, dlls, defines, is_pure, closure``.

    A module is pure if it names no package and no assembly.  Projects of the
    old schema without an Sdk see only what they name themselves.
    """
    rows = files.where(F.col("path").endswith(".csproj"))
    many = lambda what: F.expr(f"xpath(content, '{what}')")
    refs, pkgs = many('//*[local-name()="ProjectReference"]/@Include'), many('//*[local-name()="PackageReference"]/@Include')
    assemblies, dlls = many('//*[local-name()="Reference"]/@Include'), many('//*[local-name()="Reference"]/*[local-name()="HintPath"]/text()')
    defs = F.expr("xpath_string(content, '//*[local-name()=\"DefineConstants\"][1]')")
    name = F.expr("xpath_string(content, '//*[local-name()=\"AssemblyName\"][1]')")
    old = F.col("content").contains("http://schemas.microsoft.com/developer/msbuild/2003") & (F.size(many('/*[local-name()="Project"]/@Sdk')) == 0)
    return rows.select(
        F.coalesce(F.nullif(F.trim(name), F.lit("")), _stem(F.col("path"))).alias("module"), "path", F.array_sort(F.transform(refs, _stem)).alias("depends_on"), F.array_sort(pkgs).alias("packages"),
        F.array_sort(F.transform(dlls, lambda x: F.translate(x, "\\", "/"))).alias("dlls"), F.filter(F.split(defs, ";"), lambda x: F.trim(x) != "").alias("defines"),
        ((F.size(pkgs) == 0) & (F.size(assemblies) == 0)).alias("is_pure"), F.when(old, "DirectOnly").otherwise("Transitive").alias("closure"),
    )


def modules_of_solutions(files: DataFrame) -> DataFrame:
    """The modules of the projects that the solutions among ``files(path, content)`` name; of all projects where there is no solution."""
    slns = files.where(F.col("path").endswith(".sln"))
    line = F.regexp_extract_all("content", F.lit(r'(?m)^Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+\.csproj)"'), F.lit(1))
    folder = F.regexp_extract("path", r"^(.*/)?", 1)
    named = slns.select(F.explode(line).alias("p"), folder.alias("at")).select(F.concat("at", F.translate("p", "\\", "/")).alias("path")).distinct()
    modules = modules_of_projects(files)
    known = modules.join(named.withColumn("told", F.lit(True)), "path", "left")
    any_ = slns.agg(F.count("*").alias("n_solutions"))
    return known.crossJoin(F.broadcast(any_)).where("n_solutions = 0 or told").drop("told", "n_solutions")  # one row


def asset_calls(files: DataFrame) -> DataFrame:
    """Methods that serialized assets call: ``script_path, method, asset`` from asset YAML and the GUIDs of script meta files."""
    metas = files.where(F.col("path").endswith(".cs.meta")).select(F.regexp_extract("content", r"guid:\s*([0-9a-f]{32})", 1).alias("guid"), F.regexp_replace("path", r"\.meta$", "").alias("script_path"))
    assets = files.where(F.col("path").rlike(r"\.(prefab|unity|asset)$")).select(F.col("path").alias("asset"), F.explode(F.split("content", r"(?m)^--- ")).alias("part"))
    object_id = F.regexp_extract("part", r"^!u!\d+ &(-?\d+)", 1)
    scripts = assets.select("asset", object_id.alias("object"), F.regexp_extract("part", r"m_Script:\s*\{[^}]*guid:\s*([0-9a-f]{32})", 1).alias("guid")).where("guid <> ''")
    call = F.expr(r"regexp_extract_all(part, 'm_Target:\\s*\\{fileID:\\s*(-?\\d+)[^}]*\\}[^-]*?m_MethodName:\\s*(\\w+)', 0)")
    calls = assets.select("asset", F.explode(call).alias("c")).select("asset", F.regexp_extract("c", r"fileID:\s*(-?\d+)", 1).alias("object"), F.regexp_extract("c", r"m_MethodName:\s*(\w+)", 1).alias("method"))
    return calls.join(scripts, ["asset", "object"]).join(metas, "guid").select("script_path", "method", "asset").distinct()
