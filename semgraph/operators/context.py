"""What a reader of a code base is told first: files, boundaries, hotspots, the matrix of modules, a reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semgraph.operators.analysis import contained_pairs, coupling, tiers
from semgraph.operators.build import Graph, file_id
from semgraph.operators.traverse import reach
from semgraph.session import materialize, new_folder


def _file_children(g: Graph) -> DataFrame:
    """``file, path, child`` of every file that has a path."""
    files = g.symbols.where("kind = 'file' and coalesce(file_path, '') <> ''").select(F.col("id").alias("parent"), F.col("file_path").alias("path"))
    return files.join(contained_pairs(g), "parent", "left").select(F.col("parent").alias("file"), "path", "child")


def high_value_files(g: Graph, limit: int = 50) -> DataFrame:
    """Files by what depends on their parts: ``id, path, fan_in, instability, tier``."""
    m = coupling(g).select(F.col("id").alias("child"), "fan_in", "instability")
    t = tiers(g).select(F.col("id").alias("child"), "tier")
    rows = _file_children(g).join(m, "child").join(t, "child", "left")
    out = rows.groupBy(F.col("file").alias("id"), "path").agg(
        F.sum("fan_in").alias("fan_in"), F.max("instability").alias("instability"),
        F.coalesce(F.min_by("tier", F.when(F.col("tier").isNotNull(), F.col("child"))), F.lit("")).alias("tier"),
    )
    return out.where("fan_in > 0").orderBy(F.desc("fan_in"), "id").limit(limit)


def reading_order(g: Graph, limit: int | None = None) -> DataFrame:
    """All files, stable and much used ones first; a file without measured parts counts as unstable."""
    m = coupling(g).select(F.col("id").alias("child"), "fan_in", "instability")
    rows = _file_children(g).join(m, "child", "left").groupBy(F.col("file").alias("id"), "path").agg(F.coalesce(F.min("instability"), F.lit(1.0)).alias("instability"), F.coalesce(F.sum("fan_in"), F.lit(0).cast("long")).alias("fan_in"))
    ordered = rows.orderBy("instability", F.desc("fan_in"), "id")
    return ordered if limit is None else ordered.limit(limit)


def hotspots(g: Graph, limit: int = 20) -> DataFrame:
    m = coupling(g).where("id not like 'mod:%' and fan_in + fan_out > 5 and instability > 0.5")
    return m.select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"), "instability").orderBy(F.desc("degree"), "id").limit(limit)


def boundaries(g: Graph) -> DataFrame:
    """Modules with their tier and the names that they depend on."""
    mods = g.symbols.where("kind = 'module'").select("id", "name")
    deps = g.edges.where("kind = 'dependsOn'").join(g.symbols.select(F.col("id").alias("target_id"), F.col("name").alias("dep")), "target_id")
    deps = deps.groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dep")), ",").alias("depends_on"))
    return mods.join(tiers(g).select("id", "tier"), "id", "left").join(deps, "id", "left").select("id", "name", "tier", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.col("depends_on").isNull().alias("is_pure"))


def _inside(mods: DataFrame, contains: DataFrame) -> DataFrame:
    """``mods(root, id)``, ``contains(source_id, target_id)`` -> ``root, node``: what lies in each module at any depth, itself on a cycle.

    Only what contains something is walked; the rest lies where its parents lie,
    told once for each parent.
    """
    down = contains.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    inner = down.join(down.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    at = reach(inner, mods.select("root", F.col("id").alias("node")), None, kept=False).select("root", F.col("node").alias("src"))
    return at.join(down, "src").select("root", F.col("dst").alias("node"))


def dependency_matrix(g: Graph) -> DataFrame:
    """Links between what two modules contain, for each pair with a declared dependency; at least 1."""
    mods = g.symbols.where("kind = 'module'").select("id")
    inside = materialize(_inside(mods.select(F.col("id").alias("root"), "id"), g.contains).distinct(), new_folder(mods.sparkSession, "inside"))
    pairs = g.edges.where("kind = 'dependsOn'").join(mods.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("source_id", "target_id", "role")
    # members are known to lie in few modules each, so the two lookups multiply an edge by those only
    e = g.links.groupBy("source_id", "target_id").agg(F.count("*").alias("k"))
    e = e.join(inside.select(F.col("node").alias("source_id"), F.col("root").alias("sm")), "source_id").join(inside.select(F.col("node").alias("target_id"), F.col("root").alias("tm")), "target_id")
    n = e.groupBy(F.col("sm").alias("source_id"), F.col("tm").alias("target_id")).agg(F.sum("k").alias("n"))
    return pairs.join(n, ["source_id", "target_id"], "left").select("source_id", "target_id", F.greatest(F.coalesce("n", F.lit(1).cast("long")), F.lit(1).cast("long")).alias("n_edges"))


def dependency_matrix_of(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``dependency_matrix`` of rows of which no graph was built.

    ``symbols(id, no, kind, file_path, parent_id)`` with numbers ``no``, one row
    an id; ``edges(source_id, target_id, kind, role)`` as told. What lies in a
    module exists, so links need no look-up of missing ends; they meet their
    modules and files once an end, and go on as numbers. What lies in several
    modules has a number below 0 for all of them, so that no edge is multiplied.
    References between files are derived for files that lie in a module, as others
    count nowhere.
    """
    base = new_folder(symbols.sparkSession, "matrix")
    edges = edges.where("source_id is not null and target_id is not null")
    few = materialize(edges.where("kind in ('contains', 'dependsOn') or (kind = 'references' and source_id like 'file:%' and target_id like 'file:%')").distinct(), f"{base}/few")
    told = few.where("kind = 'contains'").select("source_id", "target_id").join(symbols.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    made = symbols.where("parent_id is not null and parent_id <> id").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"))
    mods = symbols.where("kind = 'module'").select(F.col("no").alias("root"), "id")
    inside = _inside(mods, materialize(told.select("source_id", "target_id"), f"{base}/told").unionByName(made))
    inside = materialize(inside.groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_set("root")).alias("mods")), f"{base}/inside")
    several = inside.where("size(mods) > 1")
    sets = materialize(several.select("mods").distinct().withColumn("at", -1 - F.monotonically_increasing_id()), f"{base}/sets")
    inside = inside.where("size(mods) = 1").select("id", F.col("mods")[0].alias("at")).unionByName(several.join(sets, "mods").select("id", "at"))
    lies = mods.select(F.col("root").alias("at"), "root").unionByName(sets.select("at", F.explode("mods").alias("root")))
    files = symbols.where("kind = 'file' or id like 'file:%'").join(inside, "id").select(F.col("id").alias("file_id"), F.col("no").alias("file"), "at")
    files = materialize(files, f"{base}/files")
    filed = symbols.select("id", file_id().alias("file_id")).join(files.select("file_id", "file"), "file_id").select("id", "file")
    place = materialize(inside.join(filed, "id", "full"), f"{base}/place")

    # a source's edges are made distinct where they meet its modules
    links = edges.where("kind <> 'contains'").select("source_id", "target_id", "kind", "role").repartition("source_id").distinct()
    links = links.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))
    ends = links.join(place.select(F.col("id").alias("source_id"), F.col("at").alias("sm"), F.col("file").alias("sf")), "source_id").drop("source_id")
    ends = ends.join(place.select(F.col("id").alias("target_id"), F.col("at").alias("tm"), F.col("file").alias("tf")), "target_id")
    ends = ends.where("(sm is not null and tm is not null) or sf <> tf").groupBy("sm", "sf", "tm", "tf").agg(F.sum("n").alias("n"))
    ends = materialize(ends, f"{base}/ends")

    name = lambda end, to: files.select(F.col("file_id").alias(end), F.col("file").alias(to))
    known = few.where("kind = 'references'").join(name("source_id", "sf"), "source_id").join(name("target_id", "tf"), "target_id").select("sf", "tf").distinct()
    derived = ends.where("sf <> tf").select("sf", "tf").distinct().join(known, ["sf", "tf"], "left_anti")
    derived = derived.join(files.select(F.col("file").alias("sf"), F.col("at").alias("sm")), "sf").join(files.select(F.col("file").alias("tf"), F.col("at").alias("tm")), "tf")
    each = ends.where("sm is not null and tm is not null").groupBy("sm", "tm").agg(F.sum("n").alias("n"))
    each = each.unionByName(derived.groupBy("sm", "tm").agg(F.count("*").alias("n")))

    # the links of a module by where they end, which meet the places in the modules that it declares
    each = each.join(lies.withColumnRenamed("at", "sm"), "sm").groupBy("root", "tm").agg(F.sum("n").alias("n"))
    pairs = few.where("kind = 'dependsOn'").join(mods.withColumnRenamed("id", "source_id"), "source_id").join(symbols.select(F.col("id").alias("target_id"), "no"), "target_id")
    pairs = materialize(pairs.select("source_id", "target_id", "root", "no"), f"{base}/pairs")
    n = pairs.select("root", "no").distinct().join(lies.select(F.col("root").alias("no"), F.col("at").alias("tm")), "no").join(each, ["root", "tm"]).groupBy("root", "no").agg(F.sum("n").alias("n"))
    return pairs.join(n, ["root", "no"], "left").select("source_id", "target_id", F.greatest(F.coalesce("n", F.lit(1).cast("long")), F.lit(1).cast("long")).alias("n_edges"))


def inferred_invariants(g: Graph, n_cycles: int, n_violations: int) -> DataFrame:
    """Statements that hold: pure modules, cycles, violations."""
    pure = tiers(g).where("tier = 'Pure' and id like 'mod:%'").select(F.concat("id", F.lit(" is pure (zero dependencies)")).alias("statement"))
    told = ([f"{n_cycles} circular dependency cycles detected"] if n_cycles else []) + [f"{n_violations} architecture violations found" if n_violations else "No architecture violations detected"]
    return pure.unionByName(g.symbols.sparkSession.createDataFrame([(t,) for t in told], "statement string"))


def broken_rules(violations: DataFrame) -> DataFrame:
    """``rule_id, n_links``: each rule that is broken."""
    return violations.groupBy("rule_id").agg(F.count("*").alias("n_links"))


def instructions(g: Graph, violations: DataFrame | None = None, n_cycles: int = 0, max_files: int = 15, max_violations: int = 20) -> str:
    """A short guide in Markdown: all modules with what they depend on, the pure ones, the first violations, much used files and figures.

    The driver gets a row per module, so this serves code bases whose modules fit in a guide.
    """
    mods = boundaries(g).orderBy("name", "id").collect()
    lines = ["# Code base", "", "## Modules", "", *[f"- {r['name']}: {r['depends_on'] or 'no dependencies'}" for r in mods]]
    pure = [r["name"] for r in mods if r["is_pure"]]
    if pure:
        lines += ["", "Pure modules: " + ", ".join(pure)]
    n_broken = 0
    if violations is not None:
        n_broken = violations.count()
        if n_broken:
            lines += ["", "## Violations", "", *[f"- {r['message']}" for r in violations.orderBy("source_id", "target_id", "kind", "role").limit(max_violations).collect()]]
            if n_broken > max_violations:
                lines.append(f"- and {n_broken - max_violations} more")
    lines += ["", "## Files to know", ""]
    lines += [f"- {r['path']} ({r['fan_in']} dependants, {r['tier'] or 'no tier'})" for r in high_value_files(g, max_files).collect()]
    lines += ["", "## Figures", "", f"- symbols: {g.symbols.count()}", f"- edges: {g.edges.count()}", f"- modules: {len(mods)}", f"- violations: {n_broken}", f"- cycles: {n_cycles}"]
    return "\n".join(lines) + "\n"
