"""Coupling, tiers, rules, cycles, boundaries and their figures over a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semgraph.functions.paths import matches_pattern
from semgraph.operators.build import Graph, file_of
from semgraph.operators.numbers import Numbered, file_impacts
from semgraph.operators.scc import components
from semgraph.operators.traverse import nearest_ancestor, reach, reach_by_level
from semgraph.operators.walk import groups, texts, walk
from semgraph.schema import TEST_ATTRIBUTES


def attributes(df: DataFrame, col: str = "properties") -> F.Column:
    return F.split(F.coalesce(F.col(col)["attributes"], F.lit("")), ";")


def is_test(df: DataFrame) -> F.Column:
    return (F.col("kind") == "method") & F.arrays_overlap(attributes(df), F.array(*map(F.lit, TEST_ATTRIBUTES)))


def coupling(g: Graph, kinds: tuple[str, ...] = ()) -> DataFrame:
    """``id, kind, fan_in, fan_out, instability``: distinct neighbours over links; all symbols of ``kinds`` (none: all).

    Pairs are made distinct before they are counted, so a hot target is
    combined before its shuffle.
    """
    ends = g.links.select("source_id", "target_id").distinct()
    outs = ends.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out"))
    ins = ends.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in"))
    syms = g.symbols.select("id", "kind")
    if kinds:
        syms = syms.where(F.col("kind").isin(*kinds))
    rows = syms.join(ins, "id", "left").join(outs, "id", "left").fillna(0, ["fan_in", "fan_out"])
    share = F.coalesce(F.try_divide("fan_out", F.col("fan_in") + F.col("fan_out")), F.lit(0.0))
    return rows.select("id", "kind", "fan_in", "fan_out", share.alias("instability"))


def contained_pairs(g: Graph) -> DataFrame:
    return g.contains.select(F.col("source_id").alias("parent"), F.col("target_id").alias("child")).distinct()


def tiers(g: Graph) -> DataFrame:
    """``id, tier, reason`` of modules and types."""
    wanted = g.symbols.where(F.col("kind").isin("module", "type")).select("id")
    outs = g.links.select(F.col("source_id").alias("id")).distinct().withColumn("has_out", F.lit(True))
    ins = g.links.select(F.col("target_id").alias("id")).distinct().withColumn("has_in", F.lit(True))
    tests = g.symbols.where(is_test(g.symbols)).select(F.col("id").alias("root"), F.col("id").alias("node"))
    up = g.contains.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    # what holds a test: one upward walk from all tests with the test itself forgotten
    holders = reach(up, tests.select(F.lit("test").alias("root"), "node"), None).select(F.col("node").alias("id")).withColumn("has_test", F.lit(True))
    rows = wanted.join(outs, "id", "left").join(ins, "id", "left").join(holders, "id", "left")
    tier = F.when(F.col("has_out").isNull(), "Pure").when(F.col("has_test"), "Tooling").when(F.col("has_in"), "Boundary").otherwise("Runtime")
    why = (
        F.when(tier == "Pure", "No outgoing dependencies").when(tier == "Tooling", "Contains a method tagged with a test-framework attribute")
        .when(tier == "Boundary", "Has both incoming and outgoing dependencies").otherwise("Has outgoing dependencies, no dependants")
    )
    return rows.select("id", tier.alias("tier"), why.alias("reason"))


#: rules that are broadcast at once; larger packs are held against the names in blocks
RULE_BLOCK = 10_000


def _pattern_parts(pattern: F.Column) -> tuple[F.Column, F.Column]:
    """``kind, stem`` of a pattern: all names, names with a part (``w``), or names that are or begin with a stem (``p``)."""
    p = F.lower(pattern)
    kind = F.when(p == "*", "a").when(p.startswith("*."), "w").otherwise("p")
    stem = F.when(kind == "w", p.substr(F.lit(3), F.length(p))).when(p.endswith(".*"), F.left(p, F.length(p) - 2)).otherwise(p)
    return kind, stem


def _matching(named: DataFrame, rules: DataFrame, widths: list[int]) -> DataFrame:
    """``named(source_id, s)`` with each rule whose ``pattern`` fits ``s``; ``rules`` are few.

    What a pattern fits is a run of the dotted parts of a name, from its start
    or anywhere, so names meet patterns by equality: every run from the start
    and those of the ``widths`` that patterns of parts have.
    """
    kind, stem = _pattern_parts(F.col("pattern"))
    r = F.broadcast(rules.withColumn("_kind", kind).withColumn("_stem", stem))
    parts = named.select("source_id", "s", F.split(F.lower("s"), r"\.").alias("_p"))
    run = lambda k, at, n: F.struct(F.lit(k).alias("_kind"), F.array_join(F.slice("_p", at, n), ".").alias("_stem"))
    runs = [F.transform(F.sequence(F.lit(1), F.size("_p")), lambda n: run("p", F.lit(1), n))]
    # a function of one argument: a second one would get the position
    wide = lambda w: lambda at: run("w", at, F.lit(w))
    runs += [F.when(F.size("_p") >= w, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_p") - w + 1)), wide(w))).otherwise(F.array()) for w in widths]
    met = parts.select("source_id", "s", F.explode(F.array_distinct(F.concat(*runs, F.array(F.struct(F.lit("a").alias("_kind"), F.lit("*").alias("_stem")))))).alias("_x"))
    return met.select("source_id", "s", "_x.*").join(r, ["_kind", "_stem"]).drop("_kind", "_stem")


def violations(g: Graph, rules: DataFrame, block: int = RULE_BLOCK) -> DataFrame:
    """The first rule that each link breaks: ``source_id, target_id, kind, role, rule_id, message``.

    ``rules(rule_ord, id, source, must_not_reference, may_only_reference)``,
    Rules of a null ordinal come last, those of one ordinal by their id. Rules
    are matched with the distinct names that occur, by equality of parts of the
    names and in blocks of bounded size, not with the edges.
    """
    names = g.symbols.select("id", F.coalesce(F.nullif("qualified_name", F.lit("")), "id").alias("name"))
    pairs = g.links.select("source_id", "target_id").distinct()
    pairs = pairs.join(names.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    # rules are few, so one task numbers them
    at = F.row_number().over(Window.orderBy(F.col("rule_ord").asc_nulls_last(), "id")) - 1
    r = rules.select(at.alias("rule_ord"), F.col("id").alias("rule_id"), F.col("source").alias("pattern"), "must_not_reference", "may_only_reference")
    must = F.col("must_not_reference").isNotNull() & matches_pattern(F.col("t"), F.col("must_not_reference"))
    only = F.col("may_only_reference").isNotNull() & ~matches_pattern(F.col("t"), F.col("may_only_reference")) & ~matches_pattern(F.col("t"), F.col("pattern"))
    words = F.when(must, F.concat(F.lit(" must_not_reference "), F.col("must_not_reference"))).otherwise(F.concat(F.lit(" may_only_reference "), F.col("may_only_reference")))
    message = F.concat("rule_id", F.lit(": "), "s", words)
    named = pairs.select("source_id", "s").distinct()
    kind, stem = _pattern_parts(F.col("pattern"))
    facts = r.agg(F.max("rule_ord"), F.collect_set(F.when(kind == "w", F.size(F.split(stem, r"\.")))).alias("w")).first()
    last, widths = facts[0], sorted(facts["w"])
    found = None
    for low in range(0, (last if last is not None else 0) + 1, block):
        part = r.where((F.col("rule_ord") >= low) & (F.col("rule_ord") < low + block))
        hits = pairs.drop("s").join(_matching(named, part, widths), "source_id").where(must | only).select("source_id", "target_id", "rule_ord", "rule_id", message.alias("message"))
        found = hits if found is None else found.unionByName(hits)
    broken = found.groupBy("source_id", "target_id").agg(F.min_by(F.struct("rule_id", "message"), "rule_ord").alias("v"))
    return g.links.select("source_id", "target_id", "kind", "role").join(broken, ["source_id", "target_id"]).select("source_id", "target_id", "kind", "role", "v.rule_id", "v.message")


def cycles(g: Graph) -> DataFrame:
    """``node, component`` of the components of more than one symbol; method groups in initializers are no step."""
    steps = g.links.where(~((F.col("kind") == "references") & (F.coalesce(F.col("properties")["initializerOwner"], F.lit("")) == "methodGroup")))
    return components(steps.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")))


def enclosing_types(g: Graph, nodes: DataFrame) -> DataFrame:
    """``node, type``: a type itself, the types directly in a file, else the type met first upwards."""
    kinds = g.symbols.select("id", "kind")
    mine = nodes.join(kinds, nodes["node"] == kinds["id"]).select("node", "kind")
    own = mine.where("kind = 'type'").select("node", F.col("node").alias("type"))
    types = kinds.where("kind = 'type'").select(F.col("id").alias("child"))
    files = mine.where("kind = 'file'").join(contained_pairs(g), F.col("node") == F.col("parent")).join(types, "child").select("node", F.col("child").alias("type"))
    up = nearest_ancestor(g.symbols, "kind = 'type'", 32)
    rest = mine.where("kind not in ('type', 'file')").join(up, F.col("node") == F.col("id")).where("found is not null").select("node", F.col("found").alias("type"))
    return own.unionByName(files).unionByName(rest).distinct()


def cycle_taxonomy(g: Graph, members: DataFrame) -> DataFrame:
    """``component, n_members, class``: generated, within one type, or a real loop."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n_members"))
    gen = members.join(g.symbols.where("bucket = 'Generated'").select(F.col("id").alias("node")), "node", "left_semi").select("component").distinct().withColumn("gen", F.lit(True))
    shared = members.join(enclosing_types(g, members.select("node")), "node").groupBy("component", "type").agg(F.countDistinct("node").alias("k"))
    one = shared.join(sizes, "component").where("k = n_members").select("component").distinct().withColumn("one", F.lit(True))
    kind = F.when(F.col("gen"), "GeneratedOrStaticAnalysisArtifact").when(F.col("one"), "PartialClassCluster").otherwise("LikelyRealLoop")
    return sizes.join(gen, "component", "left").join(one, "component", "left").select("component", "n_members", kind.alias("class"))


def cycle_stats(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("n_cycles"), F.sum("n_members").alias("n_symbols"), F.max("n_members").alias("largest"))


def module_of(g: Graph, hops: int = 16) -> DataFrame:
    """``id, module``: the module met first on the way up, within ``hops`` nodes; null if none."""
    return nearest_ancestor(g.symbols, "kind = 'module'", hops).select("id", F.col("found").alias("module"))


def module_name_of(g: Graph) -> DataFrame:
    names = g.symbols.select(F.col("id").alias("module"), "name")
    return module_of(g).join(names, "module", "left").select("id", F.coalesce("name", F.lit("(unknown)")).alias("module_name"))


def any_module_of(g: Graph, hops: int = 32) -> DataFrame:
    """``id, module`` by ``hops`` parents and, for what has no module there, by contains edges at any distance; of equally near ones the smallest id."""
    near = module_of(g, hops)
    mods = g.symbols.where("kind = 'module'").select(F.col("id").alias("node"))
    # a module that is met ends the way
    up = g.contains.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst")).join(mods.withColumnRenamed("node", "src"), "src", "left_anti")
    rest = near.where("module is null").select(F.col("id").alias("root"), F.col("id").alias("node"))
    met = reach(up, rest, None).join(mods, "node", "left_semi").groupBy(F.col("root").alias("id")).agg(F.min_by("node", F.struct("dist", "node")).alias("module"))
    return near.where("module is not null").unionByName(met)


def module_boundary(g: Graph, exclude_buckets: tuple[str, ...] = ()) -> DataFrame:
    """Links out of modules of direct closure to modules that they do not declare: ``source_module, target_module, n_edges, first_edge``."""
    mods = any_module_of(g)
    direct = g.symbols.where("kind = 'module' and properties['referenceClosure'] = 'DirectOnly'").select(F.col("id").alias("source_module"))
    told = g.edges.where("kind = 'dependsOn'").select(F.col("source_id").alias("source_module"), F.col("target_id").alias("target_module")).distinct()
    e = g.links.where("kind <> 'dependsOn'")
    keep = g.symbols.where(~F.col("bucket").isin(*exclude_buckets)) if exclude_buckets else g.symbols
    e = e.join(keep.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    e = e.join(mods.select(F.col("id").alias("source_id"), F.col("module").alias("source_module")), "source_id").join(direct, "source_module", "left_semi")
    e = e.join(mods.select(F.col("id").alias("target_id"), F.col("module").alias("target_module")), "target_id").where("source_module <> target_module")
    first = F.min(F.struct("source_id", "target_id", "kind_ord", "role"))
    pairs = e.join(told, ["source_module", "target_module"], "left_anti").groupBy("source_module", "target_module").agg(F.count("*").alias("n_edges"), first.alias("f"))
    return pairs.select("source_module", "target_module", "n_edges", F.concat("f.source_id", F.lit(" -> "), "f.target_id").alias("first_edge"))


def graph_metrics(g: Graph, n_violations: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """One row: symbols, edges, files, types, modules and, if given, violations and cycles."""
    s = g.symbols.agg(F.count("*").alias("symbols"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("file", "type", "module", "method")])
    out = s.crossJoin(g.edges.agg(F.count("*").alias("edges")))  # one row each
    if n_violations is not None:
        out = out.crossJoin(n_violations.agg(F.count("*").alias("violations")))
    if classes is not None:
        out = out.crossJoin(classes.agg(F.count("*").alias("cycles")))
    return out


# --- blast radius --------------------------------------------------------------------------------------------------


def blast_radius(g: Graph, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """``targets(id)`` -> ``root, node, dist``: what depends on each target, itself left out."""
    back = g.links.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    seeds = targets.select(F.col("id").alias("root"), F.col("id").alias("node"))
    return reach(back, seeds, max_depth, kept=False).where("dist > 0 and node <> root")


def blast_groups(g: Graph, targets: DataFrame, labels: DataFrame | None = None, max_depth: int = 10, preview: int = 5, held: int | None = None) -> DataFrame:
    """``root, label, n, n_direct, deepest, preview``: the blast radius of each target by ``labels(node, label)``, or as a whole.

    Figures are made where the nodes are found, so no pair leaves its task.
    """
    back = g.links.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    seeds = targets.select(F.col("id").alias("root"), F.col("id").alias("node"))
    notes = None if labels is None else labels.select("node", "label", F.col("node").alias("name"))
    near = walk(back, seeds, max_depth, groups(None if labels is None else "label", preview), "root string, label string, n long, n_direct long, deepest int, preview string", notes, held)
    if near is not None:
        return near
    rows = reach_by_level(back, seeds, max_depth).where("dist > 0 and node <> root")
    rows = rows.withColumn("label", F.lit("")) if labels is None else rows.join(labels.select("node", "label").where("label is not null"), "node")
    deep = rows.groupBy("root", "label").agg(F.max("dist").alias("deepest"))
    return grouped(rows, ["root", "label"], preview).join(deep, ["root", "label"]).select("root", "label", "n", "n_direct", "deepest", "preview")


def breaks(g: Graph, targets: DataFrame) -> DataFrame:
    """Direct dependants of each target with the gravest break: 4 for a signature, 2 for a binding; a self-loop counts."""
    rank = F.when(F.col("kind").isin("implements", "inherits", "overrides"), 4).otherwise(2)
    e = g.links.join(targets.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    kinds = F.array_sort(F.collect_set(F.struct("kind_ord", "kind")))
    rows = e.groupBy("target_id", "source_id").agg(F.max(rank).alias("severity"), kinds.alias("k"))
    word = F.when(F.col("severity") == 4, "SignatureChange").otherwise("BindingRemoval")
    return rows.select(F.col("target_id").alias("root"), F.col("source_id").alias("node"), "severity", word.alias("break_kind"), F.array_join(F.col("k.kind"), ",").alias("reason"))


def grouped(rows: DataFrame, group: list[str], preview: int = 5) -> DataFrame:
    """``rows(root, node, dist, ...)`` per group: count, direct ones and the first ``preview`` nodes by (dist, node).

    The preview is kept by a bounded window per group; groups are counted apart.
    """
    w = Window.partitionBy(*group).orderBy("dist", "node")
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("dist") == 1).alias("n_direct"))
    head = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= preview).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rn", "node"))).alias("p"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}")) for c in group]
    joined = counts.alias("c").join(head.alias("h"), same, "left")
    return joined.select(*[F.col(f"c.{c}").alias(c) for c in group], "n", "n_direct", F.array_join(F.col("p.node"), "|").alias("preview"))


def neighbours(g: Graph, targets: DataFrame, incoming: bool) -> DataFrame:
    """``root, node, kind, role, bucket, profiles, call_site``: the links of each target with the bucket of the other end."""
    here, there = ("target_id", "source_id") if incoming else ("source_id", "target_id")
    e = g.links.join(targets.select(F.col("id").alias(here)), here, "left_semi")
    b = g.symbols.select(F.col("id").alias(there), "bucket")
    return e.join(b, there).select(F.col(here).alias("root"), F.col(there).alias("node"), "kind", "role", "bucket", "profiles", "call_site")


def of_profiles(edges: DataFrame, profiles: list[str]) -> DataFrame:
    """Edges of these profiles and those of none in particular."""
    return edges.where(F.col("profiles").isNull() | F.arrays_overlap("profiles", F.array(*map(F.lit, profiles))))


def profile_counts(g: Graph) -> DataFrame:
    return g.edges.select(F.explode("profiles").alias("profile")).groupBy("profile").agg(F.count("*").alias("n_edges"))


def file_impact(g: Graph) -> DataFrame:
    """References between files with the number of edges behind them (1 if it is not told)."""
    files = g.symbols.where("kind = 'file'").select("id")
    e = g.edges.where("kind = 'references'").join(files.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(files.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    n = F.coalesce(F.expr("try_cast(properties['edgeCount'] as int)"), F.lit(1))
    return e.groupBy("source_id", "target_id").agg(F.sum(n).alias("edge_count"))


def descendants(g: Graph, roots: DataFrame) -> DataFrame:
    """``root, node, dist`` of everything contained in each root at any depth."""
    down = g.contains.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return reach(down, roots.select(F.col("id").alias("root"), F.col("id").alias("node")), None).where("node <> root")


def _impact(rows: DataFrame) -> DataFrame:
    sure = F.when(F.col("dist") == 1, "Direct").when(F.col("dist") == 2, "OneHop").otherwise("Transitive")
    return rows.select("root", F.col("label").alias("test_class"), F.col("dist").alias("distance"), sure.alias("confidence"), F.col("texts").alias("tests"))


def test_impact(g: Graph | Numbered, targets: DataFrame, max_depth: int = 12, held: int | None = None) -> DataFrame:
    """Test classes that reach each target: ``root, test_class, distance, confidence, tests``.

    A type is sought with what it directly contains, a file with all that lies in it.
    In a graph of numbers only files are targets.
    """
    if isinstance(g, Numbered):
        return _impact(file_impacts(g, targets, max_depth))
    t = targets.join(g.symbols.select("id", "kind"), "id")
    own = t.select(F.col("id").alias("root"), F.col("id").alias("node"))
    kids = t.where("kind = 'type'").join(g.contains, F.col("id") == F.col("source_id")).select(F.col("id").alias("root"), F.col("target_id").alias("node"))
    files = file_of(g.symbols)
    filed = t.where("kind = 'file'").select(F.col("id").alias("file_id")).join(files, "file_id").select(F.col("file_id").alias("root"), F.col("id").alias("node"))
    back = g.links.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    seeds = own.unionByName(kids).unionByName(filed)
    tests = g.symbols.where(is_test(g.symbols)).select(F.col("id").alias("node"), F.coalesce("qualified_name", "name").alias("text"))
    owner = nearest_ancestor(g.symbols, "kind = 'type'", 16).where("found is not null").select(F.col("id").alias("node"), F.col("found").alias("label"))
    tests = tests.join(owner, "node")
    out = walk(back, seeds, max_depth, texts, "root string, label string, dist int, texts string", tests, held)
    if out is None:
        rows = reach_by_level(back, seeds, max_depth).join(tests, "node")
        out = rows.groupBy("root", "label").agg(F.min("dist").alias("dist"), F.array_join(F.array_sort(F.collect_set("text")), ";").alias("texts"))
    return _impact(out)
