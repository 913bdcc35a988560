"""Composite read-side reports: dead code, ports, authorities, search and identifier lookup."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.functions.paths import matches_glob
from semgraph.operators.analysis import attributes, module_of
from semgraph.operators.build import Graph, drop_dangling, file_of
from semgraph.operators.traverse import nearest_ancestor, reach
from semgraph.schema import ENTRYPOINT_ATTRIBUTES, MESSAGE_BASES, MESSAGES
from semgraph.session import materialize, new_folder

# --- runtime reachability and dead code ----------------------------------------------------------------------------


def runtime_reachable(g: Graph, asset_calls: DataFrame | None = None) -> DataFrame:
    """``id, reason``: symbols that a runtime calls without a link: tagged ones, types of tagged members, message methods of receivers.

    With ``asset_calls(script_path, method)`` also methods that serialized assets call, and their types.
    """
    # fixed values: the sentences of the reasons
    names = F.array(*map(F.lit, ENTRYPOINT_ATTRIBUTES))
    tag = F.get(F.filter(attributes(g.symbols), lambda a: F.array_contains(names, a)), F.lit(0))
    tagged = g.symbols.select("id", tag.alias("tag")).where("tag is not null")
    own = tagged.select("id", F.concat(F.lit("Reachable via ["), "tag", F.lit("] runtime entrypoint")).alias("reason"), F.lit(1).alias("rank"))
    base = F.col("properties")["baseType"]
    chain = F.split(F.coalesce(F.col("properties")["baseTypeChain"], F.lit("")), ";")
    bases = F.array(*map(F.lit, MESSAGE_BASES))
    types = g.symbols.where("kind = 'type'")
    # the next base: the recorded one, else the first Inherits edge
    inherits = g.edges.where("kind = 'inherits'").groupBy("source_id").agg(F.min("target_id").alias("up"))
    receives = F.arrays_overlap(chain, bases) | F.coalesce(F.array_contains(bases, base), F.lit(False))
    lines = types.join(inherits, types["id"] == inherits["source_id"], "left").select(
        "id", F.coalesce(F.concat(F.lit("type:"), F.nullif(base, F.lit(""))), "up").alias("parent_id"),
        (receives | (base.isNull() & F.coalesce(F.array_contains(bases, F.regexp_replace("up", "^type:", "")), F.lit(False)))).alias("receives"),
    )
    receivers = nearest_ancestor(lines, "receives", 32).where("found is not null").select(F.col("id").alias("parent_id"))
    messages = g.symbols.where((F.col("kind") == "method") & F.col("name").isin(*MESSAGES)).join(receivers, "parent_id", "left_semi")
    magic = messages.select("id", F.concat(F.lit("MonoBehaviour magic method '"), "name", F.lit("' on a Unity-message-receiver type")).alias("reason"), F.lit(2).alias("rank"))
    kids = g.contains.join(tagged, F.col("target_id") == F.col("id")).groupBy("source_id").agg(F.min_by("tag", "target_id").alias("tag"))
    hosts = types.select("id").join(kids, F.col("id") == F.col("source_id")).select("id", F.concat(F.lit("Type contains member tagged ["), "tag", F.lit("] (Unity reflection entrypoint)")).alias("reason"), F.lit(3).alias("rank"))
    if asset_calls is not None:
        called = g.symbols.where("kind = 'method'").join(asset_calls.select(F.col("script_path").alias("file_path"), F.col("method").alias("name")).distinct(), ["file_path", "name"], "left_semi")
        both = called.select(F.explode(F.array("id", "parent_id")).alias("id")).where("id is not null").distinct()
        hosts = hosts.unionByName(both.select("id", F.lit("Called by a serialized asset").alias("reason"), F.lit(4).alias("rank")))
    return own.unionByName(magic).unionByName(hosts).groupBy("id").agg(F.min_by("reason", "rank").alias("reason"))


def scaffolding_types(g: Graph) -> DataFrame:
    """Static non-public types whose members are all conditional methods or constant static strings."""
    syms = g.symbols
    conditional = (F.col("kind") == "method") & F.array_contains(attributes(syms), "Conditional")
    p = F.col("properties")
    anchor = (F.col("kind") == "field") & F.coalesce("is_static", F.lit(False)) & F.coalesce(p["fieldType"].isin("string", "System.String"), F.lit(False)) & p["constantValue"].isNotNull()
    members = g.contains.select("source_id", "target_id").distinct().join(syms.select("id", F.coalesce(conditional | anchor, F.lit(False)).alias("ok")), F.col("target_id") == F.col("id"))
    full = members.groupBy("source_id").agg(F.bool_and("ok").alias("all_ok")).where("all_ok")
    types = syms.where("kind = 'type' and is_static and visibility <> 'public'").select("id")
    return types.join(full.select(F.col("source_id").alias("id")), "id", "left_semi")


def dead_code(g: Graph, kinds=("method", "type", "property", "field"), exclude_public: bool = True, exclude_tests: bool = True, path_exclude: list[str] = (), same_class: bool = False, asset_calls: DataFrame | None = None) -> DataFrame:
    """Symbols without incoming links that nothing keeps alive: ``id, kind, file_path, line, bucket, reason, direct_dependants``.

    ``asset_calls`` are those of ``runtime_reachable``.
    """
    s = g.symbols.where(F.col("kind").isin(*kinds))
    if exclude_public:
        s = s.where("visibility <> 'public'")
    if exclude_tests:
        s = s.where("bucket <> 'Test'")
    if path_exclude:
        s = s.where(~matches_glob(F.col("file_path"), list(path_exclude)))
    s = s.where("not (kind = 'method' and (name = '.cctor' or coalesce(properties['synthesized'], '') = 'true'))")
    s = s.join(g.edges.where("kind = 'implements'").select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    parents = g.symbols.select(F.col("id").alias("source_id"), F.col("parent_id").alias("source_parent"))
    if same_class:
        # only links whose source has another parent keep a symbol alive; it needs the parents of all sources
        e = g.links.select("source_id", "target_id").join(parents, "source_id")
        e = e.join(g.symbols.select(F.col("id").alias("target_id"), F.col("parent_id").alias("own_parent")), "target_id")
        ins = e.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_in"), F.count_if(F.coalesce(F.col("source_parent") != F.col("own_parent"), F.lit(True))).alias("n_other"))
        s = s.join(ins, "id", "left").fillna(0, ["n_in", "n_other"]).where("n_other = 0")
    else:
        s = s.join(g.links.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti").withColumn("n_in", F.lit(0).cast("long"))
    s = s.join(runtime_reachable(g, asset_calls).select("id"), "id", "left_anti")
    hosts = scaffolding_types(g)
    s = s.join(hosts.select("id", F.lit(True).alias("_self")), "id", "left").join(hosts.select(F.col("id").alias("parent_id"), F.lit(True).alias("_parent")), "parent_id", "left")
    scaffold = F.coalesce("_self", "_parent", F.lit(False))
    scope = F.lit("non-public " if exclude_public else "")
    tail = F.when(scaffold, " scaffolding with no incoming semantic references").when(F.col("n_in") > 0, F.concat(F.lit(" with only same-class consumers ("), "n_in", F.lit(")"))).otherwise(" with no incoming semantic references")
    return s.select("id", "kind", "file_path", "line", F.when(scaffold, "Scaffolding").otherwise(F.col("bucket")).alias("bucket"), F.concat(scope, "kind", tail).alias("reason"), F.col("n_in").alias("direct_dependants"))


# --- interfaces ----------------------------------------------------------------------------------------------------


def interface_closure(g: Graph) -> DataFrame:
    """``root, node``: every type that each type inherits at any distance."""
    steps = g.edges.where("kind = 'inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    seeds = steps.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    # a type is among its own ancestors only if it lies on a cycle; the walk itself never comes back to it
    got = reach(steps, seeds, None)
    back = got.join(steps.select(F.col("src").alias("node"), F.col("dst").alias("root")), ["root", "node"], "left_semi").select("root", F.col("root").alias("node")).distinct()
    return got.where("dist > 0").select("root", "node").unionByName(back).distinct()


def direct_contracts(g: Graph) -> DataFrame:
    """``id, contract``: what an interface inherits and what any other type implements."""
    face = g.symbols.where("kind = 'type'").select("id", (F.coalesce(F.col("properties")["typeKind"], F.lit("")) == "interface").alias("face"))
    return _contracts(face, g.edges)


def _contracts(types: DataFrame, edges: DataFrame) -> DataFrame:
    """``direct_contracts`` of ``types(id, face)``."""
    e = edges.where("kind in ('inherits', 'implements')").join(types, F.col("source_id") == F.col("id"))
    return e.where("(face and kind = 'inherits') or (not face and kind = 'implements')").select("id", F.col("target_id").alias("contract")).distinct()


def direct_members(g: Graph) -> DataFrame:
    """``type, member``: what a symbol contains, nested types left out."""
    kids = g.symbols.where("kind <> 'type'").select(F.col("id").alias("member"))
    return g.contains.select(F.col("source_id").alias("type"), F.col("target_id").alias("member")).distinct().join(kids, "member", "left_semi")


def port_health(g: Graph) -> DataFrame:
    """Per interface the share of its members, inherited ones too, that anything uses."""
    faces = g.symbols.where("kind = 'type' and coalesce(properties['typeKind'], '') = 'interface'").select(F.col("id").alias("root"))
    members = direct_members(g)
    closure = interface_closure(g).join(faces, "root", "left_semi")
    own = faces.join(members, F.col("root") == F.col("type")).select("root", "member", F.lit(1).alias("own"))
    inherited = closure.join(members, F.col("node") == F.col("type")).select("root", "member", F.lit(0).alias("own"))
    each = own.unionByName(inherited).groupBy("root", "member").agg(F.max("own").alias("own"))
    alive = g.links.select(F.col("target_id").alias("member")).unionByName(g.edges.where("kind = 'implements'").select(F.col("source_id").alias("member"))).distinct().withColumn("alive", F.lit(1))
    each = each.join(alive, "member", "left")
    rows = faces.join(each.groupBy("root").agg(F.count("*").alias("members"), F.sum("own").alias("own"), F.count("alive").alias("live")), "root", "left").fillna(0)
    pct = F.coalesce(F.try_divide("live", "members"), F.lit(0.0))
    verdict = F.when(F.col("members") == 0, "empty").when(pct >= 0.75, "healthy").when(pct >= 0.25, "mixed").otherwise("vestigial")
    return rows.select(F.col("root").alias("id"), "members", F.col("own").alias("direct_members"), F.col("live").alias("live_members"), F.bround(pct, 3).alias("liveness"), verdict.alias("verdict"))


def authority_report(g: Graph) -> DataFrame:
    """Per type: contracts, public surface, forwarders, consumers in its own and in other modules, and for interfaces whether one type implements it."""
    types = g.symbols.where("kind = 'type'").select("id", (F.coalesce(F.col("properties")["typeKind"], F.lit("")) == "interface").alias("face"))
    contracts = direct_contracts(g).groupBy("id").agg(F.count("*").alias("n_contracts"))
    info = g.symbols.select(F.col("id").alias("member"), "kind", "visibility", F.col("properties")["classification"].alias("class"))
    members = direct_members(g).join(types.select(F.col("id").alias("type")), "type", "left_semi")
    m = members.join(info, "member").groupBy(F.col("type").alias("id")).agg(
        F.count_if(F.col("kind").isin("method", "property", "field") & (F.col("visibility") == "public")).alias("public_surface"),
        F.count_if(F.col("kind") == "method").alias("methods"),
        F.count_if((F.col("kind") == "method") & F.col("class").isNotNull()).alias("classified"),
        F.count_if((F.col("kind") == "method") & (F.col("class") == "PureForwarder")).alias("forwarders"),
    )
    mods = module_of(g).where("module is not null")
    parts = types.select(F.col("id").alias("type"), F.col("id").alias("member")).unionByName(members.select("type", "member"))
    uses = g.edges.where("kind in ('calls', 'references')").select("source_id", F.col("target_id").alias("member")).distinct()
    uses = parts.join(uses, "member").select("type", "source_id").distinct()
    uses = uses.join(mods.select(F.col("id").alias("type"), F.col("module").alias("own")), "type").join(mods.select(F.col("id").alias("source_id"), "module"), "source_id")
    # distinct pairs first, so that a hot type is combined before it is counted
    cross = uses.where("module <> own").select("type", "module").distinct().groupBy(F.col("type").alias("id")).agg(F.count("*").alias("cross_modules"))
    same = uses.where("module = own").groupBy(F.col("type").alias("id")).agg(F.count("*").alias("same_consumers"))
    impl = g.edges.where("kind = 'implements'").select("source_id", F.col("target_id").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("implementers"))
    rows = types.join(contracts, "id", "left").join(m, "id", "left").join(cross, "id", "left").join(same, "id", "left").join(impl, "id", "left").fillna(0)
    ratio = F.when((F.col("classified") == 0) | (F.col("methods") == 0), -1.0).otherwise(F.bround(F.try_divide("forwarders", "methods"), 3))
    single = F.when(F.col("face"), F.col("implementers") == 1)
    return rows.select("id", "n_contracts", "public_surface", "methods", ratio.alias("forwarder_ratio"), "cross_modules", "same_consumers", single.alias("single_implementer"))


def interface_usage(g: Graph) -> DataFrame:
    """Per type and direct contract: own, inherited and all members, and distinct users of it, its members and its ancestors."""
    up = g.edges.where("kind = 'inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    uses = g.edges.where("kind in ('calls', 'references')").select("source_id", F.col("target_id").alias("part"))
    return _usage(direct_contracts(g), up, direct_members(g), lambda parts: parts.join(uses, "part").withColumnRenamed("source_id", "user"))


def _usage(contracts: DataFrame, up: DataFrame, members: DataFrame, used: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``interface_usage`` of ``contracts(id, contract)``, ``up(src, dst)`` and ``members(type, member)``.

    ``used`` makes ``at, user`` of ``parts(at, part)``, the numbers of types with
    them and their members. Only contracts are walked from, and members looked up
    of what they reach. Users are joined once for each distinct set of ancestors,
    and a contract's own ones added where they are not among them, so that a much
    used ancestor is not multiplied by what inherits it.
    """
    base = new_folder(contracts.sparkSession, "usage")
    pairs = materialize(contracts, f"{base}/pairs")
    faces = materialize(pairs.select(F.col("contract").alias("root")).distinct(), f"{base}/faces")
    # from the parents on, so that a contract is among its own ancestors only if it lies on a cycle
    ups = reach(up, faces.join(up, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")), None).select("root", "node")
    nodes = faces.select(F.col("root").alias("node")).unionByName(ups.select("node")).distinct()
    nodes = materialize(nodes.withColumn("at", F.monotonically_increasing_id()), f"{base}/nodes")
    members = materialize(members.join(nodes.select(F.col("node").alias("type")), "type", "left_semi").select("type", "member").distinct(), f"{base}/members")
    sizes = members.groupBy(F.col("type").alias("node")).agg(F.count("*").alias("direct_members"))
    inherited = ups.join(sizes, "node").groupBy(F.col("root").alias("contract")).agg(F.sum("direct_members").alias("inherited_members"))
    parts = nodes.select("at", F.col("node").alias("part")).unionByName(nodes.join(members, F.col("node") == F.col("type")).select("at", F.col("member").alias("part")))
    users = materialize(used(materialize(parts.distinct(), f"{base}/parts")).select("at", "user").distinct(), f"{base}/users")

    of = materialize(ups.join(nodes, "node").groupBy("root").agg(F.sort_array(F.collect_set("at")).alias("above")), f"{base}/above")
    sets = materialize(of.select("above").distinct().withColumn("set", F.monotonically_increasing_id()), f"{base}/sets")
    of = materialize(faces.join(of.join(sets, "above").select("root", "set"), "root", "left").join(nodes.withColumnRenamed("node", "root"), "root"), f"{base}/of")
    above = materialize(sets.select("set", F.explode("above").alias("at")).join(users, "at").select("set", "user").distinct(), f"{base}/users_above")
    own = of.select("at", "set").join(users, "at").join(above, ["set", "user"], "left_anti").groupBy("at").agg(F.count("*").alias("own"))
    users = of.join(own, "at", "left").join(above.groupBy("set").agg(F.count("*").alias("n")), "set", "left").fillna(0, ["own", "n"]).select(F.col("root").alias("contract"), (F.col("own") + F.col("n")).alias("consumers"))
    rows = pairs.join(sizes.withColumnRenamed("node", "contract"), "contract", "left").join(inherited, "contract", "left").join(users, "contract", "left").fillna(0)
    return rows.select("id", "contract", "direct_members", "inherited_members", (F.col("direct_members") + F.col("inherited_members")).alias("all_members"), "consumers")


def interface_usage_of(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``interface_usage`` of rows of which no graph was built.

    ``symbols(id, no, kind, face, file_path, parent_id)`` with numbers ``no``, one row an id;
    ``edges(source_id, target_id, kind)`` as told. Ends are looked up for
    inheritance and containment, and for what uses a contract. References
    between files, which are derived in a graph, are asked for only where a
    file is part of a contract.
    """
    base = new_folder(symbols.sparkSession, "faces")
    edges = edges.where("source_id is not null and target_id is not null").select("source_id", "target_id", "kind")
    few = materialize(edges.where("kind in ('contains', 'inherits', 'implements')").distinct(), f"{base}/few")
    few = materialize(drop_dangling(few, symbols.select("id")), f"{base}/living")
    kids = symbols.where("kind <> 'type'")
    told = few.where("kind = 'contains'").select(F.col("source_id").alias("type"), F.col("target_id").alias("member")).join(kids.select(F.col("id").alias("member")), "member", "left_semi")
    made = kids.where("parent_id is not null and parent_id <> id").select(F.col("parent_id").alias("type"), F.col("id").alias("member"))
    up = few.where("kind = 'inherits'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    contracts = _contracts(symbols.where("kind = 'type'").select("id", "face"), few)

    def used(parts: DataFrame) -> DataFrame:
        found = parts.join(edges.where("kind in ('calls', 'references')").select("source_id", F.col("target_id").alias("part")), "part")
        found = found.join(symbols.select(F.col("id").alias("source_id"), F.col("no").alias("user")), "source_id").select("at", "user")
        files = materialize(parts.join(symbols.where("kind = 'file' or id like 'file:%'").select(F.col("id").alias("part")), "part", "left_semi").select("at", "part"), f"{base}/files")
        if files.isEmpty():
            return found
        filed = file_of(symbols)
        there = filed.join(files.select(F.col("part").alias("file_id")).distinct(), "file_id", "left_semi").select(F.col("id").alias("target_id"), F.col("file_id").alias("part"))
        ends = edges.where("kind <> 'contains'").join(there, "target_id").select("source_id", "part").distinct()
        ends = ends.join(filed.select(F.col("id").alias("source_id"), "file_id"), "source_id").where("file_id <> part").select("file_id", "part").distinct()
        ends = ends.join(symbols.select(F.col("id").alias("file_id"), F.col("no").alias("user")), "file_id")
        return found.unionByName(files.join(ends, "part").select("at", "user"))

    return _usage(contracts, up, told.select("type", "member").unionByName(made), used)


def _way_to(g: Graph, parts: DataFrame, max_depth: int) -> list[DataFrame]:
    """``alt, node, dist, end, authority, next, via`` by distance: how far each node is from the nearest part of required and allowed authorities, and the first step there.

    Of parts equally near the least holds, of ways to it the first one: each
    step is the least by target, kind and role, as a walk from the node would
    meet it. A walk from the parts has two rows a node, however many seeds ask.
    """
    base = new_folder(parts.sparkSession, "way")
    none = F.lit(None).cast("string")
    first = parts.groupBy("alt", F.col("part").alias("node")).agg(F.min("authority").alias("authority"))
    front = materialize(first.select("alt", "node", F.lit(0).alias("dist"), F.col("node").alias("end"), "authority", none.alias("next"), none.alias("via")), f"{base}/0")
    levels = [front]
    steps = g.links.select("source_id", "target_id", "kind_ord", "role", "kind")
    for depth in range(1, max_depth + 1):
        seen = Observation()
        hop = F.min(F.struct("end", "target_id", "kind_ord", "role", "kind", "authority")).alias("h")
        after = steps.join(front.select("alt", F.col("node").alias("target_id"), "end", "authority"), "target_id").groupBy("alt", F.col("source_id").alias("node")).agg(hop)
        after = after.join(reduce(DataFrame.unionByName, [x.select("alt", "node") for x in levels]), ["alt", "node"], "left_anti")
        after = after.select("alt", "node", F.lit(depth).alias("dist"), "h.end", "h.authority", F.col("h.target_id").alias("next"), F.col("h.kind").alias("via"))
        front = materialize(after.observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/{depth}")
        if not seen.get["n"]:
            break
        levels.append(front)
    return levels


def authority_coverage(g: Graph, subjects: DataFrame, required: DataFrame, alternatives: DataFrame, max_depth: int = 6, buckets: tuple[str, ...] = ()) -> DataFrame:
    """Whether what lies in each subject reaches a required authority or an allowed alternative, and by which path.

    ``subjects(id)``, ``required(id)``, ``alternatives(id)`` -> ``id, status,
    distance, seed, authority, path, vias``. Seeds are the methods in a type,
    namespace or file, else the subject; an authority stands for all it contains.
    """
    s = subjects.join(g.symbols.select("id", "kind"), "id")
    down = g.contains.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    wide = reach(down, s.where("kind in ('type', 'namespace', 'file')").select(F.col("id").alias("root"), F.col("id").alias("node")), None)
    methods = g.symbols.where("kind = 'method'").select(F.col("id").alias("node"))
    seeds = wide.join(methods, "node", "left_semi").select("root", "node").unionByName(s.where("kind not in ('type', 'namespace', 'file')").select(F.col("id").alias("root"), F.col("id").alias("node")))
    if buckets:
        seeds = seeds.join(g.symbols.where(F.col("bucket").isin(*buckets)).select(F.col("id").alias("node")), "node", "left_semi")
    seeds = materialize(seeds.distinct(), new_folder(seeds.sparkSession, "seeds"))
    ends = required.select("id", F.lit(0).alias("alt")).unionByName(alternatives.select("id", F.lit(1).alias("alt")))
    parts = reach(down, ends.select(F.col("id").alias("root"), F.col("id").alias("node")), None).select(F.col("root").alias("authority"), F.col("node").alias("part")).join(ends, F.col("authority") == F.col("id")).select("authority", "part", "alt")
    levels = _way_to(g, parts, max_depth)
    near = reduce(DataFrame.unionByName, [x.select("alt", "node", "dist", "end", "authority") for x in levels])
    best = seeds.join(near, "node").groupBy("root").agg(F.min(F.struct("alt", "dist", F.col("node").alias("seed"), "end", "authority")).alias("b"))
    best = best.select("root", "b.*").withColumns({"at": F.col("seed"), "left": F.col("dist"), "nodes": F.array("seed"), "vias": F.array().cast("array<string>")})
    # a way is followed level by level, each level looked at once
    for level in reversed(levels[1:]):
        hop = level.select(F.col("alt").alias("_alt"), F.col("node").alias("_node"), F.col("dist").alias("_dist"), "next", "via")
        best = best.join(hop, (F.col("alt") == F.col("_alt")) & (F.col("at") == F.col("_node")) & (F.col("left") == F.col("_dist")), "left")
        went = F.col("next").isNotNull()
        best = best.select(
            "root", "alt", "dist", "seed", "authority", F.coalesce("next", "at").alias("at"), F.when(went, F.col("left") - 1).otherwise(F.col("left")).alias("left"),
            F.when(went, F.concat("nodes", F.array("next"))).otherwise(F.col("nodes")).alias("nodes"), F.when(went, F.concat("vias", F.array("via"))).otherwise(F.col("vias")).alias("vias"),
        )
    best = best.select("root", F.struct("alt", "dist", "seed", "authority", "nodes", "vias").alias("b"))
    has = seeds.select("root").distinct().withColumn("has", F.lit(True))
    rows = s.select(F.col("id").alias("root")).join(has, "root", "left").join(best, "root", "left")
    status = F.when(F.col("has").isNull(), "NoSubjectSeeds").when(F.col("b").isNull(), "MissingRequired").when(F.col("b.alt") == 0, "RequiredReached").otherwise("AllowedAlternativeReached")
    return rows.select(F.col("root").alias("id"), status.alias("status"), F.col("b.dist").alias("distance"), F.col("b.seed").alias("seed"), F.col("b.authority").alias("authority"), F.array_join("b.nodes", " > ").alias("path"), F.array_join("b.vias", ",").alias("vias"))


def partial_files(g: Graph) -> DataFrame:
    """``id, n_files, files``: every file that a type lies in, and the primary one first named for it."""
    files = g.symbols.where("kind = 'file'").select(F.col("id").alias("source_id"), F.coalesce("file_path", F.expr("substring(id, 6)")).alias("path"))
    rows = g.contains.join(files, "source_id").join(g.symbols.where("kind = 'type'").select(F.col("id").alias("target_id"), "name"), "target_id")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    rank = F.when(F.lower(stem) == F.lower("name"), 0).when(F.lower(stem).startswith(F.concat(F.lower("name"), F.lit("."))), 1).otherwise(2)
    best = F.min_by("path", F.struct(rank, F.when(rank == 1, F.length("path")).otherwise(0), F.lower("path")))
    return rows.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct(F.lower("path")).alias("n_files"), best.alias("primary_file"), F.array_join(F.array_sort(F.collect_set("path")), "|").alias("files"))


# --- search and identifiers ----------------------------------------------------------------------------------------


def camel_tokens(name: Column) -> Column:
    """A name cut before each capital that follows a letter that is none."""
    return F.split(name, r"(?<=[^\p{Lu}])(?=\p{Lu})")


def query_tokens(query: str) -> list[str]:
    out: dict[str, str] = {}
    for piece in re.split(r"[\s,;.:/\\_\-]+", query):
        if len(piece) >= 3:
            out.setdefault(piece.lower(), piece)
    return list(out.values()) or ([query.strip()] if query.strip() else [])


#: characters before and after a word found in a documentation that a snippet shows
SNIPPET = 40


def _snippet(text: Column, word: str) -> Column:
    """What stands around the first ``word`` of a text that has it, with signs of omission."""
    at = F.instr(F.lower(text), word)
    start, end = F.greatest(F.lit(1), at - SNIPPET), F.least(F.length(text), at + len(word) + SNIPPET - 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), text.substr(start, end - start + 1), F.when(end < F.length(text), "…").otherwise(""))


def search(g: Graph, query: str, kinds: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """Ranked symbols: ``id, kind, name, score, match_kind, snippets``; one scan, no explosion by token."""
    s = g.symbols.where("coalesce(name, '') <> ''")
    if kinds:
        s = s.where(F.col("kind").isin(*kinds))
    told = F.coalesce(F.col("properties")["xmlDocSummary"], F.lit(""))
    name, qname, doc = F.lower("name"), F.lower(F.coalesce("qualified_name", F.lit(""))), F.lower(told)
    camel = F.transform(camel_tokens(F.col("name")), F.lower)
    score, hits, around = F.lit(0), [F.lit(False)] * 3, []
    for t in query_tokens(query):
        tok = t.lower()
        n, q, d = name.contains(tok), ~name.contains(tok) & qname.contains(tok), doc.contains(tok)
        score = score + F.when(n, 10).otherwise(0) + F.when(F.exists(camel, lambda c: c.startswith(tok)), 5).otherwise(0) + F.when(q, 3).otherwise(0) + F.when(d, 5).otherwise(0)
        hits = [hits[0] | n, hits[1] | q, hits[2] | d]
        around.append(F.when(d, _snippet(told, tok)))
    many = sum(h.cast("int") for h in hits)
    kind = F.when(many > 1, "Multiple").when(hits[0], "Name").when(hits[1], "QualifiedName").otherwise("XmlDoc")
    shown = F.array_compact(F.array(
        F.when(hits[0], F.concat(F.lit("name: "), "name")), F.when(hits[1], F.concat(F.lit("qualifiedName: "), "qualified_name")),
        F.when(hits[2], F.concat(F.lit("xmlDoc: "), F.coalesce(*around, F.lit("")))),
    ))
    rows = s.select("id", "kind", "name", score.alias("score"), kind.alias("match_kind"), shown.alias("snippets")).where("score > 0")
    return rows.withColumn("score", F.col("score") + (2 if kinds else 0)).orderBy(F.desc("score"), "id").limit(limit)


def short_name_of(text: str) -> str:
    """The last name in an identifier: without kind, parameters and what is before the last dot."""
    t = re.sub(r"^[a-z]+:", "", text)
    t = t.split("(", 1)[0]
    return t.rsplit(".", 1)[-1]


def near_matches(g: Graph, query: str, limit: int = 5) -> DataFrame:
    """Symbols whose names are closest: ``id, name, score``."""
    q = short_name_of(query) or query
    low = q.lower()
    name = F.lower("name")
    close = F.length("name") - F.levenshtein(F.lit(low), name)
    score = F.when(name.contains(low), 10).otherwise(0) + F.when(F.exists(F.transform(camel_tokens(F.col("name")), F.lower), lambda c: c.startswith(low)), 5).otherwise(0) + F.when(close > 0, close * 3).otherwise(0)
    if q != query:
        score = F.when(name == low, 1000).otherwise(score)
    return g.symbols.where("coalesce(name, '') <> ''").select("id", "name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def find_short_name(g: Graph, name: str, contains: bool = False) -> DataFrame:
    test = F.lower("name").contains(name.lower()) if contains else F.lower("name") == name.lower()
    return g.symbols.where(test).select("id", "kind", "name")


def overloads(g: Graph) -> DataFrame:
    """Methods of one name in one parent, where there is more than one."""
    rows = g.symbols.where("kind = 'method' and parent_id is not null").groupBy("parent_id", "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))
    return rows.where("n > 1")


#: fixed values: system names of primitives and how ids spell them
PRIMITIVES = {
    "System.Boolean": "bool", "System.Byte": "byte", "System.SByte": "sbyte", "System.Char": "char", "System.Decimal": "decimal", "System.Double": "double",
    "System.Single": "float", "System.Int32": "int", "System.UInt32": "uint", "System.Int64": "long", "System.UInt64": "ulong", "System.Int16": "short",
    "System.UInt16": "ushort", "System.Object": "object", "System.String": "string", "System.Void": "void", "System.IntPtr": "nint", "System.UIntPtr": "nuint",
}


def canonical_ids(text: Column) -> Column:
    """Ids with primitives as ids spell them, at the borders of a token."""
    out = text
    for long, short in PRIMITIVES.items():
        out = F.regexp_replace(out, rf"(?<![\w.]){re.escape(long)}(?![\w.])", short)
    return F.when(text.contains("System."), out).otherwise(text)


def resolve(g: Graph, inputs: DataFrame) -> DataFrame:
    """``inputs(input)`` -> ``input, outcome, id, n_candidates``: the first rung of the ladder that finds anything.

    Rungs: the exact id, a method without its parameters, a member of another
    kind with that name, a bare short name, the last name in the text with the
    given kind; several candidates on a rung are ambiguous.
    """
    base = new_folder(inputs.sparkSession, "asked")
    # inputs are spelt once, when they are distinct: every rung reads them
    asked = materialize(inputs.select("input").distinct(), f"{base}/inputs")
    q = materialize(asked.select("input", canonical_ids(F.trim("input")).alias("q")), f"{base}/spelt")
    q = q.withColumn("stem", F.regexp_replace("q", r"^[a-z]+:", "")).withColumn("kind", F.regexp_extract("q", r"^([a-z]+):", 1)).withColumn("bare", ~F.col("q").rlike("[:.(]"))
    q = q.withColumn("last", F.substring_index(F.regexp_replace("stem", r"\(.*$", ""), ".", -1))
    full = F.create_map(*[F.lit(x) for x in ("mod", "module", "file", "file", "ns", "namespace", "type", "type", "method", "method", "field", "field", "property", "property")])
    s = g.symbols.select("id", F.col("kind").alias("skind"), "name", F.regexp_replace("id", r"\(.*$", "").alias("no_args"), F.regexp_replace("id", r"^[a-z]+:", "").alias("sstem"))
    rung = lambda n, df: df.select("input", F.lit(n).alias("rung"), "id")
    found = rung(1, q.join(s, q["q"] == s["id"]))
    found = found.unionByName(rung(2, q.where("kind = 'method' and instr(q, '(') = 0").join(s.where("skind = 'method'"), F.col("q") == F.col("no_args"))))
    found = found.unionByName(rung(3, q.where("kind in ('method', 'field', 'property', 'type')").join(s.where("skind <> 'method'"), F.regexp_replace("stem", r"\(.*$", "") == F.col("sstem"))))
    best = found.distinct().groupBy("input", "rung").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    # symbols are counted per name and kind before they are joined: many inputs may ask for a name that many symbols have
    names = s.groupBy(F.lower("name").alias("lname"), "skind").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    all_ = names.groupBy("lname").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    of = lambda n, df: df.select("input", F.lit(n).alias("rung"), "id", "n")
    best = best.unionByName(of(4, q.where("bare").join(all_, F.lower("q") == F.col("lname"))))
    last = q.where("not bare and last <> ''")
    best = best.unionByName(of(5, last.where("kind = ''").join(all_, F.lower("last") == F.col("lname"))))
    best = best.unionByName(of(5, last.where("kind <> ''").join(names, (F.lower("last") == F.col("lname")) & (F.col("skind") == full[F.col("kind")]))))
    best = best.groupBy("input").agg(F.min(F.struct("rung", "n", "id")).alias("b"))
    outcome = F.when(F.col("b").isNull(), "NotFound").when(F.col("b.n") > 1, "Ambiguous").when(F.col("b.rung") == 1, "Exact").otherwise("Lenient")
    rows = asked.join(best, "input", "left")
    return rows.select("input", outcome.alias("outcome"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("id"), F.coalesce("b.n", F.lit(0).cast("long")).alias("n_candidates"))


def resolve_members(g: Graph, wanted: DataFrame) -> DataFrame:
    """``wanted(type_id, member, signature)`` -> ``type_id, member, signature, outcome, n_matches, id``; nested types and namespaces are no members.

    A signature, the parameter types joined by commas, tells methods of one
    name apart; other members and a null signature (or none in ``wanted``) do
    not look at it.
    """
    if "signature" not in wanted.columns:
        return resolve_members(g, wanted.withColumn("signature", F.lit(None).cast("string"))).drop("signature")
    wanted = wanted.select("type_id", "member", "signature").distinct()
    types = g.symbols.where("kind = 'type'").select(F.col("id").alias("type_id"), F.lit(True).alias("is_type"))
    kids = g.contains.select(F.col("source_id").alias("type_id"), F.col("target_id").alias("id")).distinct()
    kids = kids.join(g.symbols.where("kind not in ('type', 'namespace')").select("id", F.col("name").alias("member"), F.when(F.col("kind") == "method", F.regexp_extract("id", r"\((.*)\)$", 1)).alias("of")), "id")
    hits = wanted.join(kids, ["type_id", "member"]).where("signature is null or of is null or of = signature").groupBy("type_id", "member", F.col("signature").alias("sig")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    same = (F.col("w.type_id") == F.col("h.type_id")) & (F.col("w.member") == F.col("h.member")) & F.col("w.signature").eqNullSafe(F.col("h.sig"))
    rows = wanted.alias("w").join(hits.alias("h"), same, "left").select("w.*", "h.n", "h.id")
    rows = rows.join(types, "type_id", "left")
    outcome = F.when(F.col("is_type").isNull(), "TypeNotFound").when(F.col("n").isNull(), "NotFound").when(F.col("n") > 1, "MultipleMatches").otherwise("Unique")
    return rows.select("type_id", "member", "signature", outcome.alias("outcome"), F.coalesce("n", F.lit(0).cast("long")).alias("n_matches"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def resolve_members_by_name(g: Graph, asked: DataFrame) -> DataFrame:
    """``asked(type_name, member, signature)`` -> ``type_name, member, signature, outcome, n_matches, id``.

    A type is named by its id, its id without the kind or its short name; a
    name of several types is ambiguous.
    """
    asked = asked.select("type_name", "member", "signature").distinct()
    types = g.symbols.where("kind = 'type'").select("id", "name")
    names = types.select(F.explode(F.array(F.col("id"), F.regexp_replace("id", "^type:", ""), F.col("name"))).alias("type_name"), "id").distinct()
    found = names.join(asked.select("type_name").distinct(), "type_name", "left_semi").groupBy("type_name").agg(F.count("*").alias("n_types"), F.min("id").alias("type_id"))
    rows = asked.join(found, "type_name", "left")
    one = rows.where("n_types = 1")
    told = one.select("type_name", "type_id").distinct().join(resolve_members(g, one.select("type_id", "member", "signature")), "type_id").select("type_name", "member", "signature", "outcome", "n_matches", "id")
    none = rows.where("n_types is null or n_types > 1").select("type_name", "member", "signature", F.when(F.col("n_types").isNull(), "TypeNotFound").otherwise("AmbiguousContainingType").alias("outcome"), F.lit(0).cast("long").alias("n_matches"), F.lit(None).cast("string").alias("id"))
    return told.unionByName(none)
