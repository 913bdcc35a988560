"""Parent-child links to full hierarchies by parallel tree contraction.

Every round rakes the leaves into their parents and splices an independent set
of unary nodes out of their chains (a node goes if its hash is the largest
among itself, its parent and its only child), so O(log n) rounds are expected
for any shape of tree, a path included.  Each round is one job of two joins on
the unique node id; the tables shrink geometrically, and the last rounds, over
at most ``LAST_ROWS`` nodes, run in one task.  The written rounds are then read
backwards: a raked node hangs below its parent, a spliced one between its
parent and its child, which gives roots, depths, sizes and paths.  What never
contracts is a cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.session import discard, frequent_keys, materialize, new_folder

MAX_ROUNDS = 400
#: nodes that are left when the remaining rounds are made by one task, whatever the input's size; its memory is bounded by this
LAST_ROWS = 20_000
#: rounds that are always made by all tasks
FIRST_ROUNDS = 2


def living_parents(nodes: DataFrame, hot: list) -> DataFrame:
    """``nodes(id, parent, key)`` with ids unique -> ``id, p``: keys of the node and its parent, null if that is no node.

    ``hot`` parents of very many children (fewer than 200 of them) are looked
    up apart, so that no task of the join gets all their children.
    """
    ids = nodes.select(F.col("id").alias("pid"), F.col("key").alias("p"))
    if hot:
        keys = [x for r in ids.where(F.col("pid").isin(hot)).collect() for x in (F.lit(r["pid"]), F.lit(r["p"]))]
        found = F.create_map(*keys)[F.col("parent")] if keys else F.lit(None).cast(nodes.schema["key"].dataType)
        rest = nodes.withColumn("_rest", F.when(~F.col("parent").isin(hot), F.col("parent"))).withColumn("_hot", F.when(F.col("parent").isin(hot), found))
        joined = rest.join(ids, rest["_rest"] == ids["pid"], "left")
        return joined.select(F.col("key").alias("id"), F.coalesce("_hot", "p").alias("p"))
    return nodes.join(ids, nodes["parent"] == ids["pid"], "left").select(F.col("key").alias("id"), "p")


def _round(state: DataFrame, salt: int, paths: bool) -> DataFrame:
    """One rake and one compress of the rows that are not done."""
    live = state.where("status <> 'done'")
    kids = live.where("p is not null").groupBy(F.col("p").alias("kp")).agg(
        F.count_if(F.col("status") == "live").alias("nk"),
        F.min(F.when(F.col("status") == "live", F.col("id"))).alias("kid"),
        F.sum(F.when(F.col("status") == "raked", F.col("w") + F.col("e")).otherwise(F.lit(0))).alias("got"),
    )
    own = live.where("status = 'live'")
    seg = ["seg"] if paths else []
    one = own.join(kids, own["id"] == kids["kp"], "left").select(
        "id", "p", (F.col("w") + F.coalesce("got", F.lit(0))).alias("w"), "e", "d", "mn", *seg,
        F.coalesce("nk", F.lit(0)).alias("nk"), "kid",
    )
    rank = lambda c: F.struct(F.xxhash64(F.lit(salt), F.col(c)), F.col(c))
    spliced = (F.col("nk") == 1) & F.col("p").isNotNull() & (F.col("kid") != F.col("id")) & (rank("id") > rank("p")) & (rank("id") > rank("kid"))
    one = one.withColumn("goes", F.coalesce(spliced, F.lit(False)))
    message = one.where("goes").select(
        F.col("kid").alias("to"), F.col("id").alias("u"), F.col("p").alias("up"), F.col("w").alias("uw"),
        F.col("e").alias("ue"), F.col("d").alias("ud"), F.col("mn").alias("umn"), *([F.col("seg").alias("useg")] if paths else []),
    )
    both = one.where("not goes").join(message, one["id"] == message["to"], "left")
    told = F.col("u").isNotNull()
    status = (
        F.when((F.col("nk") == 0) & F.col("p").isNotNull() & ~told, "raked")
        .when((F.col("nk") == 0) & F.col("p").isNull(), "done")
        .when((F.col("nk") == 1) & (F.col("p") == F.col("id")), "done")
        .otherwise("live")
    )
    return both.select(
        "id",
        F.coalesce("up", "p").alias("p"),
        "w",
        F.when(told, F.col("e") + F.col("uw") + F.col("ue")).otherwise(F.col("e")).alias("e"),
        F.when(told, F.col("d") + F.col("ud")).otherwise(F.col("d")).alias("d"),
        F.least("mn", "u", "umn").alias("mn"),
        *([F.when(told, F.concat("useg", F.array("u"), "seg")).otherwise(F.col("seg")).alias("seg")] if paths else []),
        status.alias("status"),
        # the spliced node, kept with its child until it is put back
        "u", "ud", "uw", F.when(told, F.col("e")).alias("below_e"), *(["useg"] if paths else []),
    )


def _finished(rows: DataFrame, paths: bool) -> DataFrame:
    """Results of roots and of the nodes that cycles shrank to; ``root`` is a key."""
    cyc = F.col("p").isNotNull()
    return rows.where("status = 'done'").select(
        "id",
        F.when(cyc, F.least("id", "mn")).otherwise(F.col("id")).alias("root"),
        F.when(cyc, -1).otherwise(0).cast("long").alias("depth"),
        F.when(cyc, F.col("w") + F.col("e")).otherwise(F.col("w")).alias("size"),
        cyc.alias("cyc"),
        *([F.array("id").alias("path")] if paths else []),
    )


def _last_rounds(state: DataFrame, paths: bool) -> DataFrame:
    """Results of the live nodes of a state of at most ``LAST_ROWS`` rows: leaves are raked until none is left, what stays is cycles, and all is put back top down."""
    kind = state.schema["id"].dataType.simpleString()
    cols = ["id", "p", "w", "e", "d", "mn", "status", *(["seg"] if paths else [])]
    out = f"id {kind}, root {kind}, depth bigint, size bigint, cyc boolean" + (f", path array<{kind}>" if paths else "")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        live = {r["id"]: r for r in rows if r["status"] == "live"}
        size, kids = {i: r["w"] for i, r in live.items()}, dict.fromkeys(live, 0)
        for r in rows:
            if r["p"] in live:
                if r["status"] == "raked":
                    size[r["p"]] += r["w"] + r["e"]
                else:
                    kids[r["p"]] += 1
        leaves, order = [i for i, n in kids.items() if not n], []
        while leaves:
            i = leaves.pop()
            order.append(i)
            up = live[i]["p"]
            if up is not None:
                size[up] += size[i] + live[i]["e"]
                kids[up] -= 1
                if not kids[up]:
                    leaves.append(up)
        found: dict = {}
        raked = set(order)
        for i in live:
            if i not in raked and i not in found:
                ring = [i]
                while live[ring[-1]]["p"] != i:
                    ring.append(live[ring[-1]]["p"])
                whole = sum(size[x] + live[x]["e"] for x in ring)
                root = min(m for x in ring for m in (x, live[x]["mn"]) if m is not None)
                found |= {x: (root, -1, whole, True, [x]) for x in ring}
        for i in reversed(order):
            r = live[i]
            if r["p"] is None:
                found[i] = (i, 0, size[i], False, [i])
            else:
                root, depth, _, _, path = found[r["p"]]
                found[i] = (root, -1 if depth < 0 else depth + r["d"], size[i], False, [*path, *r["seg"], i] if paths else None)
        table = [(i, *(f if paths else f[:4])) for i, f in found.items()]
        if table:
            names = ["id", "root", "depth", "size", "cyc", "path"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table)], names=names[: len(table[0])])

    return state.where("status <> 'done'").select(*cols).repartition(1).mapInArrow(finish, out)


def _put_back(rows: DataFrame, known: DataFrame, paths: bool, hot: list) -> DataFrame:
    """Results of the nodes that one round removed, from those of the nodes that stayed longer; children of ``hot`` parents are joined apart."""
    key = rows.schema["id"].dataType
    raked = rows.where("status = 'raked'").select(
        "id", "p", "d", F.col("w").alias("own"), F.lit(None).cast(key).alias("c"), *(["seg"] if paths else [])
    )
    gone = rows.where("u is not null").select(
        F.col("u").alias("id"), "p", F.col("ud").alias("d"), (F.col("uw") + F.col("below_e")).alias("own"), F.col("id").alias("c"),
        *([F.col("useg").alias("seg")] if paths else []),
    )
    up = known.select(F.col("id").alias("pk"), "root", "depth", *(["path"] if paths else []))
    down = known.select(F.col("id").alias("ck"), F.col("size").alias("below"), F.col("cyc").alias("c_cyc"))
    # a raked node has no child; a spliced one lies on a cycle if its child does
    both = raked.withColumn("below", F.lit(0).cast("long")).withColumn("c_cyc", F.lit(False)).unionByName(
        gone.join(down, gone["c"] == down["ck"], "left").drop("ck")
    )
    if hot:
        # at most 200 rows
        few = F.broadcast(up.where(F.col("pk").isin(hot)))
        many = both.where(F.col("p").isin(hot)).join(few, F.col("p") == F.col("pk"), "left")
        both = both.where(~F.col("p").isin(hot)).join(up, both["p"] == up["pk"], "left").unionByName(many)
    else:
        both = both.join(up, both["p"] == up["pk"], "left")
    depth = F.when(F.col("depth") < 0, F.lit(-1).cast("long")).otherwise(F.col("depth") + F.col("d"))
    path = [F.when(F.col("c_cyc"), F.array("id")).otherwise(F.concat("path", "seg", F.array("id"))).alias("path")] if paths else []
    size = F.when(F.col("c_cyc"), F.col("below")).otherwise(F.col("below") + F.col("own"))
    return both.select("id", "root", depth.alias("depth"), size.alias("size"), F.col("c_cyc").alias("cyc"), *path)


def hierarchy(nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """``nodes(id string, parent string)`` -> one row per id.

    Columns: ``id, root_id, tree_depth int, n_below bigint, on_cycle boolean``
    and, if asked for, ``path array<string>`` to the node from its root or, below
    a cycle, from the node of the cycle that it hangs on; a node on a cycle is
    its own path.  For paths the cycles are found first and cut, so that no
    path runs along one.

    Defined cases: a null id is no node; of several rows of an id the greatest
    parent holds (null last); a parent that is no node makes a root; a node on
    or below a cycle has depth -1 and as root the smallest id of the cycle; for
    a node on a cycle everything else in its component is below it.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    nodes = nodes.select(F.col("id").cast("string"), F.col("parent").cast("string")).where("id is not null")
    nodes = nodes.groupBy("id").agg(F.max("parent").alias("parent"))
    if not with_paths:
        return _contracted(nodes, False)
    base = new_folder(nodes.sparkSession, "cut")
    nodes = materialize(nodes, f"{base}/nodes")
    flat = materialize(_contracted(nodes, False), f"{base}/flat")
    rings = flat.where("on_cycle").select("id")
    cut = nodes.join(rings, "id", "left_anti").unionByName(rings.withColumn("parent", F.lit(None).cast("string")))
    return flat.join(_contracted(cut, True).select("id", "path"), "id")


def _contracted(nodes: DataFrame, paths: bool) -> DataFrame:
    """``nodes(id, parent)`` with ids unique -> their hierarchy; with paths there must be no cycle."""
    spark = nodes.sparkSession
    base = new_folder(spark, "contract")
    # the rounds work on numbers; paths need the ids
    nodes = materialize(nodes.withColumn("key", F.col("id") if paths else F.monotonically_increasing_id()), f"{base}/nodes")
    key = nodes.schema["key"].dataType
    hot = frequent_keys(nodes, "parent")
    state = living_parents(nodes, hot).select(
        "id", "p", F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("e"), F.lit(1).cast("long").alias("d"),
        F.lit(None).cast(key).alias("mn"), *([F.array().cast("array<string>").alias("seg")] if paths else []),
        F.lit("live").alias("status"),
    )
    state = materialize(state, f"{base}/state")
    hot = [r[0] for r in nodes.where(F.col("id").isin(hot)).select("key").collect()] if hot else []
    rounds: list[DataFrame] = []
    while len(rounds) < MAX_ROUNDS:
        seen = Observation()
        after = _round(state, len(rounds), paths)
        state = materialize(after.observe(seen, F.count_if(F.col("status") != "done").alias("left")), f"{base}/round{len(rounds)}")
        rounds.append(state)
        left = seen.get["left"]
        if not left or (left <= LAST_ROWS and len(rounds) >= FIRST_ROUNDS):
            break
    else:
        raise RuntimeError("contraction did not end")
    names = nodes.select(F.col("key").alias("_key"), F.col("id").alias("_name"))
    ends = _finished(spark.read.schema(state.schema).parquet(*[f"{base}/round{i}" for i in range(len(rounds))]), paths)
    if left:
        ends = ends.unionByName(_last_rounds(state, paths))
    ends = ends.join(names, ends["root"] == names["_key"]).withColumn("root", F.col("_name")).drop("_key", "_name")
    known = materialize(ends, f"{base}/known")
    parts = [f"{base}/known"]
    for i, rows in reversed(list(enumerate(rounds))):
        _put_back(rows, known, paths, hot).write.parquet(f"{base}/known{i}")
        parts.append(f"{base}/known{i}")
        known = spark.read.schema(known.schema).parquet(*parts)
        discard(spark, f"{base}/round{i}")
    made = known.join(names, known["id"] == names["_key"])
    if not paths:
        # a cycle's root so far is any of its nodes; its least id is known only now
        rings = known.where("cyc").join(names, F.col("id") == F.col("_key")).groupBy(F.col("root").alias("_ring")).agg(F.min("_name").alias("_least"))
        tied = made.where("depth < 0").join(rings, F.col("root") == F.col("_ring")).withColumn("root", F.col("_least")).drop("_ring", "_least")
        made = made.where("depth >= 0").unionByName(tied)
    return made.select(
        F.col("_name").alias("id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("tree_depth"),
        (F.col("size") - 1).alias("n_below"), F.col("cyc").alias("on_cycle"), *(["path"] if paths else []),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``hierarchy(with_paths=True)`` -> everything below every node: ``ancestor_id, id, distance``.

    One row per node and each node above it, so the number of rows is the sum
    of the depths.  The nodes of a cycle have the same nodes below them, so
    the cycle stands once, under its smallest id, for all of them: its rows are
    all nodes on it but that one, at distance 0, and all nodes below it with
    their distance from it.
    """
    steps = tree.select("id", "root_id", "on_cycle", "tree_depth", (F.size("path") - 1).alias("depth"), F.posexplode("path").alias("at", "ancestor_id"))
    above = F.when((F.col("tree_depth") < 0) & (F.col("at") == 0), F.col("root_id")).otherwise(F.col("ancestor_id"))
    other = (F.col("at") < F.col("depth")) | (F.col("on_cycle") & (F.col("id") != F.col("root_id")))
    return steps.where(other).select(above.alias("ancestor_id"), "id", (F.col("depth") - F.col("at")).alias("distance"))
