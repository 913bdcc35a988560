"""Bounded and unbounded breadth-first traversals from many seeds at once.

Where a task can hold the steps, the roots are dealt to tasks (``walk``). A
larger graph takes one job per level for all seeds together, or for several
levels while few pairs are new. A job's new pairs are written once; what is
known is the union of what was written, so nothing is recomputed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from semgraph.operators.walk import pairs, walk
from semgraph.session import materialize, new_folder

#: levels that one job takes where no more than ``FEW`` pairs are new
STRIDE, FEW = 6, 50_000


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int | None, held: int | None = None, kept: bool = True) -> DataFrame:
    """``steps(src, dst)``, ``seeds(root, node)`` -> ``root, node, dist`` with the least distance, seeds at 0.

    A pair that was reached is not reached again, so cycles end. Repeated
    steps and seeds count once. ``kept`` says that the result is written, for
    those who read it more than once; ``held`` is that of ``walk``.
    """
    schema = f"root {seeds.schema['root'].dataType.simpleString()}, node string, dist int"
    near = walk(steps, seeds, max_depth, pairs, schema, None, held)
    if near is None:
        return reach_by_level(steps, seeds, max_depth)
    return materialize(near, f"{new_folder(steps.sparkSession, 'reach')}/pairs") if kept else near


def reach_by_level(steps: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """``reach`` without a graph in memory."""
    base = new_folder(steps.sparkSession, "reach")
    spark = steps.sparkSession
    steps = materialize(steps.where("src is not null and dst is not null").select("src", "dst").distinct(), f"{base}/steps")
    seen = Observation()
    front = materialize(seeds.select("root", "node").distinct().withColumn("dist", F.lit(0)).observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/level0")
    schema, paths, depth, n = front.schema, [f"{base}/level0"], 0, seen.get["n"]
    while n and (max_depth is None or depth < max_depth):
        stride = 1 if n > FEW else STRIDE
        if max_depth is not None:
            stride = min(stride, max_depth - depth)
        walked, parts = front.select("root", "node"), []
        for k in range(1, stride + 1):
            walked = walked.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
            parts.append(walked.withColumn("dist", F.lit(depth + k)))
        # what is met on the way is not looked up until the end, so the least of its distances holds
        after = parts[0] if stride == 1 else reduce(DataFrame.unionByName, parts).groupBy("root", "node").agg(F.min("dist").alias("dist"))
        known = spark.read.schema(schema).parquet(*paths)
        after = after.join(known.select("root", "node"), ["root", "node"], "left_anti")
        depth += stride
        seen = Observation()
        new = materialize(after.observe(seen, F.count_if(F.col("dist") == depth).alias("n")), f"{base}/level{depth}")
        front, n = new.where(F.col("dist") == depth), seen.get["n"]
        paths.append(f"{base}/level{depth}")
    return spark.read.schema(schema).parquet(*paths)


def reach_paths(steps: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """``steps(src, dst, ord, via)``, ``seeds(root, node)`` -> ``root, node, dist, ords, nodes, vias`` along the first path.

    Of the shortest paths to a node the one with the least sequence of edge
    ordinals holds, as a queue that visits edges in order would find it.
    """
    base = new_folder(steps.sparkSession, "paths")
    spark = steps.sparkSession
    steps = materialize(steps.select("src", "dst", "ord", "via"), f"{base}/steps")
    none = F.array().cast("array<string>")
    first = seeds.select("root", "node").distinct().select("root", "node", F.lit(0).alias("dist"), F.array().cast("array<bigint>").alias("ords"), F.array("node").alias("nodes"), none.alias("vias"))
    front = materialize(first, f"{base}/level0")
    paths = [f"{base}/level0"]
    for depth in range(1, max_depth + 1):
        known = spark.read.schema(front.schema).parquet(*paths)
        seen = Observation()
        row = F.struct(F.concat("ords", F.array("ord")).alias("ords"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("vias", F.array("via")).alias("vias"))
        after = front.join(steps, front["node"] == steps["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.min(row).alias("r"))
        after = after.join(known.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("dist"), "r.ords", "r.nodes", "r.vias")
        front = materialize(after.observe(seen, F.count(F.lit(1)).alias("n")), f"{base}/level{depth}")
        if not seen.get["n"]:
            break
        paths.append(f"{base}/level{depth}")
    return spark.read.schema(front.schema).parquet(*paths)


def nearest_ancestor(symbols: DataFrame, wanted: str, hops: int) -> DataFrame:
    """``id, found``: the first symbol that fits ``wanted`` among the ``2**n >= hops`` nodes from each up its parents.

    Pointers double in every round, so 16 hops take 4 joins.
    """
    base = new_folder(symbols.sparkSession, "nearest")
    rows = symbols.select("id", F.when(F.expr(wanted), F.col("id")).alias("found"), F.col("parent_id").alias("up"))
    n, i = 1, 0
    rows = materialize(rows, f"{base}/0")
    while n < hops:
        n, i = n * 2, i + 1
        above = rows.select(F.col("id").alias("_id"), F.col("found").alias("_found"), F.col("up").alias("_up"))
        open_ = rows.withColumn("_key", F.when(F.col("found").isNull(), F.col("up")))
        rows = materialize(open_.join(above, F.col("_key") == F.col("_id"), "left").select("id", F.coalesce("found", "_found").alias("found"), F.col("_up").alias("up")), f"{base}/{i}")
    return rows.select("id", "found")
