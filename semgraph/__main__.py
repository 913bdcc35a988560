"""spark-submit entry: ``python -m semgraph analyze|context|export|verify|serve --graph FOLDER [--rules FILE or built-in pack] [--base FOLDER] [--out FOLDER]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.operators import analysis as A
from semgraph.operators.build import Graph, build, written
from semgraph.operators.context import instructions
from semgraph.operators.validate import validate
from semgraph.server import Server
from semgraph.session import materialize, new_folder
from semgraph.sources import graph_json as J
from semgraph.sources.files import BUILT_IN, built_in_rules, read_rules
from semgraph.streaming import incremental as T
from semgraph.tools import Session


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a folder by their path below it."""
    root = "^(file:)?/*" + folder.removeprefix("file:").strip("/") + "/"
    return J.read_folder(spark, folder).withColumn("document_id", F.regexp_replace("document_id", root, ""))


def _manifest(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("document_id").alias("path"), F.lit("").alias("module"), T.content_hash("payload").alias("content_hash"), F.lit(None).cast("timestamp").alias("modified_at"))


def incremental_graph(spark: SparkSession, base: DataFrame, now: DataFrame) -> Graph:
    """The graph of the documents ``now``: parts of unchanged ones come from the written snapshot of ``base``, only the others are read anew."""
    where = new_folder(spark, "snapshot")
    old = J.parse(base, "document_id", "payload")
    parts = [materialize(J.symbols_of(old), f"{where}/symbols"), materialize(J.edges_of(old), f"{where}/edges")]
    diff = T.manifest_diff(_manifest(base), _manifest(now))
    moved = diff.where("status in ('changed', 'added')").select(F.col("path").alias("document_id"))
    new = J.parse(now.join(moved, "document_id", "left_semi"), "document_id", "payload")
    return written(build(*[T.replace_files(a, b, diff, "document_id") for a, b in zip(parts, (J.symbols_of(new), J.edges_of(new)))]))


def drift_of(full: Graph, inc: Graph) -> DataFrame:
    """``what, side, key``: symbols and edges that only one of two graphs has."""
    s = T.drift(full.symbols, inc.symbols, ["id", "kind", "name", "parent_id"]).select(F.lit("symbol").alias("what"), "side", F.col("id").alias("key"))
    e = T.drift(full.edges, inc.edges, ["source_id", "target_id", "kind", "role"]).select(F.lit("edge").alias("what"), "side", F.concat_ws(" -> ", "source_id", "target_id").alias("key"))
    return s.unionByName(e)


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="semgraph")
    p.add_argument("command", choices=("analyze", "context", "export", "verify", "serve"))
    p.add_argument("--graph", required=True, help="folder of graph documents")
    p.add_argument("--base", help="verify: folder of the documents of the run before; without it they are those of --graph")
    p.add_argument("--rules", help="a rule file, or " + " or ".join(BUILT_IN))
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    found = _documents(spark, a.graph)
    docs = J.parse(found, "document_id", "payload")
    symbols, edges = J.symbols_of(docs), J.edges_of(docs)
    wrong = validate(symbols, edges).limit(10).collect()
    if wrong:
        print("\n".join(f"{r.code}: {r.subject}" for r in wrong), file=sys.stderr)
        return 1
    g = written(build(symbols, edges))
    rules = None if not a.rules else built_in_rules(spark, a.rules) if a.rules in BUILT_IN else read_rules(spark, a.rules)
    if a.command == "export":
        owner = g.symbols.select(F.col("id").alias("source_id"), F.coalesce(F.nullif("file_path", F.lit("")), "id").alias("document"))
        parts = J.in_parts(g.symbols.withColumn("document", F.coalesce(F.nullif("file_path", F.lit("")), "id")), g.edges.join(owner, "source_id"), "document")
        J.to_documents(*parts, F.col("part"), F.col("part")).select("payload").write.text(a.out)
        return 0
    if a.command == "context":
        broken = A.violations(g, rules) if rules is not None else None
        print(instructions(g, broken, A.cycles(g).select("component").distinct().count()))
        return 0
    if a.command == "verify":
        lost = drift_of(g, incremental_graph(spark, _documents(spark, a.base or a.graph), found)).limit(20).collect()
        for r in lost:
            print(f"{r.side} only: {r.what} {r.key}", file=sys.stderr)
        return int(bool(lost))
    if a.command == "serve":
        Server(Session(g, rules)).run(sys.stdin, sys.stdout)
        return 0
    result = Session(g, rules).analyze()
    row = result["metrics"].first().asDict()
    print(row)
    return int(row.get("violations", 0) > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
