"""Mixing sources to target shares: capped water-filling and seeded repetitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: hash ranges in which a source is sampled; only the range that holds the cut is ordered row by row
RANGES = 4_096


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Sizes in proportion to ``weights`` that add up to ``total``, none above its cap.

    A source above its cap is clamped to it and its excess goes to the others
    in proportion, until none is above; if the caps add up to less, all are clamped.
    """
    open_ = {s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0}
    out = {s: 0.0 for s in weights}
    left = min(total, sum(caps[s] for s in open_))
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * unit >= caps[s]}
        if not over:
            out |= {s: weights[s] * unit for s in open_}
            break
        for s in over:
            out[s] = caps[s]
            left -= caps[s]
        open_ -= over
    return out


def largest_exact_total(weights: dict[str, float], caps: dict[str, float]) -> float:
    """The greatest total at which no source that has anything is above its cap, so that all shares are met."""
    live = [s for s, w in weights.items() if w > 0 and caps.get(s, 0) > 0]
    return min((caps[s] * sum(weights[x] for x in live) / weights[s] for s in live), default=0.0)


def mix_plan(targets: list[dict], sizes: dict[str, int], total_tokens: int | str | None = None) -> list[dict]:
    """One row per mix and source: its size in the mix and the epochs that make it.

    The total of a mix is ``total_tokens``, the greatest at which every share
    is met if that is ``"exact"`` or, by default, one epoch of its sources of
    positive share; a source gives at most ``max_repeats`` epochs.
    Several rows of a mix and source are one, of the sum of their shares and
    the greatest repeats.  A share that is null, negative or no number is 0,
    a null repeat 1.
    """
    mixes: dict[str, dict[str, list]] = {}
    for t in targets:
        if t["mix_name"] is None or t["source"] is None:
            continue
        share = t["target_share"]
        share = share if share is not None and math.isfinite(share) and share > 0 else 0.0
        row = mixes.setdefault(t["mix_name"], {}).setdefault(t["source"], [0.0, 0])
        row[0] += share
        row[1] = max(row[1], 1 if t["max_repeats"] is None else t["max_repeats"])
    out = []
    for mix, rows in mixes.items():
        weights = {s: w for s, (w, _) in rows.items()}
        caps = {s: float(sizes.get(s, 0) * r) for s, (_, r) in rows.items()}
        total = largest_exact_total(weights, caps) if total_tokens == "exact" else total_tokens if total_tokens is not None else sum(sizes.get(s, 0) for s, w in weights.items() if w > 0)
        got = water_fill(weights, caps, total)
        for s, (w, r) in rows.items():
            size = sizes.get(s, 0)
            epochs = got[s] / size if size else 0.0
            epochs = min(epochs, float(r))
            whole = math.floor(epochs + 1e-12)
            cut = max(0, round((epochs - whole) * size)) if whole < r else 0
            out.append({"mix_name": mix, "source": s, "target_share": w / (sum(weights.values()) or 1.0), "max_repeats": r, "available_tokens": size, "planned_tokens": got[s], "epochs": epochs, "whole": whole, "cut": cut})
    return out


_PLAN = "mix_name string, source string, target_share double, max_repeats int, available_tokens long, planned_tokens double, epochs double, whole int, cut long"


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, source, n_tokens)``, ``targets(mix_name, source, target_share, max_repeats)`` -> the mix and its plan.

    The mix has a row per mix and document in it: ``mix_name, doc_id, source, n_tokens, repeats``.
    Every document of a source comes the whole number of its epochs; the
    fraction is the longest run of documents, in the order of a seeded hash,
    that stays within it, so shares are met to within one document.  The
    driver gets one size per source of ``targets``, never documents.

    Defined cases: documents without source or tokens are in no mix; a source
    without documents has no share and the others take it; equal rows are
    documents each; labels of sources must be clean in both tables.
    """
    spark = docs.sparkSession
    rows = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").collect()]
    wanted = sorted({r["source"] for r in rows if r["source"] is not None})
    docs = docs.where(F.col("n_tokens") > 0).where(F.col("source").isin(wanted) if wanted else F.lit(False)).select("doc_id", "source", "n_tokens")
    sizes = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan_rows = mix_plan(rows, sizes, total_tokens)
    plan = spark.createDataFrame([tuple(r[c.split()[0]] for c in _PLAN.split(", ")) for r in plan_rows], _PLAN)
    live = plan.where("whole > 0 or cut > 0").select("mix_name", "source", "whole", "cut")
    draw = F.xxhash64(F.lit(seed), "mix_name", "doc_id", "n_tokens")
    # both broadcasts have at most the rows of targets
    dealt = docs.join(F.broadcast(live), "source").withColumn("draw", draw).withColumn("range", F.pmod("draw", F.lit(RANGES)))
    ranges = dealt.where("cut > 0").groupBy("mix_name", "source", "cut", "range").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy("mix_name", "source").orderBy("range")
    ranges = ranges.withColumn("before", F.sum("t").over(w) - F.col("t"))
    edges = ranges.where("before <= cut and before + t > cut").select("mix_name", "source", F.col("range").alias("edge"), "before")
    dealt = dealt.join(F.broadcast(edges), ["mix_name", "source"], "left")
    at_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False)) & (F.col("cut") > 0)
    inside = (F.col("cut") > 0) & (F.col("edge").isNull() | (F.col("range") < F.col("edge")))
    plain = dealt.where(~at_edge).withColumn("more", inside.cast("int"))
    w = Window.partitionBy("mix_name", "source").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = dealt.where(at_edge).withColumn("more", (F.col("before") + F.sum("n_tokens").over(w) <= F.col("cut")).cast("int"))
    mixed = plain.unionByName(cut).withColumn("repeats", F.col("whole") + F.col("more")).where("repeats > 0")
    return mixed.select("mix_name", "doc_id", "source", "n_tokens", "repeats"), plan


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source the target and the actual share of the tokens."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    rows = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["mixed_tokens", "most_repeats"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy("mix_name"))
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", "available_tokens", F.round("epochs", 6).alias("epochs"), "most_repeats", "mixed_tokens",
        F.round(F.coalesce(F.try_divide("mixed_tokens", whole), F.lit(0.0)), 6).alias("actual_share"),
    )


def mix_check(docs: DataFrame, targets: DataFrame, mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source what must hold: documents of the source, those in the mix that are none of it or come too often, those that lack a whole epoch, and whether the size is the planned one to within a document."""
    have = docs.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.max("n_tokens").alias("largest"))
    got = mixed.groupBy("mix_name", "source").agg(F.count("*").alias("n_in"), F.max("repeats").alias("most"), F.count_if(F.col("n_tokens") <= 0).alias("bad"), F.min("repeats").alias("least"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = plan.join(have, "source", "left").join(got, ["mix_name", "source"], "left")
    whole = F.col("whole") >= 1
    near = (zero("size") <= F.col("planned_tokens") + 1) & (zero("size") > F.col("planned_tokens") - zero("largest") - 1)
    return rows.select(
        "mix_name", "source", zero("n_docs").alias("n_docs"), (zero("most") > F.col("max_repeats")).alias("too_often"), (zero("n_in") > zero("n_docs")).alias("too_many"),
        F.coalesce(whole & ((zero("n_in") < F.col("n_docs")) | (F.col("least") < F.col("whole"))), F.lit(False)).alias("lacking"), near.alias("as_planned"),
    )
