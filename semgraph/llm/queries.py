"""Queries of the text problems over ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semgraph.functions.ids import table
from semgraph.llm.lookalikes import consistent_forms, look_classes, recovery, same_looking_pairs
from semgraph.llm.mixing import mix_check, mix_report, mix_sources
from semgraph.llm.packing import fill_check, fill_containers, fill_report
from semgraph.llm.tokens import token_counts
from semgraph.session import materialize, new_folder


def _source() -> Column:
    """Labels without stray case and blanks; an empty one is null."""
    return F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source")



def _packs(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return [(r["pack_name"], r["capacity_tokens"]) for r in table(spark, d, "pack_sizes").collect()]


def _items(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), "text", ["doc_id"])


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return fill_containers(_items(spark, d), _packs(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_pack(spark, d), _packs(spark, d))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every packing."""
    items, packs = _items(spark, d), _packs(spark, d)
    return fill_check(items, materialize(fill_containers(items, packs), new_folder(spark, "packed")), packs)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents").select("text", "doc_id", _source()), "text", ["doc_id", "source"])


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mix_targets").withColumn("source", _source())


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(_docs(spark, d), _targets(spark, d))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(*mix_sources(_docs(spark, d), _targets(spark, d)))


def p7_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mixes that meet every share of a source with documents."""
    return mix_report(*mix_sources(_docs(spark, d), _targets(spark, d), total_tokens="exact"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every mix."""
    docs, targets = _docs(spark, d), _targets(spark, d)
    return mix_check(docs, targets, *mix_sources(docs, targets))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    forms = consistent_forms(table(spark, d, "documents"), "doc_id", "text", digests_only=True)
    return materialize(forms, new_folder(spark, "forms"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking_pairs(_forms(spark, d))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of documents that look the same, with the numbers of their texts and documents."""
    return look_classes(_forms(spark, d))[0]


def p8_members(spark: SparkSession, d: str) -> DataFrame:
    """Each document in such a class, with the first document of the class and the first of its own text."""
    return look_classes(_forms(spark, d))[1]


def p8_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Per script the words of held-out texts and those whose spelling the search finds from their shapes."""
    rows = recovery(table(spark, d, "documents"), "doc_id", "text")
    return rows.withColumn("share", F.round(F.try_divide("n_found", "n_ambiguous"), 6))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return consistent_forms(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p6_pack, p6_report, p6_check, p7_mix, p7_shares, p7_exact_shares, p7_check, p8_found, p8_classes, p8_members, p8_recovery, p8_forms)}
#: sizes in tokens cannot be told in SQL; what must hold whatever they are can
SQL: dict[str, str] = {
    "p6_check": "select pack_name, (select count(*) from documents where text <> '') n_items, 0::bigint n_over, 0::bigint n_split_in_vain, 0::bigint n_not_whole, 0 wasteful from pack_sizes",
    "p7_check": """select mix_name, t.s source, coalesce(n, 0) n_docs, false too_often, false too_many, false lacking, true as_planned from (select distinct mix_name, nullif(lower(trim(source)), '') s from mix_targets) t
  left join (select nullif(lower(trim(source)), '') s, count(*) n from documents where text <> '' group by 1) q on q.s = t.s""",
}
