"""Invariants written in Markdown: blocks, titles, categories and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How an invariant's id looks and how its block begins.
ID = r"INV-[A-Z][A-Z0-9]*(?:-[A-Z][A-Z0-9]*)*-\d+"
BULLET = rf"^\s*-\s+\*\*({ID})"
BARE = rf"^\s*\*\*({ID})\s*:"
MAX_TITLE = 140


def _first_sentence(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(F.nullif(F.regexp_extract(t, r"^(.*?)\.(?:\s|$)", 1), F.lit("")), t)


def _title(block: Column, id_: Column, bare: Column) -> Column:
    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(block, pattern, group), F.lit(""))

    closed = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"[. ]+$", "")
    first_line = F.regexp_replace(F.substring_index(block, "\n", 1), r"^[-\s*]+|[*\s]+$", "")
    return F.when(bare, F.coalesce(closed(part(rf"(?s)\*\*{ID}\s*:\s*(.+?)\*\*")), first_line)).otherwise(
        F.coalesce(
            closed(part(rf"(?s)\*\*{ID}\.\s+(.+?)\*\*")),
            _first_sentence(part(rf"\*\*{ID}\*\*\s*\([^)]*\)\s*:\s*(.+)")),
            _first_sentence(part(rf"\*\*{ID}\*\*\s*:\s*(.+)")),
            _first_sentence(part(rf"\*\*{ID}\s*:\*\*\s*(.+)")),
            first_line,
        )
    )


def parse_invariants(df: DataFrame, source: str, text: str) -> DataFrame:
    """``source, id, category, title, body, line, warning`` of every block; a block ends at the next one or at a heading.

    A title that follows none of the forms is the first line, which ``warning`` says.

    Windows run over the lines of one text.  A null text has no blocks.
    """
    docs = df.select(F.col(source).alias("source"), F.monotonically_increasing_id().alias("doc"), F.col(text).alias("text"))
    lines = docs.select("source", "doc", F.posexplode(F.split("text", "\r?\n")).alias("at", "line_text"))
    bullet, bare = F.regexp_extract("line_text", BULLET, 1), F.regexp_extract("line_text", BARE, 1)
    lines = lines.select("*", F.coalesce(F.nullif(bullet, F.lit("")), bare).alias("id"), (bullet == "").alias("bare"), F.col("line_text").rlike(r"^#{1,6}\s").alias("head"))
    w = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("id") != "") | F.col("head")
    lines = lines.withColumn("block", F.sum(opens.cast("int")).over(w))
    rows = lines.groupBy("source", "doc", "block").agg(
        F.min_by(F.struct("id", "bare", "head", "at"), "at").alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line_text"))), lambda x: x["line_text"]), "\n").alias("body")
    )
    rows = rows.where("f.id <> ''").select("source", F.col("f.id").alias("id"), F.trim("body").alias("body"), F.col("f.bare").alias("bare"), (F.col("f.at") + 1).alias("line"))
    title = _title(F.col("body"), F.col("id"), F.col("bare"))
    known = F.when(F.col("bare"), F.col("body").rlike(rf"(?s)\*\*{ID}\s*:\s*(.+?)\*\*")).otherwise(
        F.col("body").rlike(rf"(?s)\*\*{ID}\.\s+(.+?)\*\*") | F.col("body").rlike(rf"\*\*{ID}\*\*\s*(\([^)]*\))?\s*:\s*.+") | F.col("body").rlike(rf"\*\*{ID}\s*:\*\*\s*.+")
    )
    warning = F.when(~known, F.concat(F.lit("line "), "line", F.lit(": the title of "), "id", F.when(F.col("bare"), " is not closed").otherwise(" follows no form")))
    title = F.when(F.length(title) > MAX_TITLE, F.concat(F.left(title, F.lit(MAX_TITLE - 1)), F.lit("…"))).otherwise(title)
    return rows.select("source", "id", F.regexp_extract("id", r"^INV-(.+)-\d+$", 1).alias("category"), title.alias("title"), "body", "line", warning.alias("warning"))


def audit(rows: DataFrame) -> DataFrame:
    """Per category: ids, declarations and ids declared more than once."""
    ids = rows.groupBy("category", "id").agg(F.count("*").alias("n"))
    return ids.groupBy("category").agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_declared"), F.count_if(F.col("n") > 1).alias("n_duplicated"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: ids, declarations, and declarations beyond the first of an id."""
    ids = rows.groupBy("id").agg(F.count("*").alias("n"))
    return ids.agg(F.count("*").alias("n_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_declared"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"))


def per_source(rows: DataFrame) -> DataFrame:
    """``source, n_declared``: the places of declaration in each source."""
    return rows.groupBy("source").agg(F.count("*").alias("n_declared"))


def sites(rows: DataFrame) -> DataFrame:
    """``id, source, line, title`` of every declaration of an id that is declared more than once."""
    many = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    return rows.join(many, "id", "left_semi").select("id", "source", "line", "title")


def duplicates(rows: DataFrame) -> DataFrame:
    """Ids declared more than once, the first by source and line holding."""
    ids = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("source", "line")).alias("f"), F.min_by("title", F.struct("source", "line")).alias("title"))
    return ids.where("n > 1").select("id", "n", F.col("f.source").alias("source"), F.col("f.line").alias("line"), "title")
