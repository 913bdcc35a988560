"""Verdicts over tables of compiler facts. Every audit is grouping and joining; nothing is compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semgraph.operators.build import Graph
from semgraph.operators.traverse import reach

#: lines of a file in which spans are looked up together
BLOCK_LINES = 256


def find_references(refs: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """``refs(target_id, file_path, line, col, containing_symbol_id)`` once per file, line, containing symbol (or column without one) and target."""
    place = F.coalesce(F.nullif("containing_symbol_id", F.lit("")), F.concat(F.lit(":col"), F.col("col").cast("string")))
    rows = refs.groupBy("target_id", "file_path", "line", place.alias("place")).agg(F.min("col").alias("col")).withColumn("is_declaration", F.lit(False))
    if declarations is not None:
        decl = declarations.select(F.col("symbol_id").alias("target_id"), "file_path", "line", F.lit("").alias("place"), F.col("col"), F.lit(True).alias("is_declaration"))
        rows = rows.unionByName(decl)
    return rows


def rename_edits(refs: DataFrame, names: DataFrame, new_name: Column) -> DataFrame:
    """The text edits that would rename each target; nothing is written. ``names(target_id, name)``."""
    r = find_references(refs).join(names, "target_id")
    return r.select("target_id", "file_path", "line", "col", F.length("name").alias("length"), new_name.alias("new_text")).distinct()


def find_definitions(declarations: DataFrame) -> DataFrame:
    """The first declaration of each symbol by file and line, with its documentation."""
    row = F.struct("file_path", "line", "display_name", "documentation")
    return declarations.groupBy("symbol_id").agg(F.min_by(row, F.struct("file_path", "line")).alias("r")).select("symbol_id", "r.*")


def find_implementations(g: Graph, targets: DataFrame) -> DataFrame:
    """``root, node``: what implements, inherits or overrides each target at any distance."""
    e = g.edges.where("kind in ('implements', 'inherits', 'overrides')")
    back = e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return reach(back, targets.select(F.col("id").alias("root"), F.col("id").alias("node")), None).where("dist > 0").select("root", "node")


def enum_coverage(members: DataFrame, refs: DataFrame) -> DataFrame:
    """``members(enum_id, member_id)``, ``refs(member_id, site_class, in_static_table)`` -> counts per member and what they show."""
    n = refs.groupBy("member_id").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("site_class") == c).alias(c) for c in ("produced", "comparison", "switch")], F.count_if("in_static_table").alias("dispatch")
    )
    rows = members.select("enum_id", "member_id").join(n, "member_id", "left").fillna(0)
    verdict = F.when(F.col("total") == 0, "unreferenced").when(F.col("produced") == 0, "unproduced").otherwise("covered")
    return rows.withColumn("verdict", verdict)


def static_tables(cells: DataFrame, max_tables: int | None = None, max_rows: int | None = None) -> DataFrame:
    """``cells(type_id, table_id, row_no, col_no, kind, text)`` -> rows of the tables of each type (with bounds: of the first ones), each an array of cells."""
    kept = cells if max_rows is None else cells.where(F.col("row_no") < max_rows)
    if max_tables is not None:
        t = cells.select("type_id", "table_id").distinct().withColumn("tn", F.row_number().over(Window.partitionBy("type_id").orderBy("table_id"))).where(F.col("tn") <= max_tables).drop("tn")
        kept = kept.join(t, ["type_id", "table_id"], "left_semi")
    row = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "kind", "text"))), lambda c: F.concat(c["kind"], F.lit(":"), F.coalesce(c["text"], F.lit(""))))
    total = cells.groupBy("type_id", "table_id").agg(F.countDistinct("row_no").alias("n_rows"))
    return kept.groupBy("type_id", "table_id", "row_no").agg(row.alias("cells")).join(total, ["type_id", "table_id"])


def assignment_coverage(sites: DataFrame, slots: DataFrame, writes: DataFrame, max_sites: int | None = None) -> DataFrame:
    """Per construction site and slot of its type: the last write that counts, or none.

    With ``max_sites`` only the first sites of each type come out, and
    ``n_sites`` tells beside them how many the type has.

    ``sites(site_id, type_id)``, ``slots(type_id, slot)``, ``writes(site_id,
    slot, pos, is_null, in_branch, after_escape)``. Writes in a branch or after
    the object has left the method do not count and make the verdict advisory.
    """
    kept, total = sites, []
    if max_sites is not None:
        n = sites.groupBy("type_id").agg(F.count("*").alias("n_sites"))
        kept = sites.withColumn("rn", F.row_number().over(Window.partitionBy("type_id").orderBy("site_id"))).where(F.col("rn") <= max_sites).drop("rn").join(n, "type_id")
        total = ["n_sites"]
    firm = ~F.coalesce("in_branch", F.lit(False)) & ~F.coalesce("after_escape", F.lit(False))
    w = writes.groupBy("site_id", "slot").agg(
        F.max_by("is_null", F.when(firm, F.col("pos"))).alias("last_null"), F.count_if(firm).alias("n_firm"), F.bool_or(F.coalesce("in_branch", F.lit(False))).alias("branched"), F.bool_or(F.coalesce("after_escape", F.lit(False))).alias("escaped")
    )
    rows = kept.join(slots, "type_id").join(w, ["site_id", "slot"], "left")
    state = F.when(F.coalesce("n_firm", F.lit(0)) == 0, "Absent").when(F.col("last_null"), "AssignedNull").otherwise("Assigned")
    limits = F.array_compact(F.array(F.when(F.col("branched"), "BranchedMayAssign"), F.when(F.col("escaped"), "EscapedBeforeWrite")))
    return rows.select("type_id", "site_id", "slot", state.alias("state"), F.array_join(limits, ",").alias("limitations"), F.when(F.size(limits) == 0, "Proven").otherwise("Advisory").alias("confidence"), *total)


def callsite_arguments(facts: DataFrame, max_sites: int | None = None, clip: int = 160) -> tuple[DataFrame, DataFrame]:
    """``facts(target_id, site_id, ordinal, parameter_name, supplied, raw_text)`` -> (arguments of all sites or the first ones, figures per parameter over all sites).

    ``n_sites`` beside an argument says how many sites its target has in all.
    """
    sites = facts.select("target_id", "site_id").distinct()
    total = sites.groupBy("target_id").agg(F.count("*").alias("n_sites"))
    text = F.when(F.length("raw_text") > clip, F.concat(F.left("raw_text", F.lit(clip - 1)), F.lit("…"))).otherwise(F.col("raw_text"))
    kept = facts
    if max_sites is not None:
        first = sites.withColumn("rn", F.row_number().over(Window.partitionBy("target_id").orderBy("site_id"))).where(F.col("rn") <= max_sites).drop("rn")
        kept = facts.join(first, ["target_id", "site_id"], "left_semi")
    args = kept.select("target_id", "site_id", "ordinal", "parameter_name", "supplied", text.alias("text")).join(total, "target_id")
    per = facts.groupBy("target_id", "ordinal", "parameter_name").agg(F.count_if("supplied").alias("n_supplied"), F.count_if(~F.col("supplied")).alias("n_omitted"))
    return args, per


WIRE_FINDINGS = ("FieldReadWithoutWrite", "DelegateSlotNeverAssigned", "EventSubscribedNeverRaised", "EventRaisedNeverSubscribed", "DegenerateConstantCallSites")


def wire_audit(candidates: DataFrame, accesses: DataFrame, call_args: DataFrame | None = None) -> DataFrame:
    """``candidates(member_id, file_path, line, is_delegate, is_event, is_rw_candidate, has_initializer)``, ``accesses(member_id, access)`` -> findings.

    Reads without a write, delegates never assigned, events subscribed and never raised or raised and never subscribed and, with
    ``call_args(target_id, ordinal, is_constant, raw_text)``, parameters that always get one constant.
    """
    kinds = ("read", "write", "subscribe", "fire")
    n = accesses.groupBy("member_id").agg(*[F.count_if(F.col("access") == k).alias(k) for k in kinds])
    c = candidates.join(n, "member_id", "left").fillna(0, list(kinds))
    writes = F.col("write") + F.coalesce("has_initializer", F.lit(False)).cast("int")
    found = F.array_compact(F.array(
        F.when(F.col("is_rw_candidate") & (writes == 0) & (F.col("read") > 0), "FieldReadWithoutWrite"),
        F.when(F.col("is_delegate") & (writes == 0), "DelegateSlotNeverAssigned"),
        F.when(F.col("is_event") & (F.col("subscribe") > 0) & (F.col("fire") == 0), "EventSubscribedNeverRaised"),
        F.when(F.col("is_event") & (F.col("subscribe") == 0) & (F.col("fire") > 0), "EventRaisedNeverSubscribed"),
    ))
    rows = c.select(F.explode(found).alias("finding"), "member_id", "file_path", "line")
    if call_args is not None:
        flat = call_args.groupBy("target_id", "ordinal").agg(F.count("*").alias("n"), F.bool_and("is_constant").alias("all"), F.min("raw_text").alias("lo"), F.max("raw_text").alias("hi"))
        flat = flat.where("n > 1 and all and lo = hi").select("target_id").distinct()
        rows = rows.unionByName(candidates.join(flat, F.col("member_id") == F.col("target_id"), "left_semi").select(F.lit("DegenerateConstantCallSites").alias("finding"), "member_id", "file_path", "line"))
    return rows


def feature_switch_audit(members: DataFrame, writes: DataFrame, reads: DataFrame | None, callers: DataFrame) -> DataFrame:
    """``members(member_id, default_value)``, ``writes(member_id, containing_member_id, containing_kind, bucket, assigned_value)``, ``reads(member_id)``, ``callers(member_id, n)`` -> a verdict per boolean.

    A write flips if its value is unknown or not the default; it is active in
    a constructor or initializer, in a member that is called, or outside production.
    """
    w = writes.join(members, "member_id").join(callers.select(F.col("member_id").alias("containing_member_id"), "n"), "containing_member_id", "left")
    flips = F.col("assigned_value").isNull() | (F.col("assigned_value") != F.coalesce("default_value", F.lit(False)))
    active = F.col("containing_kind").isin("constructor", "initializer") | (F.coalesce("n", F.lit(0)) > 0) | (F.col("bucket") != "Production")
    v = w.where(flips & active).groupBy("member_id").agg(F.count("*").alias("n_flips"), F.bool_or(F.col("bucket") == "Production").alias("live"))
    rows = members.join(reads.select("member_id").distinct(), "member_id", "left_semi") if reads is not None else members
    verdict = F.when(F.col("n_flips").isNull(), "AlwaysDefaultInGraph").when(F.col("live"), "RuntimeMutable").otherwise("TestOnlyActivation")
    return rows.join(v, "member_id", "left").select("member_id", F.coalesce("n_flips", F.lit(0).cast("long")).alias("n_flips"), verdict.alias("verdict"))


def member_count(members: DataFrame) -> DataFrame:
    """``members(type_id, member_kind, is_static, is_implicit, is_accessor)`` -> members as reflection and as the source counts them."""
    source = ~F.coalesce("is_implicit", F.lit(False)) & ~F.coalesce("is_accessor", F.lit(False))
    kinds = ("method", "field", "property", "event", "constructor")
    return members.groupBy("type_id").agg(
        F.count_if(F.col("member_kind") != "type").alias("reflection_declared"), F.count_if(source).alias("source_symbols"), F.count_if("is_static").alias("statics"),
        *[F.count_if(source & (F.col("member_kind") == k)).alias(f"n_{k}") for k in kinds],
    )


def struct_layout(fields: DataFrame, pack: int = 8) -> DataFrame:
    """``fields(type_id, ordinal, name, size, alignment, is_exact, explicit_offset[, declared_size])`` -> ``type_id, size, alignment, offsets, exactness``.

    Fields lie one after another at multiples of the smaller of their
    alignment and ``pack``; explicit offsets hold as given.  A size that is
    declared for the type is the least that it has.
    """
    declared = F.max("declared_size") if "declared_size" in fields.columns else F.lit(0)
    f = F.array_sort(F.collect_list(F.struct("ordinal", "size", F.least("alignment", F.lit(pack)).alias("al"), "explicit_offset")))
    up = lambda n, a: ((n + a - 1) / a).cast("int") * a
    zero = F.struct(F.lit(0).alias("end"), F.lit(1).alias("al"), F.array().cast("array<int>").alias("at"))

    def add(acc: Column, x: Column) -> Column:
        start = F.coalesce(x["explicit_offset"], up(acc["end"], x["al"]))
        return F.struct(F.greatest(acc["end"], start + x["size"]).alias("end"), F.greatest(acc["al"], x["al"]).alias("al"), F.concat(acc["at"], F.array(start)).alias("at"))

    rows = fields.groupBy("type_id").agg(f.alias("f"), F.bool_and("is_exact").alias("exact"), declared.alias("declared"))
    rows = rows.select("type_id", "exact", "declared", F.aggregate("f", zero, add).alias("r"))
    return rows.select("type_id", up(F.greatest("r.end", "declared"), F.col("r.al")).alias("size"), F.col("r.al").alias("alignment"), F.array_join(F.transform("r.at", lambda x: x.cast("string")), ",").alias("offsets"), F.when(F.col("exact"), "Exact").otherwise("Advisory").alias("exactness"))


def symbol_at_position(spans: DataFrame, positions: DataFrame) -> DataFrame:
    """``spans(symbol_id, file_path, start_line, start_col, end_line, end_col)``, ``positions(file_path, line, col)`` -> the innermost symbol there.

    Ends count to the span.  A null column of a position is any place of its
    line, one of a span the line's whole.  Spans and positions meet by blocks
    of lines, so a position sees the spans of its block and not those of the file.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK_LINES)
    s = spans.where("start_line <= end_line").select("*", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block"))
    at = positions.select("file_path", "line", "col").distinct()
    hit = at.where("line is not null").withColumn("block", block("line")).join(s, ["file_path", "block"]).where("line between start_line and end_line")
    hit = hit.where("(col is null or line > start_line or start_col is null or col >= start_col) and (col is null or line < end_line or end_col is null or col <= end_col)")
    size = F.struct((F.col("end_line") - F.col("start_line")).alias("len"), (-F.col("start_line")).alias("s"), (-F.coalesce("start_col", F.lit(0))).alias("c"), "symbol_id")
    best = hit.groupBy("file_path", "line", F.col("col").alias("_col")).agg(F.min(size).alias("b"))
    same = (F.col("a.file_path") == F.col("h.file_path")) & (F.col("a.line") == F.col("h.line")) & F.col("a.col").eqNullSafe(F.col("h._col"))
    return at.alias("a").join(best.alias("h"), same, "left").select("a.file_path", "a.line", "a.col", F.col("h.b.symbol_id").alias("symbol_id"))


def method_classes(facts: DataFrame) -> DataFrame:
    """``facts(method_id, n_statements, n_calls, only_forwards)`` -> a forwarder, a thin wrapper or logic of its own."""
    word = F.when(F.col("only_forwards"), "PureForwarder").when((F.col("n_calls") == 1) & (F.col("n_statements") <= 5), "ThinWrapper").otherwise("RealLogic")
    return facts.select("method_id", word.alias("classification"))


def diagnostics(facts: DataFrame, severity: str | None = None, module: str | None = None) -> DataFrame:
    rows = facts
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    return rows.where(F.col("module") == module) if module is not None else rows
