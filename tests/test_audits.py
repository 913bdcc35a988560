from pyspark.sql import functions as F

from semgraph.envelope import capabilities, decorate
from semgraph.operators import audits as A
from semgraph.operators import invariants as I
from semgraph.operators import native_metrics as N


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_references_once_per_line(spark):
    df = spark.createDataFrame([("t", "f", 1, 5, "m"), ("t", "f", 1, 2, "m"), ("t", "f", 1, 5, None), ("t", "f", 1, 5, ""), ("t", "f", 1, 7, None)], "target_id string, file_path string, line int, col int, containing_symbol_id string")
    decl = spark.createDataFrame([("t", "d", 3, 1)], "symbol_id string, file_path string, line int, col int")
    assert rows(A.find_references(df, decl), "file_path", "place", "col", "is_declaration") == [("d", "", 1, True), ("f", ":col5", 5, False), ("f", ":col7", 7, False), ("f", "m", 2, False)]
    names = spark.createDataFrame([("t", "old")], "target_id string, name string")
    assert rows(A.rename_edits(df, names, F.lit("new")), "line", "col", "length", "new_text") == [(1, 2, 3, "new"), (1, 5, 3, "new"), (1, 7, 3, "new")]


def test_enum_coverage(spark):
    m = spark.createDataFrame([("E", "a"), ("E", "b"), ("E", "c")], "enum_id string, member_id string")
    r = spark.createDataFrame([("a", "produced", True), ("a", "switch", False), ("b", "comparison", False)], "member_id string, site_class string, in_static_table boolean")
    assert rows(A.enum_coverage(m, r), "member_id", "total", "dispatch", "verdict") == [("a", 2, 1, "covered"), ("b", 1, 0, "unproduced"), ("c", 0, 0, "unreferenced")]


def test_static_tables(spark):
    c = spark.createDataFrame([("T", "x", 0, 1, "int", "2"), ("T", "x", 0, 0, "string", None), ("T", "x", 40, 0, "int", "9"), ("T", "y", 0, 0, "null", None)], "type_id string, table_id string, row_no int, col_no int, kind string, text string")
    assert rows(A.static_tables(c, max_tables=1, max_rows=32), "table_id", "row_no", "cells", "n_rows") == [("x", 0, ["string:", "int:2"], 2)]
    assert rows(A.static_tables(c), "table_id", "row_no", "cells") == [("x", 0, ["string:", "int:2"]), ("x", 40, ["int:9"]), ("y", 0, ["null:"])]


def test_assignment_coverage(spark):
    sites = spark.createDataFrame([(1, "T"), (2, "T")], "site_id int, type_id string")
    slots = spark.createDataFrame([("T", "a"), ("T", "b")], "type_id string, slot string")
    w = spark.createDataFrame([(1, "a", 1, True, False, False), (1, "a", 2, False, False, False), (1, "b", 1, False, True, False), (2, "a", 1, False, False, False), (2, "a", 2, True, False, False), (2, "b", 1, False, False, True)], "site_id int, slot string, pos int, is_null boolean, in_branch boolean, after_escape boolean")
    assert rows(A.assignment_coverage(sites, slots, w), "site_id", "slot", "state", "confidence") == [(1, "a", "Assigned", "Proven"), (1, "b", "Absent", "Advisory"), (2, "a", "AssignedNull", "Proven"), (2, "b", "Absent", "Advisory")]


def test_callsite_arguments(spark):
    f = spark.createDataFrame([("t", i, 0, "p", i < 3, "x" * 200) for i in range(5)], "target_id string, site_id int, ordinal int, parameter_name string, supplied boolean, raw_text string")
    args, per = A.callsite_arguments(f, max_sites=2)
    assert args.count() == 2 and len(args.first().text) == 160 and rows(per, "n_supplied", "n_omitted") == [(3, 2)]


def test_wire_audit(spark):
    c = spark.createDataFrame([("a", True, False, False, False), ("b", True, False, False, True), ("d", False, True, False, False), ("e", False, False, True, False), ("g", False, False, True, False)], "member_id string, is_rw_candidate boolean, is_delegate boolean, is_event boolean, has_initializer boolean").withColumn("file_path", F.lit("f")).withColumn("line", F.lit(1))
    acc = spark.createDataFrame([("a", "read"), ("b", "read"), ("e", "subscribe"), ("g", "fire")], "member_id string, access string")
    args = spark.createDataFrame([("b", 0, True, "1"), ("b", 0, True, "1"), ("a", 0, True, "1"), ("a", 0, True, "2")], "target_id string, ordinal int, is_constant boolean, raw_text string")
    assert rows(A.wire_audit(c, acc, args), "finding", "member_id") == [("DegenerateConstantCallSites", "b"), ("DelegateSlotNeverAssigned", "d"), ("EventRaisedNeverSubscribed", "g"), ("EventSubscribedNeverRaised", "e"), ("FieldReadWithoutWrite", "a")]


def test_feature_switches(spark):
    m = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "member_id string, default_value boolean")
    w = spark.createDataFrame([("a", "x", "method", "Production", True), ("b", "y", "method", "Test", None), ("c", "x", "method", "Production", True), ("d", "z", "method", "Production", True)], "member_id string, containing_member_id string, containing_kind string, bucket string, assigned_value boolean")
    calls = spark.createDataFrame([("x", 2)], "member_id string, n int")
    assert rows(A.feature_switch_audit(m, w, None, calls), "member_id", "verdict") == [("a", "RuntimeMutable"), ("b", "TestOnlyActivation"), ("c", "AlwaysDefaultInGraph"), ("d", "AlwaysDefaultInGraph")]


def test_struct_layout(spark):
    f = spark.createDataFrame([("S", 1, "a", 1, 1, True, None), ("S", 2, "b", 8, 8, True, None), ("S", 3, "c", 2, 2, True, None), ("U", 1, "a", 4, 4, True, 0), ("U", 2, "b", 8, 8, False, 2)], "type_id string, ordinal int, name string, size int, alignment int, is_exact boolean, explicit_offset int")
    assert rows(A.struct_layout(f)) == [("S", 24, 8, "0,8,16", "Exact"), ("U", 16, 8, "0,2", "Advisory")]
    assert rows(A.struct_layout(f, pack=4), "type_id", "size", "offsets") == [("S", 16, "0,4,12"), ("U", 12, "0,2")]


def test_symbol_at_position_and_classes(spark):
    s = spark.createDataFrame([("T", "f", 1, 50), ("m", "f", 10, 20), ("n", "f", 12, 14)], "symbol_id string, file_path string, start_line int, end_line int").withColumn("start_col", F.lit(5)).withColumn("end_col", F.lit(9))
    p = spark.createDataFrame([("f", 13, 1), ("f", 12, 4), ("f", 14, 9), ("f", 14, 10), ("f", 12, None), ("f", 18, 1), ("f", 40, 99), ("f", 1, 2), ("f", 99, 1), ("g", 1, None)], "file_path string, line int, col int")
    got = {(r.file_path, r.line, r.col): r.symbol_id for r in A.symbol_at_position(s, p).collect()}
    assert got == {("f", 13, 1): "n", ("f", 12, 4): "m", ("f", 14, 9): "n", ("f", 14, 10): "m", ("f", 12, None): "n", ("f", 18, 1): "m", ("f", 40, 99): "T", ("f", 1, 2): None, ("f", 99, 1): None, ("g", 1, None): None}
    wide = spark.createDataFrame([("T", "f", 1, 100_000, 0, 9), ("m", "f", 70_000, 70_010, 0, 9)], "symbol_id string, file_path string, start_line int, end_line int, start_col int, end_col int")
    assert {r.line: r.symbol_id for r in A.symbol_at_position(wide, spark.createDataFrame([("f", 70_005, 1), ("f", 69_999, 1)], p.schema)).collect()} == {70_005: "m", 69_999: "T"}
    c = spark.createDataFrame([("a", 1, 1, True), ("b", 5, 1, False), ("c", 6, 1, False), ("d", 2, 2, False)], "method_id string, n_statements int, n_calls int, only_forwards boolean")
    assert rows(A.method_classes(c)) == [("a", "PureForwarder"), ("b", "ThinWrapper"), ("c", "RealLogic"), ("d", "RealLogic")]


def test_invariant_shapes(spark):
    text = "\n".join([
        "- **INV-A-1**: First part. Rest.", "- **INV-A-2. Bold\n  title.** Body", "**INV-B-C-3: Bare title** x", "- **INV-A-4** (note): With note. Rest", "- **INV-A-5:** Colon in. Rest", "# Head", "not in a block",
        "**INV-B-6: never closed", "- **INV-A-7. " + "x" * 200 + "**", "- **INV-lower-1** no", "- **INV-A-1**: Again.",
    ])
    df = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "s string, t string")
    got = I.parse_invariants(df, "s", "t")
    by = {(r.id, r.line): r.title for r in got.collect()}
    assert by[("INV-A-1", 1)] == "First part" and by[("INV-A-2", 2)] == "Bold title" and by[("INV-B-C-3", 4)] == "Bare title" and by[("INV-A-4", 5)] == "With note" and by[("INV-A-5", 6)] == "Colon in"
    assert by[("INV-B-6", 9)] == "INV-B-6: never closed" and len(by[("INV-A-7", 10)]) == 140
    assert {(r.category, r.n_ids, r.n_duplicated) for r in I.audit(got).collect()} == {("A", 5, 1), ("B-C", 1, 0), ("B", 1, 0)}
    assert rows(I.duplicates(got), "id", "n", "line") == [("INV-A-1", 2, 1)]


def test_unit_summary(spark):
    u = spark.createDataFrame([("m", True, 1, 2, "c11"), ("m", None, 0, 1, "c99")], "module string, parsed boolean, n_diagnostics int, n_defines int, standard string")
    assert rows(N.unit_summary(u)) == [("m", 2, 1, 1, 1, 3, "c11,c99")]


def test_envelope():
    e = decorate("lookup")
    assert (e.tier, e.band, e.stale) == ("Semantic", "Proven", False)
    assert decorate("lookup", {"typeResolution": "bestEffort"}).band == "Advisory"
    assert decorate("what").band == "Speculative" and decorate("search", age_s=4000).stale
    assert "blast_radius" in capabilities()["tools"]
