import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semgraph.operators.flatten import Unusable, flat_table, flat_tables, json_triples, triples, unusable_records


def brute(text):
    o = json.loads(text)
    out = []

    def walk(kind, pos, path, v):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(kind, pos, f"{path}.{k}" if path else k, x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(kind, pos, f"{path}[{i}]", x)
        elif v is not None:
            out.append((kind, pos, path))

    walk("adapter", 0, "", o.get("adapter"))
    for top, inner, kind in (("symbols", "properties", "property"), ("edges", "evidence", "evidence")):
        for i, x in enumerate(o[top] if isinstance(o.get(top), list) else []):
            if isinstance(x, dict):
                walk(kind, i, "", x.get(inner))
    return sorted(out)


scalars = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=6)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b.c", "évi", 'q"\\', "[0]"]), x, max_size=3), max_leaves=12)
owners = st.lists(st.fixed_dictionaries({}, optional={"id": scalars, "properties": values, "evidence": values}) | scalars, max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.fixed_dictionaries({}, optional={"adapter": values, "symbols": owners | values, "edges": owners, "version": values}), st.sampled_from([None, 1]), st.booleans())
def test_against_a_tree_parser(doc, indent, ascii_):
    text = "﻿ \n" + json.dumps(doc, indent=indent, ensure_ascii=ascii_) + "\t\n"
    assert sorted((r[1], r[0], r[2]) for r in triples(text)) == brute(text.strip("﻿ \n\t"))


@pytest.mark.parametrize("text", ["", " ", "null", "[]", "3", '"x"', "{", '{"a"', '{"a":', '{"a":1,}', '{"a":1}}', '{"a":1}{}', '{"a" 1}', "{'a':1}", '{"a":01}', '{"a":NaN}', '{"a":"\n"}', '{"a":"\\x"}', '{"a":[1,]}', '{"a":[1 2]}', '{"a":"' + "x" * 60, "analysis failed", '{"a":tru}', '{,}', "[1}"])
def test_unusable(text):
    with pytest.raises(Unusable):
        triples(text)


def test_depth_and_length_have_no_limit():
    deep = '{"adapter":' + '[{"k":' * 20_000 + "1" + "}]" * 20_000 + "}"
    assert len(triples(deep)) == 1
    assert len(triples('{"adapter":"' + "é" * 1_000_000 + '"}')) == 1


def flat_of(spark, docs):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(docs)], "g long, payload string, record_type string")
    return flat_tables(json_triples(df, "g", "payload", rows=True))


def keyed(flat):
    return {(r.record_id, r.record_type, r.owner_pos, r.table_name, tuple(r.ordinals)): r for r in flat.collect()}


def test_tables(spark):
    doc = {"adapter": {"name": "n", "caps": {"x": True}}, "symbols": [{"properties": {"k": 1, "a": [{"u": 1, "w": None}, {"u": 2, "v": ["p", "q"]}]}}], "edges": [{"evidence": "text"}]}
    df = spark.createDataFrame([(1, json.dumps(doc), "z"), (2, None, "z"), (3, "{", "z"), (4, json.dumps(doc), "z")], "g long, payload string, record_type string")
    rows = json_triples(df, "g", "payload", rows=True)
    flat = flat_tables(rows)
    got = {(r.record_type, r.table_name, tuple(r.ordinals), r.parent_name, tuple(r.parent_ordinals or ()), tuple(sorted((k, v.value) for k, v in r.fields.items()))) for r in flat.where("record_id = 1").collect()}
    assert got == {
        ("adapter", "", (), None, (), (("caps.x", "true"), ("name", "n"))), ("property", "", (), None, (), (("k", "1"),)),
        ("property", "a[]", (0,), "", (), (("u", "1"),)), ("property", "a[]", (1,), "", (), (("u", "2"),)),
        ("property", "a[]v[]", (1, 0), "a[]", (1,), (("", "p"),)), ("property", "a[]v[]", (1, 1), "a[]", (1,), (("", "q"),)), ("evidence", "", (), None, (), (("", "text"),)),
    }
    assert {r.record_id for r in json_triples(df, "g", "payload").collect()} == {1, 4}
    assert [r.record_id for r in unusable_records(rows).orderBy("record_id").collect()] == [2, 3]
    assert sorted(r.u for r in flat_table(flat, "property", "a[]", ["u", "absent"]).collect()) == ["1", "1", "2", "2"]
    assert json_triples(df.limit(0), "g", "payload").count() == 0 and flat_tables(json_triples(df.limit(0), "g", "payload", rows=True)).count() == 0


def test_every_ancestor_is_a_row(spark):
    got = keyed(flat_of(spark, ['{"adapter":{"items":[{"subs":[{"x":1}]},{},[[2]],null]}}', '{"adapter":{"a":{},"b":[]}}', '{"adapter":null}', '{"adapter":[[]]}']))
    a = [(0, "adapter", 0, *k) for k in (("", ()), ("items[]", (0,)), ("items[]subs[]", (0, 0)), ("items[]", (1,)), ("items[]", (2,)), ("items[][]", (2, 0)), ("items[][][]", (2, 0, 0)))]
    assert set(got) == {*a, (1, "adapter", 0, "", ()), (3, "adapter", 0, "", ()), (3, "adapter", 0, "[]", (0,))}
    assert all(r.parent_name is None or (*k[:3], r.parent_name, tuple(r.parent_ordinals)) in got for k, r in got.items())
    assert got[a[0]].fields == {} and got[a[2]].fields["x"].value == "1"


def test_keys_with_signs_and_keys_told_twice(spark):
    got = keyed(flat_of(spark, ['{"adapter":{"a.b":1,"a":{"b":2},"c[]":[3],"c":[4],"":5,"d\\\\":6}}', '{"adapter":{"k":1,"k":"2","m":null,"k":true}}']))
    assert {k[3] for k in got if k[0] == 0} == {"", "c\\l\\r[]", "c[]"}
    top = got[0, "adapter", 0, "", ()].fields
    assert {k: v.value for k, v in top.items()} == {"a\\db": "1", "a.b": "2", "\\e": "5", "d\\\\": "6"}
    assert got[0, "adapter", 0, "c\\l\\r[]", (0,)].parent_name == ""
    twice = got[1, "adapter", 0, "", ()]
    assert {k: tuple(v) for k, v in twice.fields.items()} == {"k": ("true", "boolean")}
    assert [tuple(x) for x in twice.retold] == [("k", "1", "number"), ("k", "2", "string")]


@settings(max_examples=60, deadline=None)
@given(values)
def test_no_row_without_its_parent(value):
    made = triples(json.dumps({"adapter": value}), rows=True)
    rows = {(r[5], tuple(r[6])) for r in made}
    for name, at in rows:
        if name:
            assert (name[: -len(name.rsplit("]", 2)[-2]) - 1] if name.count("]") > 1 else "", at[:-1]) in rows
    assert sum(r[4] != "row" for r in made) == len(brute(json.dumps({"adapter": value})))
