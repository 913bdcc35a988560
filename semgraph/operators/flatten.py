"""Nested JSON records to flat tables by path-value-ordinal triples.

A record is read once, token by token, with an explicit stack, so nesting has
no limit.  Every string, number and boolean of the wanted parts becomes a
triple of path, value and ordinals (the array positions on the way).  Paths
are grouped by their last repeated ancestor, the array that they lie in, and
each group becomes a table whose rows are keyed by the ordinals and linked to
the row of the repeated ancestor above.  Every element of an array is a row,
whether a value lies in it or only deeper, so no link leads nowhere.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"""
)
_BLANK = re.compile(r"[ \t\n\r]*")
#: what is told of a part: (member of the record, member of its elements or None, name of the part)
PARTS = (("adapter", None, "adapter"), ("symbols", "properties", "property"), ("edges", "evidence", "evidence"))

TRIPLE = "owner_pos int, record_type string, field_path string, value string, value_type string"
PLACE = "parent_table string, ordinals array<int>, field string, seq int"
#: ``value_type`` of what is no value: a row of a table, and a record that is no JSON object
ROW, UNUSABLE = "row", "unusable"
_ESCAPES = str.maketrans({"\\": "\\\\", ".": "\\d", "[": "\\l", "]": "\\r"})


class Unusable(ValueError):
    """The text is not one complete JSON object."""


def _string(token: str) -> str:
    text = json.loads(token) if "\\" in token else token[1:-1]
    return text.encode("utf-8", "replace").decode() if "\\u" in token else text


def _name(key: str) -> str:
    """A key as part of a table's or field's name, in which ``.``, ``[`` and ``]`` are signs of the path."""
    return key.translate(_ESCAPES) or "\\e"


def _parts(parts) -> dict:
    return {(top, inner): name for top, inner, name in parts}


def triples(text: str, parts=PARTS, rows: bool = False) -> list[tuple]:
    """The triples of one record: (owner_pos, record_type, field_path, value, value_type).

    With ``rows`` they go on with (table, ordinals, field), and there is one
    of type ``ROW`` for each part and each element of an array in it that is
    an object or array.  Raises ``Unusable`` unless the text, without a byte order mark and blanks around it, is one complete JSON object.
    """
    named = _parts(parts)
    tops = {top: inner for top, inner, _ in parts}
    at, end = 0, len(text)
    while at < end and text[at] in "\ufeff \t\n\r":
        at += 1
    while end > at and text[end - 1] in "\ufeff \t\n\r":
        end -= 1
    match, out = _TOKEN.match, []
    # a frame: [is_array, position or key, part name or None, path, table, column prefix, ordinals, role]
    # role: 0 the record, 1 an array of owners, 2 an owner, 3 anything else
    stack: list[list] = []
    owner, top = 0, None
    want = "value"  # or "key", "key or end", "colon", "comma or end", "value or end", "nothing"
    while at < end:
        m = match(text, at, end)
        if not m:
            raise Unusable
        at = m.end()
        sign, quoted, plain = m.groups()
        if want == "colon":
            if sign != ":":
                raise Unusable
            want = "value"
            continue
        if want == "comma or end":
            if sign == ",":
                want = "value" if stack[-1][0] else "key"
                continue
            if sign != ("]" if stack[-1][0] else "}"):
                raise Unusable
        if want in ("key", "key or end") and quoted:
            stack[-1][1] = _string(quoted)
            want = "colon"
            continue
        if sign in ("]", "}"):
            if want not in ("comma or end", "key or end", "value or end") or stack[-1][0] != (sign == "]"):
                raise Unusable
            stack.pop()
            want = "comma or end" if stack else "nothing"
            continue
        if want not in ("value", "value or end") or sign in (",", ":"):
            raise Unusable
        # a value begins here: where it lies
        part, path, table, field, ordinals, role = None, "", "", "", (), 3
        if not stack:
            if sign != "{":
                raise Unusable
            role = 0
        else:
            f = stack[-1]
            if f[0]:
                f[1] += 1
            if f[7] == 0:
                top, owner = f[1], 0
                if top in tops:
                    if tops[top] is None:
                        part = named[top, None]
                    elif sign == "[":
                        role = 1
            elif f[7] == 1:
                owner = f[1]
                role = 2 if sign == "{" else 3
            elif f[7] == 2:
                if f[1] == tops[top]:
                    part = named[top, f[1]]
            elif f[2] is not None:
                part = f[2]
                if f[0]:
                    path = f"{f[3]}[{f[1]}]"
                    if rows:
                        table, ordinals = f"{f[4]}{f[5]}[]", (*f[6], f[1])
                else:
                    path = f"{f[3]}.{f[1]}" if f[3] else f[1]
                    if rows:
                        table, field, ordinals = f[4], f"{f[5]}.{_name(f[1])}" if f[5] else _name(f[1]), f[6]
        if sign:
            if rows and part is not None and not field:
                out.append((owner, part, None, None, ROW, table, list(ordinals), None))
            stack.append([sign == "[", -1, part, path, table, field, ordinals, role])
            want = "value or end" if sign == "[" else "key or end"
            continue
        if part is not None and plain != "null":
            kind = "string" if quoted else "boolean" if plain in ("true", "false") else "number"
            value = _string(quoted) if quoted else plain
            out.append((owner, part, path, value, kind, table, list(ordinals), field) if rows else (owner, part, path, value, kind))
        want = "comma or end" if stack else "nothing"
        if not stack:
            raise Unusable
    if want != "nothing":
        raise Unusable
    return out


def json_triples(df: DataFrame, id_col: str, json_col: str, parts=PARTS, rows: bool = False) -> DataFrame:
    """One row per scalar in the wanted parts of each record: ``record_id`` and the columns of ``TRIPLE``.

    ``field_path`` leads to the value with keys as they are.  With ``rows``,
    which ``flat_tables`` needs, the columns of ``PLACE`` follow: ``parent_table`` is the path of the last
    repeated ancestor with ``[]`` for its positions (empty: the part itself),
    ``ordinals`` the positions, ``field`` the path from there (in both, ``\\``,
    ``.``, ``[`` and ``]`` of a key are written ``\\\\``, ``\\d``, ``\\l`` and
    ``\\r``, an empty key ``\\e``) and ``seq`` the place in the record; besides
    the values come a row of type ``ROW`` for each part and element that is an
    object or array and one of type ``UNUSABLE`` for each record that is no
    complete JSON object.

    Defined cases: a null, empty, truncated or otherwise unusable text gives
    no values; nulls and empty containers give none; owners that are no objects
    have no parts; a key that stands twice in an object is told twice; a lone
    surrogate in a string is read as ``?``.  A text is held by one task, as
    one row is.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()] + ([pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32()] if rows else [])
    schema = f"{TRIPLE}, {PLACE}" if rows else TRIPLE
    names = ["record_id", *[c.split()[0] for c in schema.split(", ")]]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols = [], [[] for _ in types]
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                try:
                    if text is None:
                        raise Unusable
                    found = triples(text, parts, rows)
                except Unusable:
                    found = [(None, None, None, None, UNUSABLE, None, None, None)] if rows else []
                ids.extend([i] * len(found))
                if rows:
                    cols[-1].extend(range(len(found)))
                for r in found:
                    for c, v in zip(cols, r):
                        c.append(v)
                if len(ids) > 50_000:
                    yield batch(b, ids, cols)
                    ids, cols = [], [[] for _ in types]
            if ids:
                yield batch(b, ids, cols)

    def batch(b: pa.RecordBatch, ids: list, cols: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)

    return df.select(id_col, json_col).mapInArrow(parse, f"record_id {id_type}, {schema}")


def flat_tables(triples: DataFrame) -> DataFrame:
    """``json_triples(rows=True)`` pivoted: one row per record, owner, table and ordinals.

    Columns: ``record_id, record_type, owner_pos, table_name, ordinals`` (the
    row's key), ``parent_name, parent_ordinals`` (the key of the row that it
    lies in, null for the part itself), ``fields map<string,
    struct<value,type>>`` and ``retold``.  Each part that is not null and each
    element of an array that is not null is a row, with no fields if values
    lie only deeper or not at all, so every parent is there.  A row holds the
    fields of one object, so no group grows with the table.  ``flat_table``
    makes columns of the fields.

    A field that an object tells several times has its last value in
    ``fields``, as JSON readers have it, and the values before it stand in
    ``retold array<struct<field,value,type>>``, null if there are none.
    """
    key = ["record_id", "record_type", "owner_pos", "parent_table", "ordinals"]
    told = F.when(F.col("value_type") != ROW, F.struct("seq", "field", "value", F.col("value_type").alias("type")))
    rows = triples.where(F.col("value_type") != UNUSABLE).groupBy(*key).agg(F.array_sort(F.collect_list(told)).alias("t")).withColumnRenamed("parent_table", "table_name")
    names = F.array_distinct(F.transform("t", lambda x: x["field"]))
    # the last of a name by its place
    last = F.transform(names, lambda n: F.struct(n.alias("field"), F.element_at(F.filter("t", lambda x: x["field"] == n), -1).alias("x")))
    once = F.size(names) == F.size("t")
    fields = F.when(once, F.map_from_entries(F.transform("t", lambda x: F.struct(x["field"], F.struct(x["value"].alias("value"), x["type"].alias("type"))))))
    fields = F.coalesce(fields, F.map_from_entries(F.transform(last, lambda y: F.struct(y["field"], F.struct(y["x"]["value"].alias("value"), y["x"]["type"].alias("type"))))))
    earlier = F.filter("t", lambda x: F.exists("t", lambda y: (y["field"] == x["field"]) & (y["seq"] > x["seq"])))
    retold = F.when(~once, F.transform(earlier, lambda x: F.struct(x["field"], x["value"], x["type"])))
    inside = F.col("table_name") != ""
    return rows.select(
        "record_id", "record_type", "owner_pos", "table_name", "ordinals",
        F.when(inside, F.regexp_replace("table_name", r"[^\[\]]*\[\]$", "")).alias("parent_name"),
        F.when(inside, F.slice("ordinals", 1, F.size("ordinals") - 1)).alias("parent_ordinals"),
        fields.alias("fields"), retold.alias("retold"),
    )


def flat_table(flat: DataFrame, record_type: str, table_name: str, fields: list[str]) -> DataFrame:
    """One table of ``flat_tables`` with a column per field; absent fields are null."""
    mine = flat.where((F.col("record_type") == record_type) & (F.col("table_name") == table_name))
    return mine.select("record_id", "owner_pos", "ordinals", "parent_name", "parent_ordinals", *[F.col("fields")[f]["value"].alias(f) for f in fields])


def unusable_records(triples: DataFrame) -> DataFrame:
    """The records of ``json_triples(rows=True)`` that are no complete JSON object, each as often as it was received."""
    return triples.where(F.col("value_type") == UNUSABLE).select("record_id")
