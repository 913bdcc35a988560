"""Path buckets and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path segments that tell a bucket.
GENERATED = ("obj", "bin", "generated")
VENDORED = ("packages", "packagecache", "samples", "samples~", "sample", "thirdparty", "third-party", "third_party", "vendor", "vendored", "external")
BUCKETS = ("Production", "Test", "Generated", "Editor", "Vendored")


def path_bucket(path: Column) -> Column:
    """Generated, Vendored, Test, Editor or Production, in this order of precedence."""
    p = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    parts = F.split(p, "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    return (
        F.when(p.endswith(".g.cs") | p.contains(".generated.") | has(GENERATED), "Generated")
        .when(has(VENDORED) | F.exists(parts, lambda s: s.startswith("examples")), "Vendored")
        .when(has(("tests",)) | p.endswith("tests.cs") | p.endswith("test.cs"), "Test")
        .when(has(("editor",)), "Editor")
        .otherwise("Production")
    )


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` crosses ``/``, ``?`` is one character, case does not count."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob.replace("\\", "/"))
    return f"(?i)^{body}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    p = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    out = F.lit(False)
    for g in globs:
        out = out | p.rlike(glob_pattern(g))
    return out


def matches_pattern(name: Column, pattern: Column) -> Column:
    """The grammar of architecture rules: ``*`` all, ``*.X`` a part, ``X.*`` a prefix, else a name or what is below it."""
    n, p = F.lower(name), F.lower(pattern)
    tail = p.substr(F.lit(3), F.length(p))
    stem = F.left(p, F.length(p) - 2)
    part = n.endswith(F.concat(F.lit("."), tail)) | n.contains(F.concat(F.lit("."), tail, F.lit("."))) | n.startswith(F.concat(tail, F.lit("."))) | (n == tail)
    return (
        F.when(p == "*", F.lit(True))
        .when(p.startswith("*."), part)
        .when(p.endswith(".*"), n.startswith(F.concat(stem, F.lit("."))) | (n == stem))
        .otherwise((n == p) | n.startswith(F.concat(p, F.lit("."))))
    )
