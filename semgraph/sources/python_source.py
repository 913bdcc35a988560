"""Python sources as a graph: one syntax tree per file, names resolved by a join over all files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOUND = "what string, id string, name string, qualified_name string, kind string, file_path string, line int, parent_id string, visibility string, is_abstract boolean, is_static boolean, wanted string, edge_kind string"
SKIP = ("__pycache__", ".venv", "venv", ".git", ".tox", "node_modules", ".mypy_cache", ".pytest_cache", "build", "dist", ".eggs")


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Subscript):
        return _dotted(node.value)
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    return None


class _File(ast.NodeVisitor):
    """Symbols of a file and what it names, not yet resolved."""

    def __init__(self, path: str):
        self.path, self.rows = path, []
        module = path[:-3].replace("/", ".")
        self.module = module[: -len(".__init__")] if module.endswith(".__init__") else module
        self.scope: list[tuple[str, str, str]] = [("file", f"file:{path}", self.module)]

    def symbol(self, kind: str, id_: str, name: str, qname: str, line: int, abstract: bool = False, static: bool = False) -> None:
        private = name.startswith("_") and not (name.startswith("__") and name.endswith("__"))
        self.rows.append(("symbol", id_, name, qname, kind, self.path, line, self.scope[-1][1], "private" if private else "public", abstract, static, None, None))

    def want(self, source: str, name: str | None, kind: str) -> None:
        if name:
            self.rows.append(("edge", source, None, None, None, self.path, None, None, None, None, None, name, kind))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        qname = f"{self.scope[-1][2]}.{node.name}"
        bases = [_dotted(b) for b in node.bases]
        self.symbol("type", f"type:{qname}", node.name, qname, node.lineno, any(b in ("ABC", "abc.ABC", "Protocol", "typing.Protocol") for b in bases))
        for b in bases:
            self.want(f"type:{qname}", b, "inherits")
        self.scope.append(("type", f"type:{qname}", qname))
        self.generic_visit(node)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        kind, _, qname = self.scope[-1]
        if kind == "method":
            return self.generic_visit(node)
        args = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if a.arg not in ("self", "cls")]
        marks = [_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        id_ = f"method:{qname}.{node.name}({','.join(args)})"
        self.symbol("method", id_, node.name, f"{qname}.{node.name}", node.lineno, "abstractmethod" in {(m or "").rsplit(".", 1)[-1] for m in marks}, "staticmethod" in marks)
        self.scope.append(("method", id_, f"{qname}.{node.name}"))
        self.generic_visit(node)
        self.scope.pop()
        return None

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        kind, id_, qname = self.scope[-1]
        if kind == "type" and isinstance(node.target, ast.Name):
            self.symbol("field", f"field:{qname}.{node.target.id}", node.target.id, f"{qname}.{node.target.id}", node.lineno)
        for n in ast.walk(node.annotation):
            if isinstance(n, (ast.Name, ast.Attribute)):
                self.want(id_ if kind != "file" else f"file:{self.path}", _dotted(n), "references")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        if self.scope[-1][0] == "method":
            self.want(self.scope[-1][1], _dotted(node.func), "references")
        self.generic_visit(node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.want(f"file:{self.path}", f"{node.module}.{a.name}" if node.module else a.name, "references")


def extract(files: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """``files(path, content)`` -> raw symbols and edges for ``build``. A file that does not parse is a file without content."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.strip().split()[0] for c in _FOUND.split(",")]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                rows.append(("symbol", f"file:{path}", path.rsplit("/", 1)[-1], f"{module}/{path}", "file", path, 0, f"mod:{module}", "public", False, False, None, None))
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError):
                    continue
                v = _File(path)
                v.visit(tree)
                rows += v.rows
            yield pd.DataFrame(rows, columns=cols)

    skip = F.exists(F.split("path", "/"), lambda s: s.isin(*SKIP) | s.endswith(".egg-info"))
    found = files.where(F.col("path").endswith(".py") & ~skip).select("path", "content").mapInPandas(parse, _FOUND)
    none = F.lit(None)
    props = F.create_map().cast("map<string,string>").alias("properties")
    cols = ["id", "name", "qualified_name", "kind", "file_path", "line", "parent_id", "visibility", "is_abstract", "is_static"]
    own = files.sparkSession.createDataFrame([(f"mod:{module}", module, module, "module", None, 0, None, "public", False, False)], ", ".join(f"{c} {t}" for c, t in zip(cols, "string string string string string int string string boolean boolean".split())))
    symbols = found.where("what = 'symbol'").select(*cols).unionByName(own).select(*cols, props, F.lit(0).alias("ord"))
    types = found.where("what = 'symbol' and kind = 'type'").select("id", F.explode(F.array_distinct(F.array("qualified_name", F.substring_index("qualified_name", ".", -1)))).alias("key"), "qualified_name")
    # a full name comes before a short one; of types of one short name the first in order holds
    types = types.groupBy("key").agg(F.min_by("id", F.struct(F.col("qualified_name") != F.col("key"), "qualified_name")).alias("target_id"))
    wants = found.where("what = 'edge'").select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.array("wanted", F.substring_index("wanted", ".", -1)))).alias("key"), "wanted", F.col("edge_kind").alias("kind"), "file_path")
    hits = wants.join(types, "key").where("source_id <> target_id").groupBy("source_id", "wanted", "kind").agg(F.min_by("target_id", F.col("key") != F.col("wanted")).alias("target_id"))
    evidence = F.struct(F.lit("semantic").alias("kind"), F.lit("Python").alias("adapter_name"), none.cast("string").alias("source_span"), F.lit("bestEffort").alias("confidence"))
    from semgraph.schema import CALL_SITE

    edges = hits.select("source_id", "target_id", "kind").distinct().select("*", evidence.alias("evidence"), props, none.cast(CALL_SITE).alias("call_site"), none.cast("array<string>").alias("profiles"), F.lit(0).cast("long").alias("ord"))
    return symbols, edges
