"""Structural facts of Python files, as rows: parsed with the standard library's ast, never executed."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "path string, kind string, name string, qualified_name string, parent string, start long, stop long, detail string"


#: Characters of a docstring and of a parser's message that a fact shows.
DOCSTRING, MESSAGE = 500, 200


class _Facts(ast.NodeVisitor):
    """Collects (kind, name, qualified name, parent, first line, last line, detail) in source order."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.scope: list[tuple[str, str]] = []

    def _add(self, kind: str, name: str, node: ast.AST, detail: str | None = None) -> None:
        outer = ".".join(n for _, n in self.scope)
        self.rows.append((kind, name, f"{outer}.{name}" if outer else name, outer or None, node.lineno, getattr(node, "end_lineno", None) or node.lineno, detail))

    def _inside(self, kind: str, name: str, body: list[ast.stmt]) -> None:
        self.scope.append((kind, name))
        for x in body:
            self.visit(x)
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._add("class", node.name, node, ",".join(map(ast.unparse, node.bases)) or None)
        for x in [*node.decorator_list, *node.bases]:
            self.visit(x)
        self._inside("class", node.name, node.body)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        method = bool(self.scope) and self.scope[-1][0] == "class"
        head = "async " * isinstance(node, ast.AsyncFunctionDef) + f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        self._add("method" if method else "function", node.name, node, head)
        for x in node.decorator_list:
            self.visit(x)
        self._inside("function", node.name, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for x in node.names:
            self._add("import", x.name, node, x.asname)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for x in node.names:
            self._add("import", "." * node.level + ".".join(p for p in (node.module, x.name) if p), node, x.asname)

    def visit_Call(self, node: ast.Call) -> None:
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self._add("call", ast.unparse(node.func), node)
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        if node.exc is not None:
            self._add("raise", ast.unparse(node.exc.func if isinstance(node.exc, ast.Call) else node.exc), node)
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and t.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)) and not self.scope:
                for x in node.value.elts:
                    if isinstance(x, ast.Constant) and isinstance(x.value, str):
                        self._add("export", x.value, x)
            elif isinstance(t, ast.Name) and t.id.isupper() and not self.scope:
                self._add("constant", t.id, node)
        self.generic_visit(node)


def python_facts(text: str) -> list[tuple]:
    """The rows of one file; a file that does not parse gives one diagnostic row and no facts."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        line = getattr(e, "lineno", None) or 1
        return [("diagnostic", "syntax_error", "syntax_error", None, line, line, str(e)[:MESSAGE])]
    facts = _Facts()
    if doc := ast.get_docstring(tree):
        facts.rows.append(("docstring", "module", "module", None, 1, 1, doc[:DOCSTRING]))
    facts.visit(tree)
    return facts.rows


def extract(files: DataFrame) -> DataFrame:
    """(path, text) -> facts of the .py files; each other file gives one no_structural_extractor diagnostic row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            rows = [(path, *fact) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for fact in python_facts(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], names=[x.split()[0] for x in FACT.split(", ")])

    python = F.col("path").endswith(".py")
    none = files.filter(~python).select("path", F.lit("diagnostic").alias("kind"), F.lit("no_structural_extractor").alias("name"), F.lit("no_structural_extractor").alias("qualified_name"), F.lit(None).cast("string").alias("parent"), F.lit(1).cast("long").alias("start"), F.lit(1).cast("long").alias("stop"), F.lit(None).cast("string").alias("detail"))
    return files.filter(python).select("path", "text").mapInArrow(emit, FACT).unionByName(none)
