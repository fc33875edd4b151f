"""Symbols, calls and imports of Python files: one Arrow pass over (path, content), a file at a time."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "row_type string, kind string, name string, parent string, qualified_name string, target string, file_path string, line_start int, line_end int, is_test boolean, signature string, doc string, decorators array<string>, fingerprint string"
_COLUMNS = [c.split()[0] for c in re.split(r",\s+(?=\w)", SCHEMA)]
_TYPES = [pa.string()] * 7 + [pa.int32()] * 2 + [pa.bool_()] + [pa.string()] * 2 + [pa.list_(pa.string()), pa.string()]
_TEST_PATH = re.compile(r"(^|/)(tests?/|test_[^/]*\.py$)|_test\.py$")


def span_fingerprint(source: str) -> str | None:
    """Sixteen hex digits of the code's tokens: spacing, line breaks and comments don't count. Null if it has no tokens that can be read."""
    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER}
    digest = hashlib.sha256()
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type not in skip:
                digest.update(t.string.encode("utf-8", "surrogatepass") + b"\0")
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return None
    return digest.hexdigest()[:16]


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else None


class _Walk(ast.NodeVisitor):
    """Rows of one file. Calls outside of functions belong to the file."""

    def __init__(self, path: str, source: str):
        self.path, self.lines, self.rows = path, source.split("\n"), []
        self.parents: list[str] = []
        self.owner = path
        self.test_file = bool(_TEST_PATH.search(path))
        self.defined: dict[str, str] = {}
        self.imported: dict[str, str] = {}

    def _row(self, row_type: str, **values) -> None:
        self.rows.append({"row_type": row_type, "file_path": self.path} | values)

    def _symbol(self, node, kind: str) -> None:
        parent = ".".join(self.parents)
        qualified = f"{self.path}::{parent + '.' if parent else ''}{node.name}"
        decorators = [d for d in map(_dotted, node.decorator_list) if d]
        source = "\n".join(self.lines[node.lineno - 1 : node.end_lineno])
        if kind == "Function" and self.test_file and node.name.startswith("test"):
            kind = "Test"
        dotted = qualified.split("::", 1)[1]
        if kind == "Class":
            bases = ", ".join(map(ast.unparse, node.bases))
            signature = f"class {dotted}({bases})" if bases else f"class {dotted}"
        else:
            signature = f"{dotted}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        indent = len(source) - len(source.lstrip())
        flat = "\n".join(x[indent:] if x[:indent].isspace() else x for x in source.split("\n"))
        self._row("node", kind=kind, name=node.name, parent=parent or None, qualified_name=qualified, line_start=node.lineno, line_end=node.end_lineno, is_test=self.test_file, signature=signature, doc=ast.get_docstring(node), decorators=decorators, fingerprint=span_fingerprint(flat))
        self._row("edge", kind="CONTAINS", qualified_name=self.path, target=qualified, line_start=node.lineno)
        self.defined.setdefault(node.name, qualified)
        for base in getattr(node, "bases", ()):
            if name := _dotted(base):
                self._row("edge", kind="INHERITS", qualified_name=qualified, target=name, line_start=node.lineno)
        for d in node.decorator_list:
            self.visit(d)
        owner, self.owner = self.owner, self.owner if kind == "Class" else qualified
        # only classes name what they hold; a function in a function stands by itself
        parents, self.parents = self.parents, [*self.parents, node.name] if kind == "Class" else []
        for child in node.body:
            self.visit(child)
        self.parents, self.owner = parents, owner

    def visit_ClassDef(self, node):
        self._symbol(node, "Class")

    def visit_FunctionDef(self, node):
        self._symbol(node, "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        for a in node.names:
            self._row("edge", kind="IMPORTS_FROM", qualified_name=self.path, target=a.name, line_start=node.lineno)

    def visit_ImportFrom(self, node):
        module = "." * node.level + (node.module or "")
        self._row("edge", kind="IMPORTS_FROM", qualified_name=self.path, target=module, line_start=node.lineno)
        for a in node.names:
            self.imported[a.asname or a.name] = f"{module}::{a.name}"

    def visit_Call(self, node):
        if name := _dotted(node.func):
            self._row("edge", kind="CALLS", qualified_name=self.owner, target=name, line_start=node.lineno)
        self.generic_visit(node)

    def finish(self) -> list[dict]:
        """Calls of a name defined here get its first definition, of an imported one its module; others stay bare."""
        for r in self.rows:
            if r["row_type"] == "edge" and r["kind"] == "CALLS":
                tail = r["target"].rsplit(".", 1)[-1] if r["target"].startswith(("self.", "cls.")) else r["target"]
                r["target"] = self.defined.get(tail) or self.imported.get(tail) or tail
        return self.rows


def rows_of(path: str, content: bytes | None) -> list[dict]:
    """A file's own row and those of its code; a file that doesn't parse has only its own."""
    source = (content or b"").decode("utf-8", "replace")
    own = {"row_type": "node", "kind": "File", "name": path, "qualified_name": path, "file_path": path, "line_start": 1, "line_end": source.count("\n") + 1, "is_test": bool(_TEST_PATH.search(path)), "fingerprint": hashlib.sha256(content or b"").hexdigest()[:16]}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [own]
    own["doc"] = ast.get_docstring(tree)
    walk = _Walk(path, source)
    walk.visit(tree)
    return [own, *walk.finish()]


def extract(files: DataFrame) -> DataFrame:
    """Nodes and edges (row_type) of Python files (path, content), by SCHEMA; each file is parsed by itself.

    Null content is an empty file. Edges have their source in qualified_name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_COLUMNS, _TYPES, strict=True)], _COLUMNS)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def symbols(rows: DataFrame) -> DataFrame:
    return rows.where("row_type = 'node'").drop("row_type", "target")


def edges(rows: DataFrame) -> DataFrame:
    """kind, source, target, file_path, line: a repeated edge at one line counts once."""
    return rows.where("row_type = 'edge'").select("kind", F.col("qualified_name").alias("source"), "target", "file_path", F.col("line_start").alias("line")).distinct()


def tested_by(rows: DataFrame) -> DataFrame:
    """TESTED_BY edges (source: what a test calls, target: the test)."""
    tests = symbols(rows).where("kind = 'Test'").select(F.col("qualified_name").alias("source"))
    return edges(rows).where("kind = 'CALLS'").join(tests, "source", "left_semi").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
