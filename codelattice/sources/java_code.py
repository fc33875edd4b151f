"""Java sources: classes, methods, inheritance, calls with their receivers, injected fields and workflow stubs.

A file is read by its braces, not by a grammar: comments and literals are blanked, and
what stands before a `{` or `;` tells what it opens or declares. Files are rows, read in
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The annotations and name endings that frameworks define.
INJECT = {"Autowired", "Inject", "Resource"}
FULL_CONSTRUCTOR = {"RequiredArgsConstructor", "AllArgsConstructor"}
INTERFACES = {"WorkflowInterface": "workflow_interface", "ActivityInterface": "activity_interface"}
STUB_ENDINGS = ("Activity", "Workflow")

_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.DOTALL)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\S")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "transient", "volatile", "synchronized", "native", "default", "strictfp", "sealed"}
_KINDS = {"class", "interface", "enum", "record"}
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "new", "super", "this", "synchronized", "try", "throw", "else", "do", "assert"}

_COLUMNS = ["row_type", "kind", "name", "parent_name", "qualified_name", "target", "receiver", "field_name", "role", "file_path", "line"]
SCHEMA = ", ".join(f"{c} {'int' if c == 'line' else 'string'}" for c in _COLUMNS)
_TYPES = [pa.int32() if c == "line" else pa.string() for c in _COLUMNS]


def _without_annotations(head: list[str]) -> tuple[list[str], list[str]]:
    """What stands beside the annotations of a head, and their names."""
    rest, names, i = [], [], 0
    while i < len(head):
        if head[i] == "@" and i + 1 < len(head) and head[i + 1] != "interface":
            i += 1
            while i + 2 < len(head) and head[i + 1] == ".":
                i += 2
            names.append(head[i])
            i += 1
            if i < len(head) and head[i] == "(":
                depth = 0
                while i < len(head):
                    depth += (head[i] == "(") - (head[i] == ")")
                    i += 1
                    if not depth:
                        break
        else:
            rest.append(head[i])
            i += 1
    return rest, names


def _split(tokens: list[str]) -> list[list[str]]:
    """Parts between commas that no brackets hold."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in "<([") - (t in ">)]")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _typed(tokens: list[str]) -> tuple[str | None, str | None]:
    """The outer type and the name of a field or parameter."""
    names = [t for t in _without_annotations(tokens)[0] if _NAME.fullmatch(t) and t not in _MODIFIERS]
    return (names[0], names[-1]) if len(names) > 1 else (None, None)


class _Reader:
    def __init__(self, path: str):
        self.path, self.rows, self.stack = path, [], []

    def row(self, **more) -> None:
        self.rows.append({"file_path": self.path, **more})

    def owner(self) -> dict | None:
        return next((f for f in reversed(self.stack) if f["what"] == "class"), None)

    def opened(self, head: list[str], line: int) -> None:
        """A `{`: a class, a method of one, or a block."""
        rest, notes = _without_annotations(head)
        kind = next((i for i, t in enumerate(rest[:-1]) if t in _KINDS and _NAME.fullmatch(rest[i + 1]) and "(" not in rest[:i]), None)
        inside = self.stack[-1]["what"] if self.stack else "file"
        if kind is not None and inside in ("file", "class"):
            name = rest[kind + 1]
            q = f"{self.path}::{name}"
            role = next((INTERFACES[n] for n in ("WorkflowInterface", "ActivityInterface") if n in notes), None)
            self.row(row_type="node", kind="Class", name=name, qualified_name=q, role=role, line=line)
            depth, words = 0, []
            for t in rest[kind + 2 :]:
                depth += (t == "<") - (t == ">")
                if not depth and t != ">":
                    words.append(t)
            for i, t in enumerate(words):
                if _NAME.fullmatch(t) and t not in ("extends", "implements", "permits") and "permits" not in words[:i] and {"extends", "implements"} & set(words[:i]) and (i + 1 == len(words) or words[i + 1] != "."):
                    self.row(row_type="edge", kind="INHERITS", qualified_name=q, target=t, line=line)
            self.stack.append({"what": "class", "name": name, "q": q, "full": bool(FULL_CONSTRUCTOR & set(notes))})
        elif inside == "class" and "(" in rest and "=" not in rest[: rest.index("(")]:
            self.method(rest, notes, line)
            self.stack.append({"what": "method", "name": rest[rest.index("(") - 1]})
        else:
            self.stack.append({"what": "block"})

    def method(self, rest: list[str], notes: list[str], line: int) -> None:
        owner, name = self.owner(), rest[rest.index("(") - 1]
        self.row(row_type="node", kind="Test" if "Test" in notes else "Function", name=name, parent_name=owner["name"], qualified_name=f"{owner['q']}.{name}", line=line)
        if name == owner["name"] and INJECT & set(notes):
            depth, at = 0, rest.index("(")
            for end in range(at, len(rest)):
                depth += (rest[end] == "(") - (rest[end] == ")")
                if not depth:
                    break
            for part in _split(rest[at + 1 : end]):
                kind, field = _typed(part)
                if kind:
                    self.row(row_type="edge", kind="INJECTS", qualified_name=owner["q"], target=kind, field_name=field, line=line)

    def declared(self, head: list[str], line: int) -> None:
        """A `;` in a class: a field, or a method without a body."""
        owner = self.owner()
        rest, notes = _without_annotations(head)
        before = rest[: rest.index("=")] if "=" in rest else rest
        if "(" in before:
            if before.index("(") and _NAME.fullmatch(before[before.index("(") - 1]):
                self.method(before, notes, line)
            return
        kind, field = _typed(before)
        if not kind or "static" in before:
            return
        if INJECT & set(notes) or (owner["full"] and "final" in before):
            self.row(row_type="edge", kind="INJECTS", qualified_name=owner["q"], target=kind, field_name=field, line=line)
        if kind.endswith(STUB_ENDINGS) and "<" not in before and "[" not in before:
            self.row(row_type="edge", kind="TEMPORAL_STUB", qualified_name=owner["q"], target=kind, field_name=field, line=line)

    def called(self, last: list[str], line: int) -> None:
        """A `(` in a method, behind its name and perhaps a receiver."""
        method = next((f for f in reversed(self.stack) if f["what"] == "method"), None)
        if not method or not last or not _NAME.fullmatch(last[-1]) or last[-1] in _NO_CALL or (len(last) > 1 and last[-2] == "new"):
            return
        plain = len(last) > 2 and last[-2] == "." and _NAME.fullmatch(last[-3]) and (len(last) < 4 or last[-4] != ".")
        self.row(row_type="edge", kind="CALLS", qualified_name=f"{self.owner()['q']}.{method['name']}", target=last[-1], receiver=last[-3] if plain and last[-3] not in ("this", "super") else None, line=line)


def rows_of(path: str, text: str) -> list[dict]:
    """Nodes and edges of one file. Braces that don't match end what they leave open."""
    plain = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    reader, head, line, at = _Reader(path), [], 1, 0
    begun = 1
    for m in _TOKEN.finditer(plain):
        line += plain.count("\n", at, m.start())
        at, t = m.start(), m[0]
        inside = reader.stack[-1]["what"] if reader.stack else "file"
        if not head:
            begun = line
        if t == "{":
            reader.opened(head, begun)
            head = []
        elif t == "}":
            if reader.stack:
                reader.stack.pop()
            head = []
        elif t == ";":
            if inside == "class" and head:
                reader.declared(head, begun)
            head = []
        else:
            if t == "(" and inside not in ("file", "class"):
                reader.called(head, line)
            head.append(t)
    return reader.rows


def extract(files: DataFrame) -> DataFrame:
    """Nodes and edges (row_type) of Java files (path, content), by SCHEMA; edges have their source in qualified_name. Null content is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(path or "", text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_COLUMNS, _TYPES, strict=True)], _COLUMNS)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)


def nodes(rows: DataFrame) -> DataFrame:
    return rows.where("row_type = 'node'").select("kind", "name", "parent_name", "qualified_name", "role", "file_path", "line")


def edges(rows: DataFrame, kind: str) -> DataFrame:
    """source, target, receiver, field_name, file_path, line of one kind."""
    return rows.where((F.col("row_type") == "edge") & (F.col("kind") == kind)).select(F.col("qualified_name").alias("source"), "target", "receiver", "field_name", "file_path", "line")
