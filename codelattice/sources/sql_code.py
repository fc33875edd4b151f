"""SQL files: what they define, and the tables they read and write."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What names a table, and the words that may stand there without being one.
TABLE_REFERENCE = r"(?i)(?:FROM|JOIN|INTO|CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)|INSERT\s+OVERWRITE)\s+((?:`[^`]+`|\w+)(?:\.(?:`[^`]+`|\w+))*)"
NO_TABLES = """SELECT WHERE GROUP ORDER HAVING LIMIT OFFSET UNION INTERSECT EXCEPT AS ON USING SET VALUES DEFAULT NULL TRUE FALSE
INNER OUTER LEFT RIGHT FULL CROSS NATURAL LATERAL RECURSIVE ONLY WITH""".split()
KINDS = {"table": "Class", "view": "Class", "function": "Function", "procedure": "Function"}

_REFERENCE = re.compile(TABLE_REFERENCE)
_DEFINED = re.compile(r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:TEMP|TEMPORARY|MATERIALIZED|EXTERNAL|UNLOGGED)\s+)*(TABLE|VIEW|FUNCTION|PROCEDURE)\s+(?:IF\s+NOT\s+EXISTS\s+)?((?:[`\"\[][^`\"\]]+[`\"\]]|\w+)(?:\.(?:[`\"\[][^`\"\]]+[`\"\]]|\w+))*)")
_QUIET = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\$(\w*)\$.*?\$\1\$", re.DOTALL)

_COLUMNS = ["row_type", "kind", "sql_kind", "name", "qualified_name", "target", "file_path", "line_start"]
SCHEMA = ", ".join(f"{c} {'int' if c == 'line_start' else 'string'}" for c in _COLUMNS)


def rows_of(path: str, text: str) -> list[dict]:
    """Definitions outside of comments and literals, and each table's first reference, by its last name."""
    quiet = _QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for m in _DEFINED.finditer(quiet):
        name = re.split(r"\.", m[2])[-1].strip('`"[]')
        line = quiet.count("\n", 0, m.start()) + 1
        out.append({"row_type": "node", "kind": KINDS[m[1].lower()], "sql_kind": m[1].lower(), "name": name, "qualified_name": f"{path}::{name}", "file_path": path, "line_start": line})
    seen = set()
    for m in _REFERENCE.finditer(text):
        name = m[1].split(".")[-1].strip("`")
        if name and name.upper() not in NO_TABLES and name not in seen:
            seen.add(name)
            out.append({"row_type": "edge", "kind": "IMPORTS_FROM", "qualified_name": path, "target": name, "file_path": path, "line_start": text.count("\n", 0, m.start()) + 1})
    return out


def extract(files: DataFrame) -> DataFrame:
    """Nodes and IMPORTS_FROM edges (row_type) of SQL files (path, content), by SCHEMA. Null content is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(path or "", text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.int32() if c == "line_start" else pa.string()) for c in _COLUMNS], _COLUMNS)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)


def links(rows: DataFrame) -> DataFrame:
    """source, target, name: files that read or write what exactly one other file defines, by its name in either case."""
    homes = rows.where("row_type = 'node'").groupBy(F.lower("name").alias("key")).agg(F.min("file_path").alias("target"), F.countDistinct("file_path").alias("n")).where("n = 1")
    asked = rows.where("row_type = 'edge'").select(F.col("file_path").alias("source"), F.col("target").alias("name"), F.lower("target").alias("key"))
    return asked.join(homes, "key").where("source <> target").select("source", "target", "name")
