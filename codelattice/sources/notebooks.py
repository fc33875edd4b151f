"""Notebooks: their code cells by language, as sources that other readers take, with the way back from lines to cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First lines that give a cell a language, or leave it out.
LANGUAGE_MARKS = {"%python": "python", "%sql": "sql", "%r": "r"}
OTHER_MARKS = ["%scala", "%md", "%sh"]
KERNELS = ("python", "r")

SCHEMA = "path string, cell_index int, language string, source string"


def _marked(line: str, mark: str) -> bool:
    return line == mark or line.startswith(mark + " ")


def cells_of(text: str) -> list[tuple[int, str, str]]:
    """Number, language and source of the code cells of a notebook that a known kernel runs; none of what is no notebook."""
    try:
        book = json.loads(text)
        meta = book.get("metadata") or {}
        kernel = ((meta.get("kernelspec") or {}).get("language") or (meta.get("language_info") or {}).get("name") or "python").lower()
        cells = list(book.get("cells") or [])
    except (ValueError, AttributeError, TypeError, RecursionError):
        return []
    out = []
    for i, cell in enumerate(cells if kernel in KERNELS else []):
        if not isinstance(cell, dict) or cell.get("cell_type") != "code":
            continue
        lines = cell.get("source") or []
        lines = lines.splitlines(keepends=True) if isinstance(lines, str) else [str(x) for x in lines]
        if not lines:
            continue
        first, language = lines[0].strip(), kernel
        named = next((m for m in LANGUAGE_MARKS if _marked(first, m)), None)
        if named:
            language, lines = LANGUAGE_MARKS[named], lines[1:]
        elif any(_marked(first, m) for m in OTHER_MARKS):
            continue
        if language in KERNELS:
            lines = [x for x in lines if not x.lstrip().startswith(("%", "!"))]
        if lines:
            out.append((i, language, "".join(lines)))
    return out


def cells(files: DataFrame) -> DataFrame:
    """SCHEMA of the code cells of notebooks (path, content). Commands of the notebook itself (`%`, `!`) are left out of Python and R."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *c) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in cells_of(text or "")]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "cell_index", "language", "source"])

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)


def sources(found: DataFrame) -> DataFrame:
    """path, language, content, starts (cell_index, line): the cells of a language one below the other, and the line, from 1, that each begins at."""
    listed = F.array_sort(F.collect_list(F.struct("cell_index", "source")))
    rows = found.groupBy("path", "language").agg(listed.alias("c"))
    n_lines = F.transform("c", lambda c: F.size(F.split(c["source"], "\n")) - F.when(c["source"].endswith("\n"), 1).otherwise(0))
    text = F.array_join(F.transform("c", lambda c: F.when(c["source"].endswith("\n"), c["source"]).otherwise(F.concat(c["source"], F.lit("\n")))), "")
    rows = rows.select("path", "language", text.alias("content"), F.col("c.cell_index").alias("cell"), n_lines.alias("n"))
    # running sum of the lines before each cell
    before = F.reduce("n", F.array(F.lit(1)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return rows.select("path", "language", "content", F.arrays_zip(F.col("cell").alias("cell_index"), F.slice(before, F.lit(1), F.size("cell")).alias("line")).alias("starts"))


def cell_of(symbols: DataFrame, made: DataFrame, language: str) -> DataFrame:
    """symbols (path, line_start, ...) of the sources of one language, with the cell_index that they begin in."""
    starts = made.where(F.col("language") == language).select("path", "starts")
    at = F.expr("element_at(filter(starts, s -> s.line <= line_start), -1).cell_index")
    return symbols.join(starts, "path", "left").select(*symbols.columns, at.alias("cell_index"))
