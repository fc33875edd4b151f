"""Comments of source files, and the documentation and signatures they give to symbols.

A file is scanned with its language's comment marks and literals in mind, so a mark
inside a string is none and nested blocks end where they should. What belongs to what is
then a matter of line numbers: runs of adjacent comments, joined with declarations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the languages.
SLASHES = ["c", "cpp", "csharp", "java", "javascript", "typescript", "tsx", "go", "rust", "kotlin", "swift", "scala", "php", "dart"]
HASHES = ["bash", "ruby", "r", "perl", "yaml", "toml"]
DASHES = ["sql", "lua", "haskell"]
NESTED = ["rust", "kotlin", "swift", "scala", "sql"]
BOILERPLATE = r"(?i)copyright|licen[cs]e|spdx|warranty|all rights reserved|bug reports|do not edit"

_LITERALS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
_SCANNERS = {
    "//": re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*)|"""(?s:.*?)"""|`(?s:\\.|[^`\\])*`|' + _LITERALS.replace(r"|\'", r"|(?<![A-Za-z0-9_&<])\'")),
    "#": re.compile(r"(?P<line>(?<![^\s;])#[^\n]*)|" + _LITERALS),
    "--": re.compile(r"(?P<line>--[^\n]*)|(?P<block>/\*)|" + _LITERALS),
}
_BLOCK_EDGE = re.compile(r"/\*|\*/")

_FIELDS = [("path", pa.string()), ("style", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("alone", pa.bool_()), ("text", pa.string())]
SCHEMA = "path string, style string, line_start int, line_end int, alone boolean, text string"


def _marks(language: str | None) -> str | None:
    return "//" if language in SLASHES else "#" if language in HASHES else "--" if language in DASHES else None


def _block_text(raw: str) -> str:
    lines = raw.removeprefix("/*").lstrip("*").removesuffix("*/").split("\n")
    return "\n".join(x for x in (line.strip().lstrip("*").strip() for line in lines) if x)


def scan(text: str, language: str | None) -> list[tuple]:
    """style, line_start, line_end, alone, text of each comment, attribute line and first code line of a file.

    alone: nothing but white space stands before it on its line, nor behind a block on its last.
    """
    marks = _marks(language)
    if marks is None:
        return []
    out, at, code = [], 0, list(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    line_of = lambda i: next_line(starts, i)
    while m := _SCANNERS[marks].search(text, at):
        at = m.end()
        if m.lastgroup is None:
            continue
        if m.lastgroup == "block":
            depth = 1
            while depth:
                edge = _BLOCK_EDGE.search(text, at)
                if edge is None:
                    at, depth = len(text), 0
                else:
                    at = edge.end()
                    depth += (1 if language in NESTED else 0) if edge[0] == "/*" else -1
        first, last = line_of(m.start()), line_of(at - 1)
        before, behind = text[starts[first] : m.start()], text[at : starts[last + 1] - 1]
        raw = text[m.start() : at]
        if m.lastgroup == "block":
            out.append(("block", first + 1, last + 1, not before.strip() and not behind.strip(), _block_text(raw)))
        elif not (raw.startswith("#!") and first == 0):
            body = raw.lstrip(marks[0]).lstrip("!").strip()
            out.append(("line", first + 1, first + 1, not before.strip(), body if marks != "#" or re.search("[A-Za-z]", body) else ""))
        code[m.start() : at] = [c if c == "\n" else " " for c in raw]
    rest, coded = "".join(code).split("\n"), None
    for i, line in enumerate(rest):
        plain = line.strip()
        if not plain or (i == 0 and text.startswith("#!")):
            continue
        if coded is None:
            coded = i + 1
            out.append(("code", coded, coded, True, ""))
        if plain.startswith("@") or (marks == "//" and plain.startswith("#[")):
            out.append(("attribute", i + 1, i + 1, True, plain))
    return out


def next_line(starts: list[int], i: int) -> int:
    """The number of the line, from 0, that character i is on."""
    low, high = 0, len(starts) - 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if starts[mid] <= i else (low, mid)
    return low


def comments(files: DataFrame) -> DataFrame:
    """SCHEMA of the comments of files (path, language, content), one file at a time. Null content and unknown languages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *row) for p, lang, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for row in scan(t or "", lang)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)], [n for n, _ in _FIELDS])

    return files.select("path", "language", F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)


def runs(found: DataFrame) -> DataFrame:
    """path, style, line_start, line_end, text of the comments that stand alone, those of single lines joined where they touch."""
    order = Window.partitionBy("path", "style").orderBy("line_start")
    rows = found.where("alone and style <> 'code'").withColumn("new", ((F.col("style") == "block") | (F.lag("line_end").over(order).isNull()) | (F.lag("line_end").over(order) + 1 < F.col("line_start"))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order))
    text = F.array_join(F.filter(F.array_sort(F.collect_list(F.struct("line_start", "text")))["text"], lambda x: x != ""), "\n")
    return rows.groupBy("path", "style", "run").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), text.alias("text")).drop("run")


def doc_above(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """symbols (path, line_start, ...) with `doc`: the run of comments that touches the declaration, or the attribute lines above it, from above. Null if there is none or it has no words."""
    all_runs = runs(found)
    attributes = all_runs.where("style = 'attribute'").select("path", F.col("line_start").alias("__first"), (F.col("line_end") + 1).alias("line_start"))
    above = all_runs.where("style <> 'attribute' and text <> ''").select("path", (F.col("line_end") + 1).alias("__first"), F.col("text").alias("doc")).groupBy("path", "__first").agg(F.min("doc").alias("doc"))
    placed = symbols.join(attributes, ["path", "line_start"], "left").withColumn("__first", F.coalesce("__first", "line_start"))
    return placed.join(above, ["path", "__first"], "left").select(*symbols.columns, "doc")


def module_doc(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, doc: the first run of comments before any code that is no licence text, unless it touches the file's first symbol (symbols: path, line_start), whose own it is."""
    coded = found.where("style = 'code'").groupBy("path").agg(F.min("line_start").alias("code"))
    first = symbols.groupBy("path").agg(F.min("line_start").alias("symbol"))
    top = runs(found).where("style in ('line', 'block')").join(coded, "path", "left").where("code is null or line_end < code")
    chosen = top.where(~F.coalesce(F.col("text").rlike(BOILERPLATE), F.lit(False))).groupBy("path").agg(F.min_by(F.struct("line_end", "text"), "line_start").alias("r"))
    return chosen.join(first, "path", "left").where("(symbol is null or r.line_end + 1 <> symbol) and r.text <> ''").select("path", F.col("r.text").alias("doc"))


def signature(lines: list[str], at: int, most: int = 8) -> str | None:
    """The declaration that starts at line `at` (from 0), behind its attributes, up to its body or end, on one line of text."""
    while at < len(lines) and lines[at].strip().startswith(("@", "#[")):
        at += 1
    out, depth = "", 0
    for line in lines[at : at + most]:
        for ch in line:
            if not depth and ch in "{;":
                break
            depth += (ch in "([") - (ch in ")]")
            out += ch
        else:
            out += " "
            if depth > 0:
                continue
        break
    plain = re.sub(r",?\s*\)", ")", re.sub(r"\(\s+", "(", " ".join(out.split())))
    return plain or None


def signatures(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """path, qualified_name, signature of symbols (path, qualified_name, line_start) in files (path, content); each file meets its symbols once."""
    wanted = symbols.groupBy("path").agg(F.collect_list(F.struct("qualified_name", "line_start")).alias("symbols"))
    rows = files.select("path", F.col("content").cast("string").alias("content")).join(wanted, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, named in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = (content or "").splitlines()
                out += [(path, s["qualified_name"], signature(lines, s["line_start"] - 1)) for s in named]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["path", "qualified_name", "signature"])

    return rows.select("path", "content", "symbols").mapInArrow(run, T.StructType([T.StructField(c, T.StringType()) for c in ("path", "qualified_name", "signature")]))
