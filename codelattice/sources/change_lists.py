"""Lists of changed files as version control prints them: texts in, rows out.

Each reader takes texts (keys, text), where keys tell texts apart, and gives keys,
file_path and, where the print says it, status. Null and empty texts have no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms that a base may have before it is handed to version control.
SAFE_REVISION = r"^[A-Za-z0-9_.~^/@{}\-]+$"
SAFE_RANGE = r"(?i)^r?\d+(:r?\d+|:HEAD|:BASE|:COMMITTED)?$"


def safe(name: Column, ranges: bool = False) -> Column:
    """Whether a base is a plain revision name (or a range of numbers): nothing that could be read as an option or a command."""
    return F.coalesce(name.rlike(SAFE_RANGE if ranges else SAFE_REVISION) & ~name.startswith("-"), F.lit(False))


def _lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\r\n|[\n\r]")).alias("line"))


def names(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file_path of lists of bare names, one a line, or ended by NULs."""
    parts = texts.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\x00|\r?\n")).alias("file_path"))
    return parts.where(F.trim("file_path") != "").distinct()


def summaries(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, file_path of summarized diffs: a line's first letter (M, A or D), then the path."""
    rows = _lines(texts, keys).where((F.length("line") >= 2) & F.left("line", F.lit(1)).isin("M", "A", "D"))
    return rows.select(*keys, F.left("line", F.lit(1)).alias("status"), F.trim(F.substring("line", 2, 1 << 30)).alias("file_path")).distinct()


def working_copies(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, file_path of the state of a working copy: M, A, D, R or C in the first of eight columns, then the path."""
    rows = _lines(texts, keys).where((F.length("line") >= 2) & F.left("line", F.lit(1)).isin("M", "A", "D", "R", "C"))
    path = F.trim(F.when(F.length("line") > 8, F.substring("line", 9, 1 << 30)).otherwise(F.substring("line", 2, 1 << 30)))
    return rows.select(*keys, F.left("line", F.lit(1)).alias("status"), path.alias("file_path")).distinct()


def short_states(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, file_path of the short state of a work tree: two letters, a blank and the path; of `old -> new` the new one. Untracked files (??) count."""
    rows = _lines(texts, keys).where(F.length("line") > 3)
    entry = F.trim(F.substring("line", 4, 1 << 30))
    path = F.when(entry.contains(" -> "), F.regexp_replace(entry, "^.*? -> ", "")).otherwise(entry)
    return rows.select(*keys, F.trim(F.left("line", F.lit(2))).alias("status"), path.alias("file_path")).distinct()


def changed(keys: list[str], *lists: DataFrame) -> DataFrame:
    """keys, file_path: the files of any of the lists, such as those of a branch, of the index and of the work tree."""
    return reduce(DataFrame.union, (x.select(*keys, "file_path") for x in lists)).distinct()
