"""How many lines a change adds to and takes from a text."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tally(before: str | None, after: str | None) -> tuple[int, int]:
    """Lines added and removed, as a unified diff shows them. An added line that begins with `++`, or a removed one with `--`, looks like its header and isn't counted."""
    if before == after:
        return 0, 0
    a, b = (before or "").splitlines(), (after or "").splitlines()
    added = removed = 0
    for what, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if what != "equal":
            removed += sum(not x.startswith("--") for x in a[i:j])
            added += sum(not x.startswith("++") for x in b[k:m])
    return added, removed


def tallies(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, added, removed of each pair (before, after) of texts; null is an empty text. Pairs are compared one by one within Arrow batches."""
    schema = T.StructType([pairs.schema[c] for c in keep] + [T.StructField("added", T.LongType()), T.StructField("removed", T.LongType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            counts = [tally(a.as_py(), b.as_py()) for a, b in zip(batch.column(n), batch.column(n + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], [*keep, "added", "removed"])

    return pairs.select(*keep, F.col("before").cast("string").alias("__before"), F.col("after").cast("string").alias("__after")).mapInArrow(compared, schema)


def totals(counts: DataFrame) -> DataFrame:
    """One row: how many pairs differ, and the lines added and removed in all."""
    return counts.agg(F.count(F.when((F.col("added") > 0) | (F.col("removed") > 0), 1)).alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
