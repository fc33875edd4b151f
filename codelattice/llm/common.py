"""Helpers shared by the corpus operators: tables, shared storage, text units."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only word separators: space and 0x09-0x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own, for local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    It cuts the lineage, and a lost executor costs no recomputation, because the
    files are in storage that all executors see. The write's own shuffle files go at
    its end, when nothing needs them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to run reads it."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of each uint64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of several texts laid end to end in data.

    ends: where each text ends. A word never crosses from one text to the next.
    """
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary array, without copying; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes together; a longer text stands alone."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        out.append((start, end))
        start = end
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of each pair; the order counts."""
    out = (a ^ (a >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    out += b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols, by doubling: runs of a power of two are joined to make up k."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    n, out, at, size, now = len(x) - k + 1, None, 0, 1, mix64(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    while True:
        if k & size:
            part = now[at : at + n]
            out = part if out is None else mixed(out, part)
            at += size
        if 2 * size > k:
            return mix64(out)
        now = mixed(now[:-size], now[size:])
        size *= 2


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of each pair, laid end to end."""
    total = np.cumsum(length)
    return np.repeat(start - total + length, length) + np.arange(total[-1] if len(total) else 0)


def words_of(data: np.ndarray, ends: np.ndarray):
    """The words of several texts laid end to end in data: an Arrow binary array, and the number of words up to each end.

    A word never crosses from one text to the next.
    """
    import pyarrow as pa

    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    start, end = word_bounds(data, ends)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    letters = data[~_IS_SPACE[data]]
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.searchsorted(start, ends)


def spaced(words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, a space behind each, and where each word starts (and the last one ends)."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).astype(np.int64)
    starts = bounds + np.arange(len(bounds))
    data = np.full(starts[-1], 32, np.uint8)
    letters = np.ones(starts[-1], bool)
    letters[starts[1:] - 1] = False
    data[letters] = np.frombuffer(words.buffers()[2], np.uint8, bounds[-1])
    return data, starts


def word_hashes(words) -> np.ndarray:
    """64-bit hash (xxh3) of each word's bytes; each distinct word is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    found = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return found[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
