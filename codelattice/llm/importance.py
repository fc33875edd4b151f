"""Target-distribution importance resampling over hashed word n-grams.

An untrained pre-tokeniser of the tokenizers library, a regex Split, gives the words of
each lower-cased text with their offsets. Windows of one to `longest` neighbouring
offset pairs are the features; the CRC of their bytes picks a bucket. Two histograms
of a fixed number of buckets, of the raw texts and of the target's, give each bucket a
gain; a document's weight is the mean gain of its features. Gumbel noise from a hash of
the id turns the weights into a draw without replacement, whose order is found from the
counts of each whole-numbered score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.common import LOWER, materialize, pieces, text_or_empty, utf8_column

#: What stands between words, after lower-casing A-Z: all of ASCII but digits and a-z.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BUCKETS = 10_000
_PIECE = 1 << 20
_SLICE = 1 << 18
#: Words of more bytes are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc_onward(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:end], crc) of each row."""
    out = crc.copy()
    size = end - start
    for i in np.flatnonzero(size > _LONG):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(crc[i]))
    rows = np.flatnonzero(size <= _LONG)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    left, at = np.searchsorted(-size[rows], -np.arange(1, _LONG + 1), "right"), start[rows]
    state = ~crc[rows]
    for k, n in enumerate(left):  # the first n rows have a byte k
        if not n:
            break
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[rows] = ~state
    return out


class Features:
    """Words and feature buckets of texts laid end to end."""

    def __init__(self, longest: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(BETWEEN), behavior="removed")
        self.between = re.compile(BETWEEN)
        self.longest, self.buckets = longest, buckets

    def _offsets(self, raw: bytes) -> np.ndarray:
        """Byte offsets (start, end, start, ...) of the words of one lower-cased text. A long text is taken in slices that end between words."""
        text, out, at = raw.decode(), [], 0
        while at < len(text):
            end = len(text)
            if end - at > _SLICE and (gap := self.between.search(text, at + _SLICE)):
                end = gap.end()
            found = self.split.pre_tokenize_str(text[at:end])
            out.append(at + np.fromiter(chain.from_iterable(map(itemgetter(1), found)), np.int64, 2 * len(found)))
            at = end
        offsets = np.concatenate(out) if out else np.zeros(0, np.int64)
        if len(text) < len(raw):  # code points to bytes
            first = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            offsets = np.append(first, len(raw))[offsets]
        return offsets

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Number of words of each text, and for windows of 1, 2, ... words: the text and the bucket of each."""
        data = LOWER[data]
        raw = data.tobytes()
        pairs = [a + self._offsets(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        n_words = np.array([len(p) // 2 for p in pairs], np.int64)
        places = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        start, end = places[::2], places[1::2]
        text = np.repeat(np.arange(len(pairs)), n_words)
        crc = crc_onward(np.zeros(len(start), np.uint32), data, start, end)
        out = [(text, (crc % self.buckets).astype(np.int64))]
        space, zeros = np.full(1, 32, np.uint8), np.zeros(len(start), np.int64)
        for k in range(1, self.longest):
            inside = text[k:] == text[:-k]
            crc = crc[:-1] if k == 1 else crc
            crc = crc_onward(crc[: len(start) - k], space, zeros[: len(start) - k], zeros[: len(start) - k] + 1)
            crc = crc_onward(crc, data, start[k:], end[k:])
            out.append((text[:-k][inside], (crc % self.buckets).astype(np.int64)[inside]))
            crc = crc[:-1]
        return n_words, out


def histogram(texts: DataFrame, *, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of the column `text`, over all rows, fall in each bucket. Null texts have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = utf8_column(batch.column(0))
            for a, b in pieces(offsets, _PIECE):
                for _, found in features.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1]:
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    return texts.select(text_or_empty()).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, *, longest: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, in thousandths: the floored logarithm of how much likelier the target's features are to fall in it, each count plus one.

    One number per bucket reaches the driver, whatever the texts. Empty tables count nothing.
    """
    spark = raw.sparkSession
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = counts.join(histogram(raw, longest=longest, buckets=buckets).withColumnRenamed("n", "s"), "bucket", "left")
    counts = counts.join(histogram(target, longest=longest, buckets=buckets).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = Window.partitionBy(F.lit(0))  # a row per bucket: of fixed size
    up = (F.col("t") + 1).cast("double") * (F.sum("s").over(whole) + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.sum("t").over(whole) + buckets).cast("double")
    out = np.zeros(buckets, np.int64)
    for row in counts.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain")).collect():
        out[row.bucket] = row.gain
    return out


def weigh(docs: DataFrame, gain: np.ndarray, *, longest: int = 2, keep: list[str] | None = None, names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """docs with the number of words and features of each whole text and its weight, the floored mean gain of its features (0 without any).

    keep: the columns of docs to return, all by default; those named like the new ones
    are replaced. gain has a fixed size and is broadcast.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])
    shipped = docs.sparkSession.sparkContext.broadcast(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value
        features = Features(longest, len(gain))
        for batch in batches:
            data, offsets = utf8_column(batch.column(len(keep)))
            for a, b in pieces(offsets, _PIECE):
                n_words, found = features.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n, total = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
                for text, bucket in found:
                    n += (ends := np.bincount(text, minlength=b - a))
                    run = np.append(0, np.cumsum(gain[bucket]))
                    last = np.cumsum(ends)
                    total += run[last] - run[last - ends]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], [*keep, *names])

    return docs.select(*(docs[f"`{c}`"] for c in keep), text_or_empty().alias("__text")).mapInArrow(weighed, schema)


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, seed: str = "7", longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text), drawn towards the texts of target (text).

    score is the weight plus Gumbel noise from the sha256 of `seed:doc_id`. Of the N rows
    with least_words words at least, floor(percent * N / 100) are drawn, by greatest score,
    ties to the smaller id; their rank counts from 1, the others have none. A null text
    has no features; a null id hashes as an empty one and comes before all others.
    Repeated rows are rows of their own and follow each other in rank.
    """
    weighed = weigh(docs.select("doc_id", "text"), gains(docs, target, longest=longest, buckets=buckets), longest=longest, keep=["doc_id"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise), "importance")
    # Scores are whole numbers: gains lie within 1000 * ln(2 ** 63) of zero and the noise between -3,200 and 23,000, so there are under 120,000 of them.
    pool = scored.where(F.col("n_words") >= least_words)
    counted = pool.groupBy("score").agg(F.count("*").alias("n"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"))
    before = counted.select("score", (F.sum("n").over(down) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) * percent / 100).alias("quota"))
    placed = scored.join(F.broadcast(before.where("before < quota")), "score", "left")
    near = F.coalesce((F.col("n_words") >= least_words) & F.col("quota").isNotNull(), F.lit(False))
    # noise spreads ids over scores: whatever the weights, one score has about a part in 2,700 of them
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "n_words"))
    drawn = placed.where(near).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("quota"), F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return drawn.select(*out).union(placed.where(~near).withColumn("rank", F.lit(None).cast("long")).select(*out))
