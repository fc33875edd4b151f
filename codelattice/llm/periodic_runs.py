"""Periodic runs of words, by seeds that are extended on their diagonals.

A run of period q repeats itself q words on: its words match on the diagonal of lag q
over length - q words. With a length of `least` words and of `times` periods, that
overlap has a minimum for every q. Runs of whole documents are found by k-grams of the
minimum: level by level (k doubles, lags lie in (k / 2, k]) the occurrences of each
k-gram in a document are chained to their next one, each chain link is a seed of its
lag, and seeds that a run already covers on that lag are skipped.

With k >= q, a k-gram of a run whose smallest period is q has its next occurrence
exactly q words on, so links between neighbouring occurrences are enough and never
name a multiple of a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.common import WORD, grams, mix64, pieces, ranges, spaced, text_or_empty, utf8_column, words_of

_PIECE = 1 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def seed_length(least: int, times: int) -> int:
    """Words that a run of any period matches itself on at least, on the diagonal of its period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _repeats(ids: np.ndarray, text: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The texts in which some k-gram stands twice, and perhaps a few more: equal k-grams have equal hashes."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    at = np.arange(len(ids) - k + 1)
    whole = at + k <= ends[text[at]]
    owner = text[at[whole]]
    mine = mix64(grams(ids, k)[whole] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found = np.sort(mine)
    twice = found[1:][found[1:] == found[:-1]]
    return np.unique(owner[np.isin(mine, twice)]) if len(twice) else np.zeros(0, np.int64)


class _Levels:
    """Exact names of the k-grams of some texts, for k = first, 2 * first, 4 * first, ...: equal grams of one text share a name, no others do."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, ends: np.ndarray, first: int):
        self.at, self.text, self.ends = np.arange(len(ids)), text, ends
        self.k, self.name = 1, self._named(text.astype(np.int64), ids.astype(np.int64), np.ones(len(ids), bool))
        half, done = self.name, 0  # names of grams of a power of two, and of those of the bits of `first` so far
        size, name = 1, None
        while True:
            if first & size:
                name = half if name is None else self._joined(name, half, done, size)
                done += size
            if 2 * size > first:
                break
            half = self._joined(half, half, size, size)
            size *= 2
        self.k, self.name = first, name

    def _named(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """One name for each distinct pair among the whole grams; the others get -1."""
        out = np.full(len(left), -1)
        key = left[whole] * (int(right.max(initial=0)) + 1) + right[whole]
        out[whole] = np.unique(key, return_inverse=True)[1]
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray, a: int, b: int) -> np.ndarray:
        """Names of grams of a + b words out of those of a and of b words."""
        behind = np.full(len(right), -1)
        behind[: max(0, len(right) - a)] = right[a:]
        whole = (self.at + a + b <= self.ends[self.text]) & (left >= 0) & (behind >= 0)
        return self._named(left, behind, whole)

    def double(self) -> None:
        self.name, self.k = self._joined(self.name, self.name, self.k, self.k), 2 * self.k

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and lag of each k-gram that stands again in its text, with the distance to its next place."""
        whole = np.flatnonzero(self.name >= 0)
        order = whole[np.argsort(self.name[whole], kind="stable")]
        again = self.name[order[1:]] == self.name[order[:-1]]
        return order[:-1][again], (order[1:] - order[:-1])[again]


def _reach(x: np.ndarray, lag: int, at: int, stop: int, step: int) -> int:
    """The first place from `at` on, going by step (1 or -1) as far as stop, where words of that lag differ."""
    size = 64
    while at != stop:
        n = min(size, abs(stop - at))
        a = at if step > 0 else at - n + 1
        same = x[a : a + n] == x[a + lag : a + n + lag]
        same = same if step > 0 else same[::-1]
        if not same.all():
            return at + step * int(same.argmin())
        at, size = at + step * n, 2 * size
    return at


def runs(ids: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """text, start, length, period of every run, in this order of importance, of texts laid end to end.

    ids: a number for each distinct word. ends: where each text ends. start counts from
    the text's first word.
    """
    if times < 3 or least < times:
        raise ValueError("runs take three periods and as many words at least")
    first, begins = seed_length(least, times), np.append(0, ends[:-1])
    text = np.repeat(np.arange(len(ends)), ends - begins)
    kept = _repeats(ids, text, ends, first)
    if not len(kept):
        return np.zeros((0, 4), np.int64)
    words = ranges(begins[kept], (ends - begins)[kept])
    x, size = ids[words], (ends - begins)[kept]
    last = np.cumsum(size)
    owner = np.repeat(np.arange(len(kept)), size)
    levels, found, shortest = _Levels(x, owner, last, first), [], 1
    while True:
        at, lag = levels.seeds()
        if not len(at):
            break
        fits = (lag >= shortest) & (lag <= levels.k)
        order = np.lexsort((at[fits], lag[fits]))
        at, lag = at[fits][order], lag[fits][order]
        heads = np.append(True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
        covered: dict[int, int] = {}  # furthest end of a run found, by lag
        for i, q in zip(at[heads].tolist(), lag[heads].tolist(), strict=True):
            if i + levels.k + q <= covered.get(q, 0):
                continue
            doc = owner[i]
            low, high = int(last[doc] - size[doc]), int(last[doc])
            start = _reach(x, q, i - 1, low - 1, -1) + 1
            end = _reach(x, q, i, high - q, 1) + q
            covered[q] = end
            if end - start >= max(least, times * q):
                found.append((kept[doc], start - low, end - start, q))
        shortest = levels.k + 1
        levels.double()
    return np.array(sorted(found), np.int64).reshape(-1, 4)


def _collapsed(words: pa.Array, ends: np.ndarray, found: np.ndarray) -> pa.Array:
    """Each text's words that no run has behind its first period, joined by one space."""
    begins = np.append(0, ends[:-1])
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, begins[found[:, 0]] + found[:, 1] + found[:, 3], 1)
    np.add.at(change, begins[found[:, 0]] + found[:, 1] + found[:, 2], -1)
    keep = np.cumsum(change)[:-1] == 0
    data, starts = spaced(words)
    letters = np.repeat(keep, np.diff(starts))
    rank = np.append(0, np.cumsum(keep))
    several = rank[ends] > rank[begins]
    last = np.flatnonzero(keep)[rank[ends[several]] - 1]  # the last word kept of each text; the space behind it goes
    letters[starts[last + 1] - 1] = False
    size = np.append(0, np.cumsum(letters))
    offsets = size[starts[np.append(0, ends)]].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[letters])])


def find(docs: DataFrame, *, least: int = 24, times: int = 3, keep: list[str] | None = None, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs with every run of each whole text (array of start, length, period, by start, then period) and the text without its repeats.

    A run is a stretch of words of at least `least` words and `times` smallest periods
    that no neighbouring word extends. Words are what ASCII white space separates; they
    are compared byte by byte. Null and empty texts have no words: no runs, and an empty
    collapsed text. keep: the columns of docs to return, all by default; those named
    like the two new ones are replaced. Repeated rows and ties of ids are rows like
    others. Each text is one task's work, with memory in proportion to the text.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.ArrayType(RUN)), T.StructField(names[1], T.StringType())])
    kinds = pa.struct([(n, pa.int64()) for n in RUN.names])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(len(keep)))
            for a, b in pieces(offsets, _PIECE):
                words, ends = words_of(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a])
                ids = words.dictionary_encode().indices.to_numpy() if len(words) else np.zeros(0, np.int64)
                found = runs(ids, ends, least, times)
                at = np.searchsorted(found[:, 0], np.arange(b - a + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(kinds)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), listed, _collapsed(words, ends, found)], [*keep, *names])

    return docs.select(*(docs[f"`{c}`"] for c in keep), text_or_empty().alias("__text")).mapInArrow(searched, schema)


def strongest(found: Column) -> Column:
    """Of an array of runs, the one with the greatest length / period, compared exactly; ties go to the smallest start, then period. Null if there is none."""

    def compare(a: Column, b: Column) -> Column:
        by_exponent = b["length"] * a["period"] - a["length"] * b["period"]
        return F.signum(F.when(by_exponent != 0, by_exponent).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])).cast("int")

    return F.get(F.array_sort(found, compare), F.lit(0))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and the digests of what find gives for docs with a doc_id."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = found.withColumn("__best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"__best.{n}").alias(n) for n in RUN.names),
        F.floor(F.expr("1000 * __best.length div __best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, the texts of the ids whose crc32 ends in 0 made periodic from a word on that the crc32 also gives.

    With h = crc32 of the id as decimal text, g = h div 10 and n words: word i >= a
    becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8).
    A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewritten(ws: Column) -> Column:
        # the words are a variable of this lambda, so that they are split once and not for each word
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))
    planted = F.get(F.transform(F.array(words), rewritten), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & text_or_empty().rlike(WORD), planted).otherwise(text_or_empty()).alias("text"))
