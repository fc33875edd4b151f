"""Repeated windows across documents, the frame of both substring operators.

A window is a fixed number of consecutive units (bytes or words). Equal windows have
the same least k-gram hash, and neighbouring windows mostly share theirs, so a text
is a chain of segments: stretches of windows with one least hash. Segments whose
hash occurs once are out after one aggregation; the others are dealt by that hash to
shards of bounded size, where an index over the segments' real units finds windows
that also stand earlier. A hash found in very many documents is split; what its
splits find new is compared once more by the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.common import drop, grams, materialize, pieces, ranges, spaced, utf8_column, word_hashes, words_of

#: Units that are hashed at a time; a longer text is taken in overlapping slices.
_SLICE = 1 << 19
_PIECE = 1 << 20
#: Bytes of segments that one shard is meant to hold.
SHARD_BYTES = 4_000_000
#: Documents with one least hash that stay together.
SPLIT_DOCS = 4096


@dataclass(frozen=True)
class Windows:
    #: units in a window
    length: int
    #: units in a k-gram
    k: int
    words: bool
    #: whether a place earlier in the same document counts
    within: bool
    #: finds windows in a shard: (segments, first, rest) -> mask over window starts, see _judge
    index: Callable

    @property
    def segment_bytes(self) -> int:
        """A guess of a segment's bytes, to choose the number of shards."""
        return (self.length + (self.length - self.k + 2) // 2) * (7 if self.words else 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1])


class _Piece:
    """Some texts laid end to end, their units and where each text's units end."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, kind: Windows):
        self.kind = kind
        if kind.words:
            self.words, self.ends = words_of(data, ends)
            self.units = word_hashes(self.words)
        else:
            self.units, self.ends = data, ends
        self.starts = np.append(0, self.ends[:-1])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first window start, number of windows and least hash of each stretch of windows with one least hash.

        Stretches are cut at twice the window, so no segment grows beyond bounds.
        """
        kind, n = self.kind, len(self.units)
        out: list[tuple] = []
        for a in range(0, max(0, n - kind.length + 1), _SLICE):
            least = _sliding_min(grams(self.units[a : a + _SLICE + kind.length - 1], kind.k), kind.length - kind.k + 1)
            at = np.arange(a, a + len(least))
            text = np.searchsorted(self.ends, at, "right")
            whole = at + kind.length <= self.ends[text]
            new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
            first = np.flatnonzero(new)
            new |= (np.arange(len(least)) - np.repeat(first, np.diff(np.append(first, len(least))))) % (2 * kind.length) == 0
            new &= whole
            last = whole & np.append(new[1:] | ~whole[1:], True)
            first, last = np.flatnonzero(new), np.flatnonzero(last)
            out.append((text[first], at[first], last - first + 1, least[first]))
        if not out:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def often(self) -> tuple[np.ndarray, np.ndarray]:
        """text and hash of the k-grams that stand twice or more in one text."""
        text, found = [], []
        h = grams(self.units, self.kind.k)
        for i, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)):
            own = np.sort(h[a : max(a, b - self.kind.k + 1)])
            own = np.unique(own[:-1][own[1:] == own[:-1]])
            found.append(own)
            text.append(np.full(len(own), i))
        return np.concatenate(text), np.concatenate(found)

    def segments(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        """The units of the windows first .. first + n - 1, as bytes; words are joined by a space."""
        last = first + n + self.kind.length - 1
        if self.kind.words:
            data, offsets = spaced(self.words)
            start, end = offsets[first], offsets[last] - 1
        else:
            data, start, end = self.units, first, last
        bounds = np.append(0, np.cumsum(end - start)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data[ranges(start, end - start)])])


def _pieces(batch: pa.RecordBatch, column: int, kind: Windows) -> Iterator[tuple[int, _Piece]]:
    data, offsets = utf8_column(batch.column(column))
    for a, b in pieces(offsets, _PIECE):
        yield a, _Piece(data[offsets[a] : offsets[b]], offsets[a + 1 : b + 1] - offsets[a], kind)


def _shared(texts: DataFrame, kind: Windows) -> DataFrame:
    """Of texts (d, text): d (hash of a text) and hs (the least hashes of it that other texts have too, and in how many splits each is dealt)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, piece in _pieces(batch, 1, kind):
                text, _, _, h = piece.runs()
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
                text, h = text[new], h[new]
                twice = np.zeros(len(h), bool)
                if kind.within and len(h):
                    # both sorted by text, then hash
                    t2, h2 = piece.often()
                    both = np.lexsort((np.append(np.zeros(len(h), bool), np.ones(len(h2), bool)), np.append(h, h2), np.append(text, t2)))
                    hs, ts = np.append(h, h2)[both], np.append(text, t2)[both]
                    met = np.append((hs[1:] == hs[:-1]) & (ts[1:] == ts[:-1]), False)
                    twice[both[met]] = True
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + at)), pa.array(h.view(np.int64)), pa.array(twice)], ["d", "h", "twice"])

    found = materialize(texts.mapInArrow(emit, "d long, h long, twice boolean"), "leasts")
    counted = found.groupBy("h").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("twice").alias("twice"), F.count("*").alias("n"))
    several = counted.where("lo <> hi or twice").select("h", F.ceil(F.col("n") / SPLIT_DOCS).cast("int").alias("splits"))
    several = materialize(several, "shared")
    by_text = materialize(found.select("d", "h").join(several, "h").groupBy("d").agg(F.collect_list(F.struct("h", "splits")).alias("hs")), "by_text")
    drop(found, several)
    return by_text


def _order(table: pa.Table) -> np.ndarray:
    """Rank of each row's document among those of the table: null ids first, then by id, then by digest."""
    ids, digest = table["doc_id"].combine_chunks(), table["digest"].combine_chunks()
    known = np.asarray(ids.is_valid())
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    half = np.frombuffer(utf8_column(digest)[0].tobytes(), ">u8").reshape(-1, 2)
    columns = (known, ids, half[:, 0], half[:, 1])
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _judge(table: pa.Table, kind: Windows) -> pa.Table:
    """digest, at, n of the windows of a shard that stand earlier in it; of a split also, as `rep`, each window that doesn't.

    Equal segments are indexed once, at their first place.
    """
    coded = table["segment"].combine_chunks().dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    at = table["at"].to_numpy().astype(np.int64)
    rank = _order(table)
    place = rank << 32 | at if kind.within else rank
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, code, place)
    owner, window, key = kind.index(distinct, first, kind)  # per distinct segment and window: which, offset, first place of its class
    n_windows = np.bincount(owner, minlength=len(distinct))
    own = first[owner] + window if kind.within else first[owner]
    gone = key < own
    # rows that stand behind their segment's first place are gone whole
    later = place > first[code]
    start = np.append(0, np.cumsum(n_windows))[:-1]
    row = np.repeat(np.arange(len(code)), n_windows[code])
    at_class = ranges(start[code], n_windows[code])
    flagged = later[row] | gone[at_class]
    place_of = at[row] + window[at_class]
    # stretches of flagged windows
    begins = flagged & ~np.append(False, flagged[:-1] & (row[1:] == row[:-1])) if len(row) else flagged
    ends = flagged & ~np.append(flagged[1:] & (row[1:] == row[:-1]), False) if len(row) else flagged
    b, e = np.flatnonzero(begins), np.flatnonzero(ends)
    keys = table.select(["digest", "doc_id"])
    out = keys.take(pa.array(row[b])).append_column("at", pa.array(place_of[b], pa.int64())).append_column("n", pa.array(e - b + 1, pa.int64())).append_column("rep", pa.nulls(len(b), pa.binary()))
    if table["split"][0].as_py() >= 0:
        new = np.flatnonzero(~flagged)
        raw = _window_bytes(distinct, code[row[new]], window[at_class[new]], kind)
        more = keys.take(pa.array(row[new])).append_column("at", pa.array(place_of[new], pa.int64())).append_column("n", pa.array(np.ones(len(new), np.int64))).append_column("rep", raw)
        out = pa.concat_tables([out, more])
    return out.select(["digest", "doc_id", "at", "n", "rep"])


def _window_bytes(segments: pa.Array, which: np.ndarray, offset: np.ndarray, kind: Windows) -> pa.Array:
    data, bounds = utf8_column(segments)
    if not kind.words:
        start = bounds[which] + offset
        end = start + kind.length
    else:
        spaces = np.flatnonzero(data == 32)
        # words of a segment start at its bound and behind each of its spaces
        first = np.searchsorted(spaces, bounds[which])
        start = np.where(offset == 0, bounds[which], spaces[np.minimum(first + offset - 1, max(len(spaces) - 1, 0))] + 1)
        last = first + offset + kind.length - 1
        stop = bounds[which + 1]
        inside = last < len(spaces)
        end = np.where(inside, np.minimum(spaces[np.minimum(last, max(len(spaces) - 1, 0))], stop), stop)
    offsets = np.append(0, np.cumsum(end - start)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets), pa.py_buffer(data[ranges(start, end - start)])])


def repeated(rows: DataFrame, firsts: DataFrame, kind: Windows, again: bool) -> DataFrame:
    """digest, runs (structs of at, n): the windows of each distinct text that also stand earlier.

    rows: doc_id, digest (of the text), text; firsts: digest, first_id (the smallest
    doc_id of the text). Earlier: in a document that comes before by doc_id (null first),
    then digest, or, if kind.within, further ahead in the same document. again: whether
    rows may be equal in doc_id and text.
    """

    def chosen(side: DataFrame) -> DataFrame:
        """The rows that stand for their text, with what side (firsts and more) has; texts are moved once."""
        found = rows.where(F.octet_length("text") >= kind.length).withColumnRenamed("digest", "__digest").join(side, (F.col("__digest") == side["digest"]) & F.col("doc_id").eqNullSafe(side["first_id"])).drop("__digest", "first_id")
        return found.dropDuplicates(["digest"]) if again else found

    by_text = _shared(chosen(firsts).select(F.xxhash64("digest").alias("d"), "text"), kind)
    total = by_text.agg(F.sum(F.size("hs"))).first()[0] or 0
    shards = max(1, -(-total * kind.segment_bytes // SHARD_BYTES))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy()
            pairs = lists.values.flatten()
            h_all, splits_all = pairs[0].to_numpy().view(np.uint64), pairs[1].to_numpy()
            for base, piece in _pieces(batch, 2, kind):
                text, first, n, h = piece.runs()
                row = text + base
                keep, splits = np.zeros(len(h), bool), np.ones(len(h), np.int64)
                cuts = np.searchsorted(text, np.arange(len(piece.ends) + 1))
                for i in range(len(piece.ends)):
                    own = slice(cuts[i], cuts[i + 1])
                    wanted = h_all[bounds[base + i] : bounds[base + i + 1]]
                    order = np.argsort(wanted)
                    if not len(wanted):
                        continue
                    place = order[np.minimum(np.searchsorted(wanted[order], h[own]), len(wanted) - 1)]
                    keep[own] = wanted[place] == h[own]
                    splits[own] = splits_all[bounds[base + i] : bounds[base + i + 1]][place]
                text, first, n, h, row, splits = (x[keep] for x in (text, first, n, h, row, splits))
                digest = batch.column(0).take(pa.array(row))
                mixed = np.frombuffer(utf8_column(digest)[0].tobytes(), np.uint64).reshape(-1, 2)[:, 0] if len(row) else np.zeros(0, np.uint64)
                split = np.where(splits > 1, (mixed % splits.astype(np.uint64)).astype(np.int64), -1)
                shard = ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
                arrays = [pa.array(shard), pa.array(split), digest, batch.column(1).take(pa.array(row)), pa.array(first - piece.starts[text]), piece.segments(first, n)]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "split", "digest", "doc_id", "at", "segment"])

    schema = "shard long, split long, digest binary, doc_id long, at long, segment binary"
    side = firsts.withColumn("d", F.xxhash64("digest")).join(by_text, "d").drop("d")
    segments = chosen(side).select("digest", "doc_id", "text", "hs").mapInArrow(emit, schema)
    judged = segments.groupBy("shard", "split").applyInArrow(lambda table: _judge(table, kind), "digest binary, doc_id long, at long, n long, rep binary")
    judged = materialize(judged, "judged")
    drop(by_text)
    reps = judged.where("rep is not null").select("rep", "digest", "at", F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("digest"), *([F.col("at")] if kind.within else [])).alias("place"))
    first = reps.groupBy("rep").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    late = reps.join(first, "rep").where("place > first").select("digest", F.struct("at", F.lit(1).cast("long").alias("n")).alias("run"))
    runs = judged.where("rep is null").select("digest", F.struct("at", "n").alias("run")).union(late)
    out = materialize(runs.groupBy("digest").agg(F.collect_list("run").alias("runs")), "runs")
    drop(judged)
    return out


def remove(docs: DataFrame, kind: Windows, *, with_text: bool = False) -> DataFrame:
    """doc_id, units, removed, spans, kept_sha256 (and `kept`, the bytes) for each row of docs.

    Of equal texts only the first is searched: a later copy that is as long as a
    window is covered whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    # the smallest id of each distinct text, null first
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))).alias("at"))
    firsts = materialize(firsts.select("digest", F.col("at.doc_id").alias("first_id")), "firsts")
    again = not rows.groupBy("digest", "doc_id").count().where("count > 1").limit(1).isEmpty()
    runs = repeated(rows, firsts, kind, again)
    # only the row that stands for its text meets the runs; its copies are dealt by their own ids
    side = firsts.join(runs, "digest", "left").withColumnRenamed("digest", "__digest").withColumn("first", F.lit(True))
    marked = rows.join(side, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    marked = marked.select("doc_id", "text", F.coalesce("first", F.lit(False)).alias("first"), "runs")
    names = ["doc_id", "units", "removed", "spans", "kept_sha256", *["kept"] * with_text]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(utf8_column(batch.column(1))[1], _PIECE):
                yield _kept(batch.slice(a, b - a), kind, names)

    schema = "doc_id long, units long, removed long, spans long, kept_sha256 string" + ", kept binary" * with_text
    return marked.mapInArrow(finish, schema)


def _kept(part: pa.RecordBatch, kind: Windows, names: list[str]) -> pa.RecordBatch:
    data, offsets = utf8_column(part.column(1))
    first = part.column(2).to_numpy(zero_copy_only=False)
    if kind.words:
        words, ends = words_of(data, offsets[1:])
        data, bounds = spaced(words)
    else:
        ends, bounds = offsets[1:], np.arange(len(data) + 1)
    starts = np.append(0, ends[:-1])
    n = ends - starts
    gone = np.zeros(len(bounds), np.int64)
    copies = ~first & (n >= kind.length)
    np.add.at(gone, starts[copies], 1)
    np.add.at(gone, ends[copies], -1)
    lists = part.column(3)
    if len(flat := lists.flatten()):
        own = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        at, m = (x.to_numpy() for x in flat.flatten())
        use = first[own]
        at, m = at[use] + starts[own[use]], m[use]
        np.add.at(gone, at, 1)
        np.add.at(gone, at + m + kind.length - 1, -1)
    gone = np.cumsum(gone)[:-1] > 0
    removed = np.append(0, np.cumsum(gone))
    begins = gone & ~np.append(False, gone[:-1]) if len(gone) else gone
    begins[starts[n > 0]] = gone[starts[n > 0]]
    spans = np.append(0, np.cumsum(begins))
    left = np.repeat(~gone, np.diff(bounds)) if kind.words else ~gone
    data, size = data[left], np.append(0, np.cumsum(left))[bounds]
    raw = data.tobytes()
    kept = [raw[size[a] : size[b]] for a, b in zip(starts, ends, strict=True)]
    if kind.words:  # each word carries a space behind it
        kept = [x[:-1] for x in kept]
    arrays = [part.column(0), *(pa.array(x, pa.int64()) for x in (n, removed[ends] - removed[starts], spans[ends] - spans[starts]))]
    arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
    return pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * (len(names) - 5), names)
