"""Toxicity: a bidirectional gated recurrent network over words and their characters, scoring all overlapping windows.

Labels are per document, but a few words decide them, so the network learns from
windows: those of a toxic document that score highest, and those of a clean one that
score highest or come at random, chosen anew each epoch, and from loops of one word of
a clean document. A document's score is that of
its highest window. Training takes a bounded sample of labelled rows; scoring runs in
Arrow batches over every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm import gru
from codelattice.llm.common import mix64, text_or_empty
from codelattice.llm.language_id import _is_letter

WINDOW, STRIDE = 24, 12
_PIECE = 1 << 19

@dataclass(frozen=True)
class Model:
    params: gru.Params
    #: sorted hashes of the words with an embedding of their own
    words: np.ndarray
    #: log-odds from which a document counts as toxic
    threshold: float


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """chars (see gru) and hashes of the distinct tokens, the number of each token of the texts, and how many tokens each text has.

    A token is a run of lower-case letters, in pieces of gru.TOKEN letters; nothing else is read.
    """
    codes = np.frombuffer("\0".join([x.lower() for x in texts] + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _is_letter()[codes]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    n_parts = -(-size // gru.TOKEN)
    part = np.arange(n_parts.sum()) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    start, size = np.repeat(start, n_parts) + part * gru.TOKEN, np.minimum(np.repeat(size, n_parts) - part * gru.TOKEN, gru.TOKEN)
    h = np.full(len(start), 7, np.uint64)
    for k in range(gru.TOKEN):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = (h[more] ^ codes[start[more] + k]) * np.uint64(0x9FB21C651E98DF25)
        h[more] ^= h[more] >> np.uint64(29)
    distinct, first, number = np.unique(mix64(h), return_index=True, return_inverse=True)
    at = start[first][:, None] + np.arange(gru.TOKEN)
    there = np.arange(gru.TOKEN) < size[first][:, None]
    chars = np.where(there, (codes[np.where(there, at, 0)] * np.uint32(2654435761)) >> np.uint32(25), -1).astype(np.int16) if len(first) else np.zeros((0, gru.TOKEN), np.int16)
    ends = np.cumsum([len(x.lower()) + 1 for x in texts])
    counts = np.diff(np.append(0, np.searchsorted(start, ends)))
    return chars, distinct, number, counts


def _rows(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows of the word embedding; 0 for unknown words."""
    at = np.minimum(np.searchsorted(words, hashes), max(0, len(words) - 1))
    return np.where(words[at] == hashes, at + 1, 0) if len(words) else np.zeros(len(hashes), np.int64)


def windows(number: np.ndarray, counts: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """The overlapping windows of each text, as token numbers (-1: none), and the text of each; the last one ends with its text."""
    n = np.maximum(0, -(-(counts - width) // stride)) + 1
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    at = np.minimum(k * stride, np.maximum(counts[text] - width, 0))[:, None] + np.arange(width)
    begins = (np.cumsum(counts) - counts)[text][:, None]
    there = at < counts[text][:, None]
    return np.where(there, np.append(number, -1)[np.where(there, at + begins, 0)], -1), text


def document_odds(model: Model, texts: list[str]) -> np.ndarray:
    """The log-odds of the highest window of each text."""
    chars, hashes, number, counts = tokens(texts)
    found, text = windows(number, counts)
    return np.maximum.reduceat(gru.odds(model.params, chars, _rows(model.words, hashes), found), np.flatnonzero(np.diff(text, prepend=-1))) if len(texts) else np.zeros(0, np.float32)


def _leaning(number: np.ndarray, owner: np.ndarray, label: np.ndarray, held: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many standard deviations more of each token's contexts lie in toxic documents than by chance, and whether it has `least` contexts.

    A context is the pair of tokens around it, counted once in each class, so copies of a
    document teach nothing new.
    """
    before, behind = np.append(-1, number[:-1]), np.append(number[1:], -1)
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = -1
    behind[np.flatnonzero(np.diff(owner, append=-1))] = -1
    around = mix64((before * (n + 1) + behind).astype(np.uint64))
    used = ~held[owner]
    each = np.unique(np.stack([number[used].astype(np.uint64), label[owner[used]].astype(np.uint64), around[used]]), axis=1)
    in_toxic = np.bincount(each[0].astype(np.int64), each[1].astype(np.float64), minlength=n)
    total = np.bincount(each[0].astype(np.int64), minlength=n)
    chance = total * in_toxic.sum() / max(1, total.sum())
    return ((in_toxic - chance) / np.sqrt(chance + 1)).astype(np.float32), total >= least


def fit(texts: list[str], toxic: list[int], *, seed: int = 5, epochs: int = 5, steps: int = 60, batch: int = 48, others: int = 4, rate: float = 0.01, rounds: int = 4, decay: float = 1e-3, drop: float = 0.3, least_contexts: int = 4) -> Model:
    """Learn from some documents: in each step batch windows of toxic ones and `others` times as many of clean ones.

    In the first epoch windows come at random; then those of a toxic document that the
    network scores highest, and of clean ones the highest and random ones in turn, beside
    batch windows that repeat one word. Words
    of least_contexts distinct contexts at least have an embedding of their own; one of its
    numbers starts as the word's leaning to toxic documents. Every fifth document
    only helps to set the threshold. Without documents of both labels nothing is learned:
    the score is the share of toxic ones.
    """
    label, rng = np.array(toxic, bool), np.random.default_rng(seed)
    held = np.arange(len(label)) % 5 == 4
    if not label[~held].any() or label[~held].all():
        p, share = gru.initial(seed, 0), (label.sum() + 1) / (len(label) + 20)
        return Model(p | {"out": 0 * p["out"], "bias": np.array([np.log(share / (1 - share))], np.float32)}, np.zeros(0, np.uint64), 0.0)
    chars, hashes, number, counts = tokens(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    lean, known = _leaning(number, owner, label, held, len(hashes), least_contexts)
    words = hashes[known]
    codes, p = _rows(words, hashes), gru.initial(seed, len(words))
    p["words"][1:, 0] = lean[known] / 4
    found, text = windows(number, counts)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    learn, adam = ~held[text], gru.Adam(p, decay)
    clean, bad = np.flatnonzero(learn & ~label[text]), learn & label[text]
    weight = np.repeat([0.5 / batch, 0.5 / (batch * (others + 1))], [batch, batch * (others + 1)]).astype(np.float32)
    calm = np.append(number[~held[owner] & ~label[owner]], -1)
    for epoch in range(epochs):
        score = rng.random(len(found)) if epoch == 0 else gru.odds(p, chars, codes, found)
        order = np.lexsort((-score, text))
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found)) - firsts[text[order]]
        high, hard = np.flatnonzero(bad & (rank < (8 if epoch == 0 else 2))), clean[rank[clean] < 1]
        for step in range(min(steps * (3 if epoch == 0 else 1), 15 + rounds * len(high) // batch)):
            some = np.concatenate([rng.choice(high, batch), rng.choice(hard if step % 2 else clean, batch * others)])
            loops = np.repeat(rng.choice(calm, batch)[:, None], WINDOW, axis=1)
            used, local = np.unique(np.concatenate([found[some], loops]), return_inverse=True)
            local = local.reshape(-1, WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            keep = (rng.random(len(used)) >= drop).astype(np.float32)
            _, grads = gru.loss_and_gradient(p, chars[used], codes[used], local, np.repeat([0.95, 0.0], [batch, batch * (others + 1)]), weight, keep)
            adam.step(p, grads, rate * 0.7**epoch)
    highest = np.maximum.reduceat(gru.odds(p, chars, codes, found), firsts)
    return Model(p, words, _threshold(highest[held], label[held]))


def _threshold(odds: np.ndarray, label: np.ndarray) -> float:
    """The middle of the cutoffs with the greatest F1 among those from -2 to 4; 0 where under four labels are toxic."""
    if label.sum() < 4:
        return 0.0
    grid = np.linspace(-2, 4, 61)
    right = np.array([(label & (odds >= c)).sum() for c in grid])
    f1 = 2 * right / (np.array([(odds >= c).sum() for c in grid]) + label.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(grid[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 3000, max_chars: int = 20_000, **fitting) -> Model:
    """Fit on at most max_docs documents (doc_id, text) of labels (doc_id, toxic), half of them toxic if there are so many.

    The sample is of those with the smallest hash of their id; texts of over max_chars
    characters are left out of it, so the driver never holds more than max_docs * max_chars
    characters. A document is toxic if one of its labels says so; null labels and ids teach nothing.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    half = max_docs // 2
    picked = marked.where("toxic = 1").orderBy("h", "doc_id").limit(half).unionByName(marked.where("toxic = 0").orderBy("h", "doc_id").limit(max_docs - half))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") <= max_chars)
    # picked has max_docs rows at most; repeated ids don't lengthen the sample
    found = rows.join(F.broadcast(picked), "doc_id").orderBy("h", "doc_id", "text").limit(max_docs).select("text", "toxic").collect()
    return fit([r.text for r in found], [r.toxic for r in found], **fitting)


def score(docs: DataFrame, model: Model, *, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with the score (0 to 1) of each whole text's highest window and 1 where it is 0.5 or more, else 0.

    A null text, or one without letters, has one empty window. keep: the columns of docs
    to return, all by default; those named like the two new ones are replaced. Only the
    text is read. The model has a fixed size (about 300 kB) and is broadcast.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            texts, at = batch.column(len(keep)), 0
            while at < batch.num_rows:
                some, size = [], 0
                while at + len(some) < batch.num_rows and (not some or size < _PIECE):
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                # single floats depend in their last places on the texts beside them
                odds = np.round(document_odds(model, some).astype(np.float64), 4) - model.threshold
                value = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, *names])
                at += len(some)

    return docs.select(*(docs[f"`{c}`"] for c in keep), text_or_empty().alias("__text")).mapInArrow(scored, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5; a null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learning from the labels of the ids that aren't held out."""
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
