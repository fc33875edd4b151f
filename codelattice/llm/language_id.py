"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every labelled training document is counted, by Spark; the log-probability matrix
(languages x buckets) has a fixed width, is checked against a size limit and is
broadcast; texts are scored in Arrow batches with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
_CHUNK = 1 << 20
_MULTIPLIERS = tuple(np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    #: languages x buckets, float32
    log_prob: np.ndarray
    orders: tuple[int, ...]


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Code points in lower case; all that aren't letters count as a space. A space stands at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_is_letter()[codes], codes, np.uint32(32))


def _buckets(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each n-gram, by the place where it starts."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.intp)
    h = np.full(size, (0x9E3779B9 * n) & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h += (codes[k : k + size] + np.uint32(k + 1)) * _MULTIPLIERS[k % len(_MULTIPLIERS)]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - bits)).astype(np.intp)


def _slices(codes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """A very long text in slices of bounded size that overlap by n - 1, so that each n-gram is in one."""
    for at in range(0, max(1, len(codes) - n + 1), _CHUNK):
        yield codes[at : at + _CHUNK + n - 1]


def train(docs: DataFrame, *, bits: int = 16, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.1, max_model_mb: int = 128) -> Model:
    """Count the n-grams of `text` per `lang` over every row of docs and return the model.

    Rows with a null lang or text, or a text without letters, teach nothing. Repeated
    rows count as often as they occur. The model takes languages * 2**bits * 4 bytes;
    more than max_model_mb raises, since it is broadcast. One row per language, the
    model itself, reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not any(map(str.isalpha, text)):
                        continue
                    total = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    n_docs[lang] = n_docs.get(lang, 0) + 1
                    codes = _codes(text)
                    for n in orders:
                        for piece in _slices(codes, n):
                            if len(found := _buckets(piece, n, bits)) > 4096:
                                total += np.bincount(found, minlength=1 << bits)
                            else:
                                np.add.at(total, found, 1)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], n_docs[lang]), pa.int64())], ["lang", "bucket", "n"]
            )

    def row(table: pa.Table) -> pa.Table:
        """One language's row of the matrix, as bytes, and the number of its documents."""
        bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
        counts = np.full(1 << bits, smoothing)
        counts[bucket[bucket >= 0]] += n[bucket >= 0]
        weights = np.log(counts / counts.sum()).astype(np.float32)
        return pa.table({"lang": table["lang"].slice(0, 1), "n_docs": pa.array([int(n[bucket < 0].sum())]), "weights": pa.array([weights.tobytes()], pa.binary())})

    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    limit = max_model_mb * 1_000_000 // (4 << bits)
    if rows.select("lang").distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"over {limit} languages; their model would take over {max_model_mb} MB")
    found = counted.groupBy("lang").applyInArrow(row, "lang string, n_docs long, weights binary").orderBy("lang").collect()
    if not found:
        return Model((), np.zeros(0), np.zeros((0, 1 << bits), np.float32), orders)
    docs_of = np.array([r.n_docs for r in found], np.float64)
    log_prob = np.stack([np.frombuffer(r.weights, np.float32) for r in found])
    return Model(tuple(r.lang for r in found), np.log(docs_of / docs_of.sum()), log_prob, orders)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    bits = int(model.log_prob.shape[1]).bit_length() - 1 if model.languages else 0
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows = [i for i, x in enumerate(texts) if model.languages and x and any(map(str.isalpha, x))]
    at = 0
    while at < len(rows):
        some, held, size = [], [], 0
        while at < len(rows) and (not some or size + len(texts[rows[at]]) <= _CHUNK):
            some.append(rows[at])
            held.append(_codes(texts[rows[at]]))
            size += len(held[-1])
            at += 1
        total = np.tile(model.log_prior, (len(some), 1))
        ends = np.cumsum([len(x) for x in held])
        starts = ends - [len(x) for x in held]
        codes = np.concatenate(held)
        for n in model.orders:
            if len(some) == 1:  # perhaps very long
                for part in _slices(codes, n):
                    found = _buckets(part, n, bits)
                    total[0] += [w[found].sum(dtype=np.float64) for w in model.log_prob]
                continue
            found = _buckets(codes, n, bits)
            first, last = starts, np.maximum(starts, ends - n + 1)
            for k, w in enumerate(model.log_prob):
                run = np.zeros(len(found) + 1)
                np.cumsum(w[found], dtype=np.float64, out=run[1:])
                total[:, k] += run[last] - run[first]
        total -= total.max(axis=1, keepdims=True)
        np.exp(total, out=total)
        total /= total.sum(axis=1, keepdims=True)
        for i, k, p in zip(some, total.argmax(axis=1), total.max(axis=1), strict=True):
            best[i], score[i] = model.languages[k], p
    return best, score


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction (a learned language, or 'und' for a null text or one without letters) and its score.

    keep: the columns of docs to return, all by default; those named like the two new
    ones are replaced. Every row is scored by its text alone, in its whole length.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    # a text that is kept is sent once
    sent = keep.index("text") if "text" in keep and docs.schema["text"].dataType == T.StringType() else len(keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                best, score = score_texts(shipped.value, part.column(sent).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(best, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    extra = [F.col("text").cast("string").alias("__text")] if sent == len(keep) else []
    return docs.select(*(docs[f"`{c}`"] for c in keep), *extra).mapInArrow(scored, schema)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, learning from the folds that aren't held out.

    A null doc_id belongs to no fold: it is neither learned from nor held out.
    """
    model = train(docs.where(fold() != 1))
    rows = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is identified with a score of min_score at least, with their own columns."""
    model = train(docs.where(fold() != 1))
    names = ("__lang_pred", "__score")
    while set(names) & set(docs.columns):  # a column of docs may have such a name
        names = tuple(f"_{n}" for n in names)
    found = predict(docs, model, names=names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score)).select(*(found[f"`{c}`"] for c in docs.columns))
