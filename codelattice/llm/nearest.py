"""Approximate nearest neighbours: score-aware anisotropic quantisation, 4-bit table scans, exact reranking.

Euclidean nearness is a maximum inner product: -|q - x|^2 = 2 q.x - |x|^2 - |q|^2.
Codebooks of 16 centres per subspace are fitted on a bounded sample; the residual's
part parallel to the vector weighs more than the orthogonal part. Every vector is
coded; scans rank by table look-ups and the best are measured exactly, and so is
every further vector that the error of its code leaves in question.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.common import materialize, shuffle_partitions

CENTRES = 16
#: Queries of so many bytes at most are broadcast; more are dealt out with the blocks in cells.
BROADCAST_BYTES = 32_000_000


@dataclass(frozen=True)
class Codebooks:
    #: subspaces x 16 x width
    centres: np.ndarray
    #: how much more the parallel residual weighs
    eta: float

    @property
    def shape(self) -> tuple[int, int]:
        return self.centres.shape[0], self.centres.shape[2]

    def split(self, x: np.ndarray) -> np.ndarray:
        m, width = self.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), m, width)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent of |r|^2 + (eta - 1) (r.x / |x|)^2."""
        parts = self.split(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        codes = np.empty((len(x), parts.shape[1]), np.uint8)
        parallel = np.zeros((len(x), parts.shape[1]))
        for r in range(rounds):
            for j in range(parts.shape[1]):
                residual = parts[:, j, None, :] - self.centres[j][None]
                along = np.einsum("nkw,nw->nk", residual, unit[:, j])
                others = parallel.sum(axis=1) - parallel[:, j]
                cost = (residual**2).sum(axis=2) + (self.eta - 1) * (along + others[:, None]) ** 2 * (r > 0)
                codes[:, j] = cost.argmin(axis=1)
                parallel[:, j] = along[np.arange(len(x)), codes[:, j]]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: inner products with the centres that a byte, two codes of four bits, stands for."""
        one = np.einsum("qmw,mkw->qmk", self.split(q), self.centres)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(q), 1, CENTRES))], axis=1)
        return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits a byte, the first one low."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
    return codes[:, ::2] | codes[:, 1::2] << 4


def unpack(packed: np.ndarray, m: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)[:, :m]


def fit(x: np.ndarray, *, width: int = 2, eta: float = 4.0, rounds: int = 6, seed: int = 7) -> Codebooks:
    """Alternate coding and the weighted least-squares update of the centres."""
    m = -(-x.shape[1] // width)
    books = Codebooks(np.zeros((m, CENTRES, width)), eta)
    parts = books.split(x)
    rng = np.random.default_rng(seed)
    for j in range(m):
        books.centres[j] = parts[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), j]
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(rounds):
        codes = books.encode(x)
        for j in range(m):
            approx = np.stack([books.centres[i][codes[:, i]] for i in range(m)], axis=1)
            along = np.einsum("nmw,nmw->nm", parts - approx, unit)
            others = along.sum(axis=1) - along[:, j]
            for k in range(CENTRES):
                rows = np.flatnonzero(codes[:, j] == k)
                if not len(rows):
                    continue
                p, u, o = parts[rows, j], unit[rows, j], others[rows]
                left = np.eye(width) * len(rows) + (eta - 1) * u.T @ u
                right = p.sum(axis=0) + (eta - 1) * ((np.einsum("nw,nw->n", p, u) + o)[:, None] * u).sum(axis=0)
                books.centres[j, k] = np.linalg.solve(left, right)
    return books


def _blocks(rows: DataFrame, size: int, books=None) -> DataFrame:
    """ids, vectors (doubles) and, by the broadcast books, packed codes of up to `size` rows as bytes, one block per row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                codes = pack(books.value.encode(values.reshape(len(ids), -1))).tobytes() if books else b""
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids.tobytes(), values.tobytes(), codes)], ["ids", "vectors", "codes"])

    return rows.mapInArrow(run, "ids binary, vectors binary, codes binary")


class _Block:
    """The distinct vectors of a block, coded, and the ids of each."""

    def __init__(self, books: Codebooks, ids: np.ndarray, xs: np.ndarray, packed: np.ndarray):
        xs = xs + 0.0  # no negative zeros, so that equal vectors have equal bytes
        _, first, group = np.unique(xs.view(np.dtype((np.void, 8 * xs.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, group))
        ids, group = ids[order], group[order]
        new = np.append(True, (np.diff(group) != 0) | (np.diff(ids) != 0))
        self.ids, group = ids[new], group[new]
        self.start = np.searchsorted(group, np.arange(len(first) + 1))
        #: a vector with one id is out for the query of that id
        self.lone = np.diff(self.start) == 1
        self.least = self.ids[self.start[:-1]]
        #: in how many vectors one id stands at most
        self.spread = int(np.unique(self.ids, return_counts=True)[1].max())
        self.books, self.xs = books, xs[first]
        self.packed, self.norms = packed[first], (self.xs**2).sum(axis=1)
        codes = unpack(self.packed, books.shape[0])
        coded = np.stack([books.centres[j][codes[:, j]] for j in range(codes.shape[1])], axis=1)
        self.coded_norms = (coded**2).sum(axis=(1, 2))
        self.residuals = np.sqrt(((books.split(self.xs) - coded) ** 2).sum(axis=(1, 2)))

    def nearest(self, ids: np.ndarray, qs: np.ndarray, neighbours: int, candidates: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """vec_ids and scores of each query's nearest ids, all of them exact."""
        tables = self.books.tables(qs)
        inner = np.zeros((len(qs), len(self.xs)))
        for j in range(self.packed.shape[1]):
            inner += tables[:, j, :][:, self.packed[:, j]]
        own = (ids[:, None] == self.least[None]) & self.lone
        approx = np.where(own, -np.inf, 2 * inner - self.norms)
        measure = lambda r, c: np.sqrt(((self.xs[c] - qs[r]) ** 2).sum(axis=1))
        # this many vectors hold `neighbours` ids at least
        need = neighbours * self.spread
        n = min(max(candidates, need), len(self.xs))
        best, far = np.argpartition(-approx, n - 1, axis=1)[:, :n], np.full(len(qs), np.inf)
        for r in range(len(qs)):
            d = measure(r, best[r][~own[r, best[r]]])
            if len(d) >= need:
                far[r] = np.partition(d, need - 1)[need - 1]
        # |q - x| >= |q - coded x| - |x - coded x|; then by the inner products, less what rounding may add
        norms = (qs**2).sum(axis=1)[:, None]
        slack = lambda other: 8 * (qs.shape[1] + 8) * np.finfo(float).eps * (norms + other)
        least = np.sqrt(np.maximum(norms + self.coded_norms - 2 * inner - slack(self.coded_norms), 0)) - self.residuals * (1 + 1e-9)
        open_ = ~(least > far[:, None] * (1 + 1e-9)) & ~own
        some = np.flatnonzero(open_.any(axis=0))
        open_ = open_[:, some]
        squares, room = norms + self.norms[some] - 2 * (qs @ self.xs[some].T), slack(self.norms[some])
        limit = far**2
        if len(some) >= need:
            limit = np.fmin(limit, np.partition(np.where(open_, squares + room, np.inf), need - 1, axis=1)[:, need - 1])
        open_ &= ~(squares - room > limit[:, None] * (1 + 1e-9))
        out = []
        for r in range(len(qs)):
            c = some[open_[r]]
            d = measure(r, c)
            if len(d) > need:
                kept = d <= np.partition(d, need - 1)[need - 1]
                c, d = c[kept], d[kept]
            # the smallest ids of each vector, one more for the query's own
            sizes = np.minimum(self.start[c + 1] - self.start[c], neighbours + 1)
            place = np.repeat(self.start[c] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            found, d = self.ids[place], np.repeat(d, sizes)
            found, d = found[found != ids[r]], d[found != ids[r]]
            order = np.lexsort((found, d))
            found, d = found[order], d[order]
            once = np.sort(np.unique(found, return_index=True)[1])[:neighbours]
            out.append((found[once], d[once]))
        return out


def search(vectors: DataFrame, queries: DataFrame, *, neighbours: int = 10, candidates: int = 160, sample_rows: int = 20_000, width: int = 2, eta: float = 4.0, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of vectors (vec_id, embedding) for each row of queries.

    score is the Euclidean distance in double precision on the given vectors; ties go
    to the smaller vec_id; a query never finds its own vec_id. Rows whose vec_id or
    vector is null, zero, or holds a null, NaN or infinite component take no part,
    nor do those whose length isn't the commonest one. The codebooks are fitted on the
    sample_rows rows of smallest hash; all rows are coded and scanned. `candidates`
    of each block of `block` rows are measured first, then all that the error of their
    codes doesn't rule out, so no neighbour is lost. Copies of a vector are measured
    once a block. Repeated rows of one vec_id are found once.
    """
    usable = lambda d: d.where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"
    ).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = usable(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = common["n"]
    rows = rows.where(F.size("embedding") == dim)
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    books = fit(taken.flatten().to_numpy().reshape(-1, dim), width=width, eta=eta)
    shipped = vectors.sparkSession.sparkContext.broadcast(books)
    # the index: coded once, by blocks
    packed = materialize(_blocks(rows, block, shipped), "index").withColumnsRenamed({"ids": "x_ids", "vectors": "x"})
    asked_rows = materialize(usable(queries).where(F.size("embedding") == dim), "queries")
    n_bytes = asked_rows.count() * (dim + 1) * 8
    dealt = asked_rows.repartition(max(1, -(-n_bytes // BROADCAST_BYTES)))
    asked = materialize(_blocks(dealt, 512), "asked").drop("codes").withColumnsRenamed({"ids": "q_ids", "vectors": "q"})

    def scan(batches):
        books = shipped.value
        last, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                x_ids, x, codes, q_ids, q = (batch.column(k)[i].as_py() for k in range(5))
                if (x_ids, x) != last:
                    last, held = (x_ids, x), _Block(books, np.frombuffer(x_ids, np.int64), np.frombuffer(x).reshape(-1, dim), np.frombuffer(codes, np.uint8).reshape(len(x_ids) // 8, -1))
                qs, qi = np.frombuffer(q).reshape(-1, dim), np.frombuffer(q_ids, np.int64)
                out = [[], [], []]
                for t in range(0, len(qs), 64):
                    for k, (found, d) in enumerate(held.nearest(qi[t : t + 64], qs[t : t + 64], neighbours, candidates)):
                        out[0].append(np.full(len(found), qi[t + k]))
                        out[1].append(found)
                        out[2].append(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    # every block of vectors meets every block of the stated queries
    if n_bytes <= BROADCAST_BYTES:
        met = packed.join(F.broadcast(asked))
    else:
        down, across = -(-n_bytes // BROADCAST_BYTES), shuffle_partitions(vectors.sparkSession)
        own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        met = packed.withColumn("i", own("x_ids", across)).withColumn("j", every(down)).join(asked.withColumn("j", own("q_ids", down)).withColumn("i", every(across)), ["i", "j"])
        met = met.sortWithinPartitions("x_ids")
    met = met.select("x_ids", "x", "codes", "q_ids", "q")
    found = met.mapInArrow(scan, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
