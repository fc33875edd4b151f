"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens as a whole. Tier two: other pre-tokens are merged with a heap of ranked
pairs over a linked list of bytes. The tables depend on the vocabulary file alone;
the driver builds them once and broadcasts them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of each worker's memo of pre-tokens; beyond it the memo starts anew.
MEMO_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, one probe.

    Keys are dealt into buckets; from the largest bucket on, each seeks the first
    displacement that puts its keys into free slots. Looking up a string that isn't a
    key gives a slot whose key differs, so a comparison tells.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = max(1, len(ranks))
        self.n_buckets = m = max(1, n // 3)
        self.keys: list[bytes | None] = [None] * n
        self.ranks = array("q", [-1] * n)
        self.displacement = array("q", [0] * m)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % m].append((h, key))
        order = sorted(range(m), key=lambda i: -len(buckets[i]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(h, d) for h, _ in buckets[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for s, (_, key) in zip(slots, buckets[b], strict=True):
                self.keys[s] = key
                self.ranks[s] = ranks[key]
        free = (s for s in range(n) if self.keys[s] is None)
        for b in order:
            if len(buckets[b]) == 1:  # a lone key takes any free slot, named outright
                s = next(free)
                self.displacement[b] = -1 - s
                self.keys[s] = buckets[b][0][1]
                self.ranks[s] = ranks[self.keys[s]]

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The rank, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.displacement[h % self.n_buckets])
        return self.ranks[s] if self.keys[s] == key else -1


class Vocabulary:
    """Both tiers and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.hash = PerfectHash(ranks)
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: ids of a pair of ids that merge, by the pair as one number: first << 32 | second
        self.byte_ids = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merging the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.byte_ids[b] for b in word]
        if -1 in ids:
            raise ValueError("the vocabulary lacks a byte")
        n, pairs = len(ids), self.pairs
        get = pairs.get
        heap = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        if not heap:
            return ids
        if len(heap) > 1:
            heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i = pop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or get(ids[i] << 32 | ids[j]) != rank:
                continue  # one side has merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    push(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                push(heap, (r, h))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        rank = self.hash.get(word)
        if rank >= 0:
            return rank.to_bytes(4, "little")
        return np.array(self.merge(word), "<u4").tobytes() if len(word) > 64 else b"".join([x.to_bytes(4, "little") for x in self.merge(word)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


class _Memo(dict):
    """Encoded pre-tokens seen of late."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> bytes:
        word = token.encode("utf-8", "surrogatepass")
        found = self.vocabulary.encode_word(word)
        if len(word) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[token] = found
        return found


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.find = regex.compile(pattern).findall
        self.memo = _Memo(vocabulary)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.find(text)))


def encode_decode(docs: DataFrame, path: str, pattern: str, *, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode `text` of each row of docs by the ranks in path and decode the ids again.

    Returns the columns in keep (doc_id by default) and n_tokens, ids_sha256 (of the
    ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded
    bytes); with_ids: also `ids`, an array of the ids. A null or empty text has no
    tokens. Each match of pattern is encoded by itself; there are no special tokens.
    Rows are independent: repeated rows give repeated results.
    """
    keep = ["doc_id"] if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    schema = T.StructType(
        [docs.schema[c] for c in keep]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value, pattern)
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(at, 500)
                n, first, second, ids = [], [], [], []
                for text in part.column(len(keep)):
                    coded = encoder.encode(text.as_py() or "")
                    n.append(len(coded) // 4)
                    first.append(hashlib.sha256(coded).hexdigest())
                    second.append(hashlib.sha256(shipped.value.decode(coded)).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(coded, "<u4").astype(np.int64))
                columns = [pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())] + [pa.array(ids, pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], names)

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
