"""Importance resampling against a plain version with dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from codelattice.llm import importance
from codelattice.llm.queries import op11_importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, benchmark):
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in benchmark for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (doc_id, _), (n, f) in zip(docs, found):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    pool = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[5]))
    for i, r in enumerate(pool[: 25 * len(pool) // 100]):
        r[4] = i + 1
    return sorted(repr(tuple(r[:5])) for r in rows)


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op11_importance(spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert rows_of(got) == plain(docs, benchmark)


def test_edges(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows, clashing names, Unicode, long words and long texts."""
    rng = random.Random(3)
    words = ["Ab", "c9", "é", "ÉA", "x" * 63, "y" * 65, "z" * 70_000, "ﬀ", "İ", "0"]
    texts = [None, "", " .\0\n", "A", "é" * 40, "a-b_c" * 30, "w " * 300_000, "no\x7fgap " * 60_000 + "q" * 600_000, "Àé ö\x00" * 70_000]
    texts += ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    docs = [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(i, texts[i]) for i in range(40, 50)]
    bench = [None, "", "c9 é c9", "Ab c9 " * 20]
    kinds = "doc_id long, text string, n_words string, weight string, score double, bucket int"
    spark.createDataFrame([(*d, "clash", "clash", 0.5, 1) for d in docs], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows_of(op11_importance(spark, str(tmp_path))) == plain(docs, bench)
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = importance.weigh(held, np.zeros(10_000, np.int64))
    assert kept.columns == ["doc_id", "text", "score", "bucket", "n_words", "n_features", "weight"]
    none = held.limit(0)
    assert importance.resample(none, none).collect() == []
    assert rows_of(importance.resample(held, none)) == plain(docs, [])


def test_windows_of_three_words():
    found = importance.Features(3, 997)
    texts = ["one two three four", "", "x", "two three"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    n, parts = found.of(raw, np.append(0, np.cumsum([len(t) for t in texts])))
    assert n.tolist() == [4, 0, 1, 2]
    for size, (text, bucket) in enumerate(parts, 1):
        want = [(i, zlib.crc32(" ".join(w[j : j + size]).encode()) % 997) for i, t in enumerate(texts) for w in [t.split()] for j in range(len(w) - size + 1)]
        assert list(zip(text.tolist(), bucket.tolist())) == want
