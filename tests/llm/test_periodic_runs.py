"""Periodic runs against a brute-force search of every period and place."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codelattice.llm import periodic_runs
from codelattice.llm.common import table
from codelattice.llm.queries import op13_periodic_runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, least=24, times=3):
    """(start, length, period) of every maximal stretch, by trying each period; the smallest period of a stretch counts."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // times + 1):
        t = 0
        while t < n - q:
            if words[t] != words[t + q]:
                t += 1
                continue
            s = t
            while t < n - q and words[t] == words[t + q]:
                t += 1
            if (length := t - s + q) >= max(least, times * q) and (s, length) not in seen:
                seen.add((s, length))  # a multiple of the period has the same stretch
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or (key := r[1] * best[2] - best[1] * r[2]) > 0 or (key == 0 and (r[0], r[2]) < (best[0], best[2])):
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = op13_periodic_runs(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    want = [plain_row(r.doc_id, r.text) for r in docs]
    assert rows_of(got) == sorted(map(repr, want)) and sum(r[1] for r in want) > 20


@pytest.mark.parametrize("seed", range(60))
def test_small_alphabets(seed):
    """Texts over few words, with runs in runs, side by side and overlapping."""
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.randrange(1, 6)):
        words = []
        for _ in range(rng.randrange(6)):
            block = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 33, 40]))]
            part = block * rng.choice([1, 2, 3, 4, 9]) + block[: rng.randrange(len(block))]
            if rng.random() < 0.4:  # a run whose period holds runs
                part = (part + [99]) * rng.choice([2, 3, 4])
            words += part
        texts.append(words)
    ids = np.array([w for t in texts for w in t], np.int64)
    found = periodic_runs.runs(ids, np.cumsum([len(t) for t in texts]))
    assert found.tolist() == sorted([i, *r] for i, t in enumerate(texts) for r in plain_runs(t))


def test_other_bounds():
    rng = random.Random(1)
    for least, times in [(4, 4), (6, 3), (30, 5), (9, 9)]:
        for _ in range(40):
            words = [rng.randrange(2) for _ in range(rng.randrange(80))]
            found = periodic_runs.runs(np.array(words, np.int64), np.array([len(words)]), least, times)
            assert found[:, 1:].tolist() == [list(r) for r in plain_runs(words, least, times)]
    with pytest.raises(ValueError):
        periodic_runs.runs(np.zeros(5, np.int64), np.array([5]), 24, 2)


def test_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names, Unicode, a very long text, an empty table."""
    loop = "a b c " * 9
    texts = [None, "", " \t\n", "x", loop, loop, "é ü É " * 12, "w " * 70_000, ("p q r s " * 6 + "end ") * 5, "a " * 23, "a " * 24]
    rows = [(i if i else None, t, 1, "clash") for i, t in enumerate(texts)] + [(4, loop, 1, "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    small = [r for r in rows if r[1] is None or len(r[1]) < 10_000]
    assert rows_of(got.where("doc_id is null or doc_id <> 7")) == sorted(repr(plain_row(r[0], r[1])) for r in small)
    long = got.where("doc_id = 7").first()
    assert long.n_runs == 1 and (long.start, long.length, long.period, long.exponent_milli) == (0, 70_000, 1, 70_000_000)
    found = periodic_runs.find(docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    assert found.where("doc_id = 5").first().collapsed == "a b c"
    assert op13_columns(periodic_runs.digest(periodic_runs.find(docs.limit(0)))) == 0


def op13_columns(df):
    return len(df.collect())


def test_registered_table(spark):
    """One row per document, in the given table's number."""
    sf = "/root/testdata/sf0.001"
    assert op13_periodic_runs(spark, sf).count() == table(spark, sf, "documents").count()
