import hashlib
import random
import re

import numpy as np
from codelattice.llm import fm_index, substring_dedup, suffix_dedup, suffix_sort, windows
from pyspark.sql import functions as F


def corpus():
    rng = random.Random(3)
    passages = [" ".join(f"p{rng.randrange(50)}é" for _ in range(30)) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 200), (5, "loop " * 60), (6, "loop  " * 25)]
    for i in range(40):
        parts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40))) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice([*passages, ""]))
        rows.append((-5 if i == 0 else 10 + rng.randrange(10**6), "\n".join(parts)))
    rows += [(2 * 10**6 + i, t) for i, (_, t) in enumerate(rows[:12])]
    return rows


def brute(rows, window, words):
    seen, out = set(), {}
    for i, text in sorted(rows):
        units = re.findall(b"[^\x20\x09-\x0d]+", (text or "").encode()) if words else (text or "").encode()
        gone, own = [False] * len(units), set()
        for s in range(len(units) - window + 1):
            w = tuple(units[s : s + window])
            if w in seen or (words and w in own):
                gone[s : s + window] = [True] * window
            own.add(w)
        seen |= own
        kept = [u for u, g in zip(units, gone) if not g]
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(units), sum(gone), spans, hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest())
    return out


def test_bytes(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("id", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_bytes(docs).collect()}
    assert got == brute(corpus(), 50, False)


def test_words(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_words(docs).collect()}
    assert got == brute(corpus(), 20, True)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_bytes(empty).count() == 0 and substring_dedup.remove_words(empty).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for size, symbols in ((1, 2), (50, 2), (400, 3), (3000, 256)):
        text = rng.integers(1, symbols + 1, size).astype(np.uint16)
        text[size // 2 : size // 2 + 100] = 1
        text[-1] = 0
        raw = [tuple(text[i : i + 50]) for i in range(size)]
        found = suffix_sort.two_stage_sort(text, np.ones(size, bool), 50)
        assert sorted(found) == list(range(size))
        assert [raw[i] for i in found] == sorted(raw)
        shared = suffix_sort.common_prefixes(text, found, 50)
        for a, b, n in zip(found[:-1], found[1:], shared[1:]):
            assert n == next((d for d, (x, y) in enumerate(zip(raw[a], raw[b])) if x != y), 50)


def test_statistics():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 500), 0)
    text[300:330] = text[100:130]
    ends = np.arange(20, 501)
    found, start = fm_index.FMIndex(text, 20).statistics(text, ends, 20)
    for e, n, s in zip(ends, found, start):
        count = lambda m: sum(tuple(text[i : i + m]) == tuple(text[e - m : e]) for i in range(len(text) - m + 1))
        assert count(n) > 1 if n else True
        assert n == 20 or count(n + 1) == 1
    same = {}
    for e, n, s in zip(ends, found, start):
        if n == 20:
            assert same.setdefault(s, tuple(text[e - 20 : e])) == tuple(text[e - 20 : e])
    assert len(same) == len(set(same.values())) and same


def test_hot_hashes_are_split(spark, monkeypatch):
    monkeypatch.setattr(windows, "SPLIT_DOCS", 3)
    monkeypatch.setattr(windows, "SHARD_BYTES", 2000)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_bytes(docs).collect()}
    assert got == brute(corpus(), 50, False)
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_words(docs).collect()}
    assert got == brute(corpus(), 20, True)


def test_very_long_texts_and_slices(spark, monkeypatch):
    monkeypatch.setattr(windows, "_SLICE", 97)
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(4000))
    rows = [(1, long), (2, long[:9000] + "x" * 3000 + long[5000:]), (3, "a" * 5000), (4, "b" + "a" * 700), (None, long[100:400]), (4, "b" + "a" * 701)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run, window, words in ((suffix_dedup.remove_bytes, 50, False), (substring_dedup.remove_words, 20, True)):
        got = sorted(r.kept_sha256 for r in run(docs).collect())
        keyed = [(-1 if i is None else i, hashlib.md5(t.encode()).hexdigest(), t) for i, t in rows]
        order = {k: n for n, k in enumerate(sorted(keyed))}
        want = brute([(order[k], k[2]) for k in keyed], window, words)
        assert got == sorted(v[3] for v in want.values())


def test_words_that_a_polynomial_hash_confuses_stay_apart(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_words(docs).collect()] == [0, 0]


def test_extra_columns_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 0, 0), (1, text, 0, 0), (2, text, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, runs int")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_words(docs).collect()) == [(1, 0), (1, 0), (2, 40)]
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_bytes(docs).collect()) == [(1, 0), (1, 0), (2, len(text))]
