import itertools

import pytest

from codelattice.llm import mixing


def cells(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_rake_meets_marginals(spark):
    rows = [(s, x, t, 10 + 7 * i) for i, (s, x, t) in enumerate(itertools.product("abc", "de", "fg"))]
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"d": 0.6, "e": 0.4}, "topic": {"f": 0.5, "g": 0.5}}
    out = mixing.rake(cells(spark, rows), targets).collect()
    total = sum(r[3] for r in rows)
    for d, shares in targets.items():
        for value, share in shares.items():
            assert sum(r.weight for r in out if r[d] == value) == pytest.approx(share * total, rel=1e-6)


def test_calibrated_probabilities_meet_the_budget(spark):
    weighted = spark.createDataFrame([("a", 100, 400.0), ("b", 1000, 600.0), ("c", 400, 500.0), ("d", 0, 0.0)], "source string, tokens long, weight double")
    out = mixing.calibrate(weighted, 0.5).collect()
    assert sum(r.tokens * r.probability for r in out) == pytest.approx(750)
    assert {r.source: r.probability for r in out}["a"] == 1.0


def test_mix_and_sample(spark):
    rows = [(i, f"w{i} some words here", "en" if i % 3 else None, "web" if i % 2 else "code") for i in range(400)] + [(None, None, None, None), (500, "", "en", "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("probability", mixing.F.lit("own"))
    out = mixing.mix(docs).collect()
    assert len(out) == 402
    kept = {r.doc_id for r in out if r.kept}
    assert 140 < len(kept) < 260 and 500 not in kept and None not in kept
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns and {r.doc_id for r in sampled.collect()} == kept
    assert mixing.mix(docs.limit(0)).count() == 0
