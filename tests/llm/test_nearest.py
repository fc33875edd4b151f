import numpy as np

from codelattice.llm import nearest
from codelattice.llm.common import table


def test_recall(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    held = rows.collect()
    x, ids = np.array([r.embedding for r in held], float), np.array([r.vec_id for r in held])
    got = {}
    for r in nearest.search(rows, rows.where("vec_id % 100 = 0"), candidates=60).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        hit += len(set(best) & {v for v, _ in found.values()})
        assert sorted(found) == list(range(1, 11))
        assert all(np.isclose(s, d[ids == v][0]) for v, s in found.values())
    assert hit >= 0.9 * 10 * len(got)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, []), (None, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (1, [1.0, 1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", nearest.F.lit(1))
    got = [tuple(r) for r in nearest.search(data, data.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert nearest.search(data.limit(0), data.limit(0)).count() == 0


def crowded(n_copies=1300, n_near=1300, n_other=1400, dim=64):
    """ids and vectors: one large group of copies, one tight cluster of a single direction, and others."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n_copies + n_near + n_other, dim))
    x[:n_copies] = x[0]
    x[n_copies : n_copies + n_near] = x[n_copies] * (1 + 1e-4 * rng.normal(size=(n_near, 1)))
    return rng.permutation(len(x)), x


def test_copies_and_clusters_lose_none(spark):
    ids, x = crowded()
    # an id that stands on several rows is found once, by its nearest
    ids = np.concatenate([ids, ids[:3], ids[-3:]])
    x = np.concatenate([x, x[-6:]])
    data = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").coalesce(1)
    asked = [int(i) for i in np.concatenate([ids[:5], ids[1300:1320], ids[2600:2620]])]
    got = {}
    for r in nearest.search(data, data.where(nearest.F.col("vec_id").isin(asked)).dropDuplicates(["vec_id"])).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    checked = 0
    for q in asked:
        if (ids == q).sum() > 1:
            continue
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        least = {}
        for i, s in zip(ids.tolist(), d.tolist(), strict=True):
            if i != q:
                least[i] = min(s, least.get(i, np.inf))
        assert [got[q][k] for k in range(1, 11)] == sorted(least, key=lambda i: (least[i], i))[:10]
        checked += 1
    assert checked > 35
