import math

import numpy as np

from strataline.llm import ann as A

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=10):
    good = {i: [float(x) for x in v] for i, v, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    sizes = [len(v) for v in good.values()]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n))
    good = {i: v for i, v in good.items() if len(v) == d}
    out = {}
    for q in queries:
        if q in good:
            near = sorted((math.dist(good[q], v), i) for i, v in good.items() if i != q)[:k]
            out[q] = near
    return out


def test_exact_where_all_lists_are_probed(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=8))], 1) for i in range(400)]
    rows += [(i, [1.0] * 8, 1) for i in range(400, 700)]  # a large group of copies
    rows += [(700, None, 1), (701, [0.0] * 8, 1), (702, [float("nan")] * 8, 1), (703, [float("inf")] + [1.0] * 7, 1), (704, [None] + [1.0] * 7, 1), (705, [1.0, 2.0], 1), (706, [], 1), (None, [1.0] * 8, None), (5, rows[5][1], 1)]
    every = spark.createDataFrame(rows, ROWS)
    queries = [0, 5, 100, 400, 555, 700, 701, 702, 705]
    got = A.search(every.selectExpr("*", "'clash' id", "'clash' v", "1 cell"), every.where(every.vec_id.isin(queries)), lists=8, probe=8, rerank=50)
    by_query = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    expected = brute(rows, queries)
    assert set(by_query) == set(expected)
    for q, near in expected.items():
        assert [i for _, i in by_query[q]] == [i for _, i in near], q
        assert np.allclose([s for s, _ in by_query[q]], [s for s, _ in near])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 1.0], 1)], ROWS)
    assert [(r.query_id, r.rank, r.vec_id) for r in A.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert A.search(few, few.limit(0)).count() == 0
    assert A.search(few.limit(0), few.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centers[i % 20] + rng.normal(size=16) * 0.5], 1) for i in range(3000)]
    every = spark.createDataFrame(rows, ROWS)
    got = A.search(every, every.where("vec_id % 100 = 0"), lists=64, probe=24, rerank=200).collect()
    expected = brute(rows, range(0, 3000, 100))
    hits = sum((r.vec_id in {i for _, i in expected[r.query_id]}) for r in got)
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_query_on_the_driver_tables(spark):
    """The registered query with its own parameters: recall, scores, and the share of the vectors that it scores."""
    import os

    for name in ("sf0.001", "sf0.1"):
        path = f"/root/testdata/{name}"
        if not os.path.isdir(path):
            continue
        rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
        expected = brute(rows, [i for i, *_ in rows if i % 100 == 0])
        got = A.op1_ann(spark, path).collect()
        assert {r.query_id for r in got} == set(expected) and len(got) == 10 * len(expected)
        exact = {i: v for i, v, _ in rows}
        hits = 0
        for r in got:
            assert abs(r.score - math.dist(exact[r.query_id], exact[r.vec_id])) < 1e-9
            hits += r.vec_id in {i for _, i in expected[r.query_id]}
        assert hits / len(got) >= 0.9


def test_clustered_vectors_cost_few_lists():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.2
    q = A.Quantiser(x, 8 * math.isqrt(len(x)), 4)
    assert len(q.coarse) == 500 and q.probe < 50
    cell, codes, term = q.encode(x)
    near = np.concatenate([b[codes[:, j]] for j, b in enumerate(q.books)], axis=1) + q.coarse[cell]
    d = q.distances(x[:3])[:, cell] + term - 2 * sum(t[:, codes[:, j]] for j, t in enumerate(q.tables(x[:3])))
    assert np.allclose(d, ((x[:3, None] - near[None]) ** 2).sum(2))


def test_hot_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(A, "GROUP", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)] + [(i, [1.0] * 8, 1) for i in range(300, 700)]
    every = spark.createDataFrame(rows, ROWS)
    got = A.search(every, every.where("vec_id in (0, 100, 500)"), probe=10**6).collect()
    expected = brute(rows, [0, 100, 500])
    for q, near in expected.items():
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in near]


def test_kmeans_keeps_all_centroids_busy():
    x = np.repeat(np.eye(3), 50, axis=0)
    near, dist = A.nearest(x, A.kmeans(x, 3))
    assert len(set(near.tolist())) == 3 and np.allclose(dist, 0)
