import numpy as np
from pyspark.sql import functions as F

from sawmill.llm import ann


def test_hadamard_is_orthogonal():
    x = ann.hadamard(np.eye(16))
    assert np.allclose(x @ x.T, np.eye(16))
    v = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(ann.rotate(v, 3, 1), axis=1), np.linalg.norm(v, axis=1))


def brute(ids, v, query, k):
    s = v @ v[query]
    s[query] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]], s


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, rank int")


def recall(spark, v, k=20, step=20, **options):
    ids = np.arange(len(v))
    got = ann.search(frame(spark, ids.tolist(), v), F.col("vec_id") % step == 0, k, **options).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["rank"]] = r
    v = v.astype(np.float32).astype(np.float64)
    hits = total = 0
    for q in range(0, len(v), step):
        want, s = brute(ids, v, q, k)
        own = by[q]
        assert sorted(own) == list(range(1, min(k, len(v) - 1) + 1))
        assert all(abs(own[r]["score"] - s[own[r]["vec_id"]]) < 1e-9 for r in own)
        order = [(-own[r]["score"], own[r]["vec_id"]) for r in sorted(own)]
        assert order == sorted(order)
        hits += len({x["vec_id"] for x in own.values()} & set(want.tolist()))
        total += len(want)
    return hits / total


def test_recall_on_unit_vectors(spark):
    v = np.random.default_rng(1).normal(size=(900, 32))
    assert recall(spark, v / np.linalg.norm(v, axis=1, keepdims=True)) >= 0.9


def test_recall_with_norms_and_a_hot_cluster(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)) * rng.uniform(0.5, 3, size=(600, 1))
    v[200:400] = v[200]  # a third is one vector: ties go to the smaller id
    assert recall(spark, v, block=64) >= 0.9


def test_few_and_unusable(spark):
    vectors = [[1, 0], [0.5, 0.5], None, [], [0, 0], [1, None], [float("nan"), 1], [float("inf"), 0], [0, 1, 2]]
    got = ann.search(frame(spark, [0, 1, 2, 3, 4, 5, 6, 7, 20], vectors), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 0.5)]
    twice = ann.search(frame(spark, [0, 0, 3], [[1, 0], [1, 0], [0, 1]]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in twice) == [(0, 1, 0), (0, 1, 0), (0, 2, 3), (0, 2, 3)]
    assert ann.search(frame(spark, [], []), F.col("vec_id") % 20 == 0).count() == 0


def test_the_index_prunes(spark, monkeypatch):
    """At 10,000 vectors without near neighbours: under 0.2 n inner products a query, and nine in ten neighbours found."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(10_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = v.astype(np.float32).astype(np.float64)
    axes, probes, _ = ann.shape(len(x), 64, 32)
    asked, seen, done = np.arange(0, len(x), 100), np.zeros((100, len(x)), dtype=bool), 0
    for t in range(32):
        turned = [ann.signed(ann.rotate(x, t * len(axes) + i, 5), d) for i, d in enumerate(axes)]
        code = np.zeros(len(x), dtype=np.int64)
        for y, d in zip(turned, axes, strict=True):
            code = code * 2 * d + y.argmax(1)
        for row, some in zip(range(100), ann.nearest_buckets([y[asked] for y in turned], probes), strict=True):
            hit = np.isin(code, some)
            done += hit.sum()
            seen[row] |= hit
    near = np.argsort(-(x[asked] @ x.T - 9 * (np.arange(len(x))[None] == asked[:, None])), axis=1)[:, :20]
    assert done / len(asked) < 0.2 * len(x) and np.take_along_axis(seen, near, 1).mean() >= 0.9
    assert recall(spark, v, step=500) >= 0.9


def test_nearest_buckets_are_those_of_the_largest_sums():
    rng = np.random.default_rng(6)
    each = [rng.normal(size=(3, n)) for n in (8, 4, 2)]
    every = (each[0][:, :, None, None] + each[1][:, None, :, None] + each[2][:, None, None, :]).reshape(3, -1)
    for most in (1, 7, 30, 64, 100):
        got = ann.nearest_buckets(each, most)
        for i in range(3):
            assert set(got[i].tolist()) == set(np.argsort(-every[i])[:most].tolist())


def test_shape_follows_the_rows():
    for n in (1, 100, 2000, 10_000, 10**6, 10**9):
        axes, probes, group = ann.shape(n, 64, 32)
        buckets = int(np.prod([2 * d for d in axes]))
        assert axes[0] == 64 and 1 <= probes <= buckets and buckets % group == 0 and (n < 1000 or 0.2 * n <= buckets <= 4 * n)
