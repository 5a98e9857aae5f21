"""Assignment kernel, k-means initialisation and candidate reduction."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.functions.hashing import uniform
from strata.functions.nearest import Centers, matrix_of
from strata.operators import linalg as LA
from strata.plans import kmeans as KM


def draw(seed, *parts):
    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / (1 << 52)


def brute(x, ids, rows):
    d = ((x[:, None, :] - rows[None]) ** 2).sum(axis=2)
    by = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, 0]
    return ids[by], d[np.arange(len(x)), by]


@pytest.mark.parametrize("k", [1, 7, 3000])
@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-6])
def test_nearest_equals_all_distances(k, scale):
    rng = np.random.default_rng(k)
    rows = rng.normal(size=(k, 9)) * scale * rng.choice([1, 10, 100], size=(k, 1))
    rows[k // 2:k // 2 + 3] = rows[0]  # equal centers: the lowest id wins
    ids = rng.permutation(5 * k)[:k].astype(np.int64)
    x = np.vstack([rng.normal(size=(900, 9)) * scale * 30, rows[:100], rows[:50] + 1e-9 * scale, np.zeros((2, 9))])
    label, d = Centers(ids, rows).nearest(x)
    want, dist = brute(x, ids, rows)
    assert (label == want).all()
    assert np.allclose(d, dist, rtol=1e-12, atol=0)


def test_nearest_of_odd_points():
    model = Centers(np.array([4, 9]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    label, d = model.nearest(np.array([[np.nan, 0.0], [np.inf, 1.0], [0.9, 1.0]]))
    assert label.tolist() == [4, 4, 9] and np.isnan(d[:2]).all()
    assert model.partials(np.zeros((0, 2))).sum() == 0
    with pytest.raises(ValueError):
        model.nearest(np.zeros((1, 3)))


def test_far_tiles_are_skipped():
    """Centers on shells of different norm: a point reads its own shell and the next ones only."""
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(40 * 1024, 8))
    rows *= (np.repeat(np.arange(1, 41), 1024) / np.linalg.norm(rows, axis=1))[:, None]
    model = Centers(np.arange(len(rows)), rows)

    class Counted(list):
        read = 0

        def __getitem__(self, i):
            Counted.read += 1
            return super().__getitem__(i)

    model._tiles = Counted(model._tiles)
    label, _ = model.nearest(rows[:500])
    assert (label == np.arange(500)).all() and Counted.read <= 3


def test_matrix_of_flat_blocks_and_bad_rows():
    assert matrix_of(pa.array([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]]), 2).tolist() == [[1, 2], [3, 4], [5, 6]]
    for bad in ([[1.0, 2.0], [1.0]], [[1.0, None]], [None, [1.0, 2.0]], [[], [1.0, 2.0]]):
        with pytest.raises(ValueError):
            matrix_of(pa.array(bad, pa.list_(pa.float64())), 2)


def test_one_plan_for_any_k(spark):
    pts = spark.range(2000).select("id", F.array(*[uniform(i, "id") for i in range(4)]).alias("features"))

    def plan(k):
        c = pts.filter(F.col("id") < k).select(F.col("id").cast("int").alias("center_id"), F.col("features").alias("center"))
        got = LA.nearest_center(pts, c)
        return got, got._jdf.queryExecution().executedPlan().toString()

    (few, small), (_, large) = plan(10), plan(2000)
    assert small.count("\n") == large.count("\n") and "Exchange" not in small and len(large) < len(small) + 200
    x = np.array([[draw(i, j) for i in range(4)] for j in range(2000)])
    want, _ = brute(x, np.arange(10), x[:10])
    assert {r.id: r.cluster for r in few.collect()} == dict(enumerate(want.tolist()))


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(1, [0.2], "a"), (2, [5.0], None)], "id long, features array<double>, cluster_name string")
    c = KM.centers_frame(spark, [(0, [0.0]), (1, [4.0])])
    assert [tuple(r) for r in KM.kmeans_predict(df, c).orderBy("id").collect()] == [(1, [0.2], "a", 0, pytest.approx(0.04)), (2, [5.0], None, 1, 1.0)]
    assert KM.kmeans_predict(df.limit(0), c).count() == 0


def test_uniform_draw(spark):
    rows = spark.range(200).select("id", uniform(3, "id").alias("u")).collect()
    assert all(r.u == draw(3, r.id) for r in rows) and 0.4 < sum(r.u for r in rows) / 200 < 0.6


def weighted_cost(x, w, c):
    return (((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1) * w).sum()


def test_reduce_candidates_draws_by_weight_and_distance(spark):
    """Four far groups and k = 4: D^2 draws hit each group once; a point without weight never counts."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 3)) + 100 * np.eye(3)[i % 3] * (1 + i // 3) for i in range(4)] + [[[1e6, 0, 0]]])
    w = np.r_[rng.integers(1, 50, 120), 0]
    cands = KM.centers_frame(spark, list(enumerate(x.tolist())))
    weights = spark.createDataFrame([(i, int(n)) for i, n in enumerate(w) if n], "cluster int, size long")
    got = np.array([r.center for r in KM.kmeans_reduce_candidates(cands, weights, 4, seed=1).orderBy("center_id").collect()])
    want = np.array([np.average(x[30 * i:30 * i + 30], axis=0, weights=w[30 * i:30 * i + 30]) for i in range(4)])
    assert np.allclose(sorted(got.tolist()), sorted(want.tolist()))
    again = KM.kmeans_reduce_candidates(cands.repartition(7), weights, 4, seed=1).orderBy("center_id").collect()
    assert np.allclose(got, [r.center for r in again])


def test_draws_are_in_proportion():
    n = [0, 0, 0]
    for seed in range(3000):
        n[min(range(3), key=lambda i: KM.draw_key(seed, 0, i, [1.0, 2.0, 5.0][i]))] += 1
    assert all(abs(a / 3000 - b) < 0.03 for a, b in zip(n, (1 / 8, 2 / 8, 5 / 8), strict=True))
    assert KM.draw_key(1, 0, 0, 0.0) == math.inf


def test_candidates_are_points_and_reduce_the_cost(spark):
    pts = spark.range(4000).select("id", F.array(*[uniform(i, "id") * (F.col("id") % 5 + 1) for i in range(3)]).alias("features"))
    cands = KM.parallel_candidates(pts, 20, steps=3, seed=4)
    assert [r.center_id for r in cands.orderBy("center_id").collect()] == list(range(cands.count()))
    assert cands.join(pts, F.col("center") == F.col("features"), "left_anti").count() == 0
    assert 60 <= cands.count() <= 200
    init = KM.kmeans_init_parallel(pts, 20, steps=3, seed=4)
    assert init.count() == 20
    at_random = KM.kmeans_init_random(pts, 20, seed=4)
    assert KM.total_cost(pts, init).first().cost < KM.total_cost(pts, at_random).first().cost


def test_many_candidates(spark):
    """Thousands of candidates go through tables and one matrix, not through rows on the driver."""
    pts = spark.range(30_000).select("id", F.array(uniform(1, "id"), uniform(2, "id")).alias("features"))
    cands = KM.parallel_candidates(pts, 3000, steps=2, seed=1)
    assert cands.count() > 6000
    assert KM.cluster_sizes(KM.kmeans_predict(pts, cands)).agg(F.sum("size")).first()[0] == 30_000


def test_degenerate_initialisation(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, features array<double>")
    assert [tuple(r) for r in KM.kmeans_init_parallel(same, 3).collect()] == [(0, [1.0, 2.0])]
    assert KM.kmeans_init_random(same, 3, seed=1).count() == 1
    twice = same.unionByName(same)
    assert KM.kmeans_init_random(twice, 9, seed=1).count() == 1
    for call in (KM.kmeans_init_parallel, KM.kmeans_init_random):
        with pytest.raises(ValueError):
            call(same.limit(0), 3, seed=1)
