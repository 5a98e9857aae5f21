"""Products, pairs and Gram matrices against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import linalg as LA
from strata.operators import skew


def coo(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.mark.parametrize("shape", [(5, 7, 3), (300, 520, 270), (1, 600, 1)])
@pytest.mark.parametrize("threshold", [1, 4096])
def test_matmul_blocks(spark, shape, threshold):
    n, k, m = shape
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, k)) * (rng.random((n, k)) < min(1, 900 / (n * k)))
    b = rng.normal(size=(k, m)) * (rng.random((k, m)) < min(1, 900 / (k * m)))
    c = rng.normal(size=(n, m)) * (rng.random((n, m)) < min(1, 50 / (n * m)))
    got = LA.matmul(coo(spark, a), coo(spark, b), 2.0, -0.5, coo(spark, c), shape=shape, threshold=threshold)
    assert np.allclose(dense(got, (n, m)), 2 * a @ b - 0.5 * c)
    assert got.groupBy("i", "j").count().filter("count > 1").count() == 0


def test_matmul_hot_inner_index_and_repeated_entries(spark):
    """Inner index 3 has 4,000 rows of A and 2,000 columns of B in 128 blocks dealt over tasks."""
    a = spark.range(4000).select(F.col("id").alias("i"), F.lit(3).cast("long").alias("j"), F.lit(1.0).alias("v"))
    b = spark.range(2000).select(F.lit(3).cast("long").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    got = LA.matmul(a.unionByName(a), b, threshold=2)
    assert got.agg(F.count("*"), F.min("v"), F.max("v")).first() == (8_000_000, 4.0, 4.0)


def test_matmul_checks_and_structure(spark):
    a, b = coo(spark, np.array([[1.0, -1.0]])), coo(spark, np.array([[2.0], [2.0]]))
    assert [tuple(r) for r in LA.matmul(a, b).collect()] == [(0, 0, 0.0)]  # a sum of zero is an entry
    assert LA.matmul(a, b.limit(0)).count() == 0
    for shape in ((1, 1, 1), (0, 2, 1), (1, 2, 0)):
        with pytest.raises(ValueError, match="out of range"):
            LA.matmul(a, b, shape=shape)
    with pytest.raises(ValueError, match="C's rows"):
        LA.matmul(a, b, c=coo(spark, np.array([[0.0], [1.0]])), shape=(1, 2, 1))


def test_matvec_of_a_long_column(spark):
    a = spark.range(3000).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.col("id").cast("double").alias("v"))
    a = a.unionByName(coo(spark, np.array([[0.0, 5.0]])))
    x = spark.createDataFrame([(0, 2.0), (1, 1.0)], "i long, v double")
    got = {r.i: r.v for r in LA.matvec(a, x, threshold=100).collect()}
    assert got == {i: 2.0 * i + (5.0 if i == 0 else 0) for i in range(3000)}


def test_gram_matrix_partials(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(6)
    assert np.allclose(dense(LA.gram_matrix(df, alpha=0.5), (12, 12)), 0.5 * x.T @ x)
    upper = LA.gram_matrix(df, upper_only=True)
    assert upper.count() == 78 and upper.filter("i > j").count() == 0
    assert LA.gram_matrix(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="every point must hold|differ in size"):
        LA.gram_matrix(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>").coalesce(1)).collect()


def test_pairs_in_any_mix(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 9)) * (rng.random((60, 9)) < 0.4)
    y = rng.normal(size=(60, 9)) * (rng.random((60, 9)) < 0.4)
    y[:5], x[7], y[8] = x[:5] + 1e-9, 0, 0

    def table(m, sparse):
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, features array<double>")
        return df.select("id", V.to_sparse("features").alias("features")) if sparse else df

    for left in (False, True):
        for right in (False, True):
            a, b = table(x, left), table(y, right)
            dot = {r.id: r.dot for r in LA.pairwise_dot(a, b, "id").collect()}
            far = {r.id: r.sqdist for r in LA.pairwise_sqdist(a, b, "id").collect()}
            near = {r.id: r.sqdist for r in LA.pairwise_sqdist_from_norms(a, b, "id").collect()}
            assert np.allclose([dot[i] for i in range(60)], (x * y).sum(axis=1))
            assert np.allclose([far[i] for i in range(60)], ((x - y) ** 2).sum(axis=1), rtol=1e-12, atol=0)
            assert np.allclose([near[i] for i in range(60)], ((x - y) ** 2).sum(axis=1), rtol=1e-6, atol=0)


@pytest.mark.parametrize("kinds", [(False, False), (True, False), (True, True)])
def test_pairs_of_different_sizes_raise(spark, kinds):
    def one(v, sparse):
        df = spark.createDataFrame([(1, v)], "id long, features array<double>")
        return df.select("id", V.to_sparse("features").alias("features")) if sparse else df

    a, b = one([1.0, 2.0, 3.0], kinds[0]), one([1.0, 2.0], kinds[1])
    for op in (LA.pairwise_dot, LA.pairwise_sqdist, LA.pairwise_sqdist_from_norms):
        with pytest.raises(Exception, match="sizes differ"):
            op(a, b, "id").collect()
        with pytest.raises(ValueError, match="no vector column"):
            op(a.withColumn("features", F.lit("x")), b, "id")


def test_salted_join_keeps_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    df = df.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("k"), "id"))
    side = spark.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "k long, name string")
    dealt, hot = skew.salt_hot(df, "k", "id", threshold=100)
    assert hot.count() == 3 and dealt.select("k", "_salt").distinct().count() > 8
    assert skew.join_hot(dealt, "k", side, hot).count() == 667
    none, no_hot = skew.salt_hot(df, "k", "id")
    assert no_hot is None and skew.join_hot(none, "k", side, no_hot).count() == 667
