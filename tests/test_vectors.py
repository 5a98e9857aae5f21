import pytest
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.operators import vectors as VO


def test_norms_and_p_below_one(spark):
    df = spark.createDataFrame([([3.0, -4.0],)], "features array<double>")
    r = df.select(V.norm("features", 1), V.norm("features", 2), V.norm("features", float("inf"))).first()
    assert tuple(r) == (7.0, 5.0, 4.0)
    with pytest.raises(ValueError):
        V.norm("features", 0.5)


def test_sparse_dense_round_trip(spark):
    df = spark.createDataFrame([([0.0, 2.0, 0.0, -1.0],), ([],)], "features array<double>")
    sp = df.select(V.to_sparse("features").alias("s"))
    rows = sp.collect()
    assert rows[0].s.indices == [1, 3] and rows[0].s.values == [2.0, -1.0] and rows[0].s.size == 4
    back = sp.select(V.to_dense("s").alias("d")).collect()
    assert back[0].d == [0.0, 2.0, 0.0, -1.0] and back[1].d == []


def test_argmax_sparse_rules(spark):
    sp = spark.createDataFrame([
        (4, [1, 2], [-1.0, -2.0]),   # negative actives -> first inactive index 0
        (3, [0, 1, 2], [-1.0, 0.0, -2.0]),  # no inactive -> index of max (the explicit zero)
        (4, [0, 2], [-1.0, 0.0]),    # max 0 at 2, inactive 1 earlier -> 1
        (3, [], []),                 # all implicit zeros -> 0
        (0, [], []),                 # empty -> -1
        (3, [1], [5.0]),             # positive max -> 1
    ], "size int, indices array<int>, values array<double>")
    got = [r[0] for r in sp.select(V.argmax(V.sparse("size", "indices", "values"), is_sparse=True)).collect()]
    assert got == [0, 1, 1, 0, -1, 1]


def test_compress_rule(spark):
    df = spark.createDataFrame([([0.0] * 9 + [1.0],), ([1.0, 2.0, 0.0],)], "features array<double>")
    got = [r.c.is_sparse for r in df.select(V.compress("features").alias("c")).collect()]
    assert got == [True, False]


def test_sparse_from_pairs_sorts_and_rejects_duplicates(spark):
    pairs = spark.createDataFrame([(1, 3, 1.0), (1, 0, 2.0)], "id long, index int, value double")
    r = VO.sparse_from_pairs(pairs, 5).first()
    assert r.features.indices == [0, 3] and r.features.values == [2.0, 1.0]
    dup = spark.createDataFrame([(1, 3, 1.0), (1, 3, 2.0)], "id long, index int, value double")
    with pytest.raises(Exception):
        VO.sparse_from_pairs(dup, 5).collect()
    with pytest.raises(Exception):
        VO.sparse_from_pairs(pairs, 3).collect()


def test_dedupe_dense_equals_sparse(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, features array<double>")
    out = sorted((r.id, r.n_copies) for r in VO.dedupe_vectors(df).collect())
    assert out == [(1, 2), (3, 1)]


def test_size_mismatch_raises(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception):
        df.select(V.sqdist("a", "b")).collect()


def test_select_and_bias(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    assert df.select(V.select("features", [2, 0])).first()[0] == [3.0, 1.0]
    assert df.select(V.append_bias("features")).first()[0] == [1.0, 2.0, 3.0, 1.0]


def test_log1p_exp_overflow_safe(spark):
    df = spark.createDataFrame([(1000.0,), (-1000.0,), (0.0,)], "x double")
    got = [r[0] for r in df.select(V.log1p_exp("x")).collect()]
    assert got[0] == 1000.0 and got[1] == 0.0 and abs(got[2] - 0.6931471805599453) < 1e-15
