import pytest
from pyspark.sql import functions as F

from strata import catalog as C
from strata.operators import layout as L
from strata.operators import linalg as LA
from strata.plans import kmeans as KM
from strata.sources import files as FI


def centers_of(df):
    return sorted((r.center_id, tuple(round(x, 9) for x in r.center)) for r in df.collect())


def test_layout_invariance(spark, sf):
    pts = C.points(spark, sf)
    init = C.lowest_centers(spark, sf)
    row = centers_of(KM.kmeans_fit_fixed(pts, init, 3))
    sql = centers_of(KM.kmeans_fit_fixed(pts, init, 3, method="sql"))
    rows = L.row_index(pts, "id", "row")
    cols = centers_of(KM.kmeans_fit_columns(L.transpose(rows, block_rows=64), init, 3))
    flat = centers_of(KM.kmeans_fit_blocks(L.pack_flat(rows, block_rows=64), init, 3))
    colb = centers_of(KM.kmeans_fit_blocks(L.pack_columns(rows, block_rows=64), init, 3))
    assert row == sql == cols == flat == colb


def test_fewer_distinct_points_than_k(spark):
    pts = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)] + [(5 + i, [2.0, 2.0]) for i in range(5)],
                                "id long, features array<double>")
    c = KM.kmeans_fit(pts, k=4, init="random", seed=1)
    assert sorted(tuple(r.center) for r in c.collect()) == [(1.0, 1.0), (2.0, 2.0)]


def test_empty_cluster_keeps_center(spark):
    pts = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id long, features array<double>")
    init = KM.centers_frame(spark, [(0, [0.0]), (1, [1.0]), (2, [100.0])])
    out = dict((r.center_id, r.center) for r in KM.lloyd_step(pts, init).collect())
    assert out[2] == [100.0]


def test_ties_go_to_lowest_center(spark):
    pts = spark.createDataFrame([(0, [1.0])], "id long, features array<double>")
    cs = KM.centers_frame(spark, [(3, [2.0]), (1, [0.0])])
    assert LA.nearest_center(pts, cs).first().cluster == 1


def test_parameter_checks(spark):
    pts = spark.createDataFrame([(0, [1.0])], "id long, features array<double>")
    with pytest.raises(ValueError):
        KM.kmeans_fit(pts, k=0)
    with pytest.raises(ValueError):
        KM.kmeans_fit(pts, k=1, init="bogus")
    empty = pts.limit(0)
    with pytest.raises(ValueError):
        KM.kmeans_init_random(empty, 2, seed=1)


def test_convergence_stops_at_fixed_point(spark, sf):
    pts = C.points(spark, sf)
    init = C.lowest_centers(spark, sf)
    _, iters, _ = KM.lloyd_loop(pts, init, 100, 1e-4)
    assert iters < 100


def test_kmeans_parallel_init_returns_k(spark, sf):
    c = KM.kmeans_init_parallel(C.points(spark, sf), 5, steps=2, seed=3)
    assert c.count() == 5


def test_cluster_model_round_trip(spark, sf, tmp_path):
    c = C.lowest_centers(spark, sf)
    path = str(tmp_path / "model")
    FI.save_clusters(c, path)
    back = FI.load_clusters(spark, path)
    assert centers_of(back) == centers_of(c)
    assert [r.center_id for r in back.collect()] == sorted(r.center_id for r in c.collect())


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0], [1.0]], [[1.0, 2.0], None], [[1.0, 2.0], []], [[1.0, None]]])
def test_arrow_engine_refuses_ragged_and_null_points(spark, rows):
    points = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id long, features array<double>").coalesce(1)
    centers = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "center_id int, center array<double>")
    with pytest.raises(Exception, match="every point must hold"):
        KM.lloyd_step(points, centers, method="arrow").collect()
