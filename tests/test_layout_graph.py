import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strata import catalog as C
from strata.operators import graph as G
from strata.operators import layout as L
from strata.plans import graph as GP


def test_row_index_contiguous(spark, sf):
    r = L.row_index(C.points(spark, sf).select("id"), "id", "row")
    rows = sorted((x.id, x.row) for x in r.collect())
    assert [x[1] for x in rows] == list(range(len(rows)))


def test_pack_unpack_round_trip(spark, sf):
    rows = L.row_index(C.points(spark, sf), "id", "row")
    orig = {r.row: r.features for r in rows.select("row", "features").collect()}
    for packed in (L.pack_flat(rows, block_rows=37), L.pack_columns(rows, block_rows=37)):
        back = {r.row: r.features for r in L.unpack_blocks(packed).collect()}
        assert back == orig
    twice = {r.row: r.features for r in L.untranspose(L.transpose(rows, block_rows=50)).collect()}
    assert twice == orig


def small_graph(spark):
    return spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (2, 3), (4, 4)], "src long, dst long")


def test_bfs_small_and_absent_root(spark):
    e = small_graph(spark)
    d = {r.id: r.dist for r in GP.bfs(e, 0).collect()}
    assert d == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: math.inf}
    assert all(math.isinf(r.dist) for r in GP.bfs(e, 99).collect())
    assert {r.id: r.dist for r in GP.bfs_pregel(e, 0).collect()} == d


def test_pagerank_matches_reference_formula(spark):
    e = small_graph(spark)
    got = {r.id: r.rank for r in GP.static_pagerank(e, 3).collect()}
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (2, 3), (4, 4)]
    verts = {v for ed in edges for v in ed}
    outdeg = {v: sum(1 for s, _ in edges if s == v) for v in verts}
    rank = {v: 1.0 for v in verts}
    for _ in range(3):
        s = {v: 0.0 for v in verts}
        for a, b in edges:
            s[b] += rank[a] / outdeg[a]
        rank = {v: 0.15 + 0.85 * s[v] for v in verts}
    for v in verts:
        assert abs(got[v] - rank[v]) < 1e-12


def test_hot_source_is_salted(spark):
    rows = [(0, i) for i in range(400)] + [(i, i + 1) for i in range(1, 50)]
    e = spark.createDataFrame(rows, "src long, dst long")
    salted, hot = GP.prepare_edges(e, partitions=4)
    h = hot.collect()
    assert len(h) == 1 and h[0]._hot_key == 0 and h[0].n_salt > 1
    got = {r.id: r.rank for r in GP.static_pagerank(e, 3, partitions=4).collect()}
    verts = {v for ed in rows for v in ed}
    outdeg = {v: sum(1 for s, _ in rows if s == v) for v in verts}
    rank = {v: 1.0 for v in verts}
    for _ in range(3):
        acc = {v: 0.0 for v in verts}
        for a, b in rows:
            acc[b] += rank[a] / outdeg[a]
        rank = {v: 0.15 + 0.85 * acc[v] for v in verts}
    assert got.keys() == rank.keys()
    assert max(abs(got[v] - rank[v]) for v in verts) < 1e-12
    d = {r.id: r.dist for r in GP.bfs(e, 0, partitions=4).collect()}
    assert d[0] == 0.0 and d[1] == 1.0 and d[50] == 1.0 and d[399] == 1.0


def test_adjacency_offsets(spark):
    a = G.adjacency(small_graph(spark)).orderBy("src").collect()
    assert [(r.src, r.dsts, r.degree, r.offset) for r in a] == [
        (0, [1], 1, 0), (1, [2], 1, 1), (2, [0, 3, 3], 3, 2), (4, [4], 1, 5)]


def test_adjacency_chunks_hot_source(spark):
    rows = [(0, i) for i in range(100)] + [(1, 2)]
    a = G.adjacency(spark.createDataFrame(rows, "src long, dst long"), max_chunk=30)
    hot = a.filter("src = 0").collect()
    assert [r.degree for r in sorted(hot, key=lambda r: r.chunk)] == [30, 30, 30, 10]


def test_matvec_checks_shapes_and_keeps_rows_of_y(spark):
    from strata.operators import linalg as LA

    a = spark.createDataFrame([(0, 0, 2.0), (1, 5, 1.0)], "i long, j long, v double")
    x = spark.createDataFrame([(0, 3.0)], "i long, v double")
    y = spark.createDataFrame([(0, 1.0), (4, float("nan"))], "i long, v double")
    with pytest.raises(ValueError):
        LA.matvec(a, x, n_cols=2)
    with pytest.raises(ValueError):
        LA.matvec(a, x, n_rows=1)
    assert sorted(map(tuple, LA.matvec(a, x, y=y, beta=0.0).collect())) == [(0, 6.0), (4, 0.0)]


def test_blocks_keep_order_and_refuse_ragged_rows(spark):
    df = spark.createDataFrame([(r, [float(r), -float(r)]) for r in (9, 3, 0, 1, 7, 2, 8)], "row long, features array<double>").repartition(4)
    t = sorted((r.block_id, r.dim, r.first_row, r["values"]) for r in L.transpose(df, block_rows=4).collect())
    assert t == [(0, 0, 0, [0.0, 1.0, 2.0, 3.0]), (0, 1, 0, [-0.0, -1.0, -2.0, -3.0]), (1, 0, 7, [7.0]), (1, 1, 7, [-7.0]), (2, 0, 8, [8.0, 9.0]), (2, 1, 8, [-8.0, -9.0])]
    assert sorted(map(tuple, L.columns_to_flat(L.transpose(df, block_rows=4)).collect())) == sorted(map(tuple, L.pack_flat(df, block_rows=4).collect()))
    for op in (L.transpose, L.pack_flat, L.pack_columns):
        assert op(df.limit(0)).count() == 0
        with pytest.raises(Exception, match="differ in size"):
            op(df.unionByName(spark.createDataFrame([(4, [1.0])], "row long, features array<double>"))).collect()
