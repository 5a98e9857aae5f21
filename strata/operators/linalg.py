"""Distances, nearest centers and table-shaped matrix algebra.

Matrices are coordinate tables ``(i bigint, j bigint, v double)``; vectors are
``(i bigint, v double)``.  Products are an equi-join on the inner index (of blocks for two
matrices) followed by an aggregate whose partial sums are formed before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.functions.nearest import Centers, matrix_of, nearest_column
from strata.functions.pairs import is_dense, pair_column
from strata.operators import skew
from strata.session import cut_lineage

def _paired(a: DataFrame, b: DataFrame, on: str, a_col: str, b_col: str) -> DataFrame:
    return a.select(on, F.col(a_col).alias("_a")).join(b.select(on, F.col(b_col).alias("_b")), on)


def pairwise_sqdist(a: DataFrame, b: DataFrame, on: str, a_col: str = "features",
                    b_col: str = "features") -> DataFrame:
    """Squared distance between matched rows of two tables (equi-join on ``on``).  Either column may be
    dense (array<double>) or sparse (struct<size,indices,values>); different sizes raise."""
    j = _paired(a, b, on, a_col, b_col)
    if is_dense(j, "_a") and is_dense(j, "_b"):
        return j.select(on, V.sqdist("_a", "_b").alias("sqdist"))
    return j.select(on, pair_column(j, "_a", "_b", "sqdist").alias("sqdist"))


def pairwise_dot(a: DataFrame, b: DataFrame, on: str, a_col: str = "features",
                 b_col: str = "features") -> DataFrame:
    """Dot product of matched rows, dense and sparse in any mix; different sizes raise."""
    j = _paired(a, b, on, a_col, b_col)
    if is_dense(j, "_a") and is_dense(j, "_b"):
        return j.select(on, V.dot("_a", "_b").alias("dot"))
    return j.select(on, pair_column(j, "_a", "_b", "dot").alias("dot"))


def pairwise_sqdist_from_norms(a: DataFrame, b: DataFrame, on: str, a_col: str = "features", b_col: str = "features",
                               precision: float = 1e-6) -> DataFrame:
    """``pairwise_sqdist`` from norms and one dot product, |a|^2 + |b|^2 - 2 ab, where that keeps the
    relative error below ``precision``; pairs for which it might not are taken from the
    differences."""
    if precision <= 0:
        raise ValueError("precision must be positive")
    j = _paired(a, b, on, a_col, b_col)
    return j.select(on, pair_column(j, "_a", "_b", "guarded", precision).alias("sqdist"))


def sparse_dot(a_long: DataFrame, b_long: DataFrame, key: str, idx_col: str = "idx",
               value_col: str = "value") -> DataFrame:
    """Dot products of sparse vectors in long form (key, idx, value): join on (key, idx), sum."""
    j = a_long.select(key, idx_col, F.col(value_col).alias("_x")).join(
        b_long.select(key, idx_col, F.col(value_col).alias("_y")), [key, idx_col])
    return j.groupBy(key).agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))


def nearest_center(points: DataFrame, centers: DataFrame, col: str = "features",
                   center_id: str = "center_id", center_col: str = "center") -> DataFrame:
    """Adds ``cluster`` (nearest center id, lowest id on ties) and ``sqdist``.

    The centers are one matrix, k x dim doubles, broadcast to the executors; points stay where they
    are and go through Arrow batches, whatever k is."""
    model = Centers.collect(centers, center_id, center_col)
    return points.withColumn("_nc", nearest_column(points, col, model)).select(*points.columns, "_nc.cluster", "_nc.sqdist")


def gram_matrix(df: DataFrame, col: str = "features", alpha: float = 1.0, upper_only: bool = False) -> DataFrame:
    """sum over rows of alpha * x x^T as a coordinate table (i, j, v).

    Each task adds its Arrow batches up as one matrix product and hands on the upper triangle, so
    the exchange carries dim (dim + 1) / 2 rows a task, however many rows there are; the lower
    triangle is a copy made after the sum.  Rows of different sizes, null rows and null values
    raise; an empty table gives no entries."""
    def add_up(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), None if total is None else len(total))
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    parts = df.select(F.col(col).cast("array<double>").alias("x")).mapInArrow(add_up, "i bigint, j bigint, v double")
    upper = parts.groupBy("i", "j").agg((F.lit(float(alpha)) * F.sum("v")).alias("v"))
    if upper_only:
        return upper
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return upper.select(F.inline(both), "v")


def _check_shapes(*wanted: tuple[DataFrame, str, int | None, str]) -> None:
    """One job over the index columns of all operands; raises for the first that leaves its range."""
    parts = [df.select(F.lit(at).alias("at"), F.col(col).alias("k"), F.lit(n).alias("n")) for at, (df, col, n, _) in enumerate(wanted) if n is not None]
    if not parts:
        return
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    bad = rows.filter((F.col("k") < 0) | (F.col("k") >= F.col("n"))).agg(F.min("at")).first()[0]
    if bad is not None:
        _, _, n, what = wanted[bad]
        raise ValueError(f"{what}: index out of range for dimension {n}")


def matvec(a: DataFrame, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None,
           n_rows: int | None = None, n_cols: int | None = None, threshold: int | None = None) -> DataFrame:
    """alpha * A x + beta * y  ->  (i, v).  A (i, j, v); x (i, v) indexed by column j; y (i, v).

    ``n_rows`` and ``n_cols`` check the indices of A, x and y.  Every row of ``y`` is in the result;
    with ``beta`` 0 its values (NaN too) count as zero.  The entries of a long column of A are
    dealt over several tasks (``skew.salt_hot``, ``threshold`` entries each)."""
    _check_shapes((x, "i", n_cols, "x"), (a, "j", n_cols, "A's columns"), (a, "i", n_rows, "A's rows"),
                  *([(y, "i", n_rows, "y")] if y is not None else []))
    dealt, hot = skew.salt_hot(a.select("i", "j", "v"), "j", "i", threshold=threshold)
    ax = (skew.join_hot(dealt, "j", x.select(F.col("i").alias("j"), F.col("v").alias("_x")), hot)
          .groupBy("i").agg((F.lit(float(alpha)) * F.sum(F.col("v") * F.col("_x"))).alias("_ax")))
    if y is None:
        return ax.select("i", F.col("_ax").alias("v"))
    yy = y.select("i", (F.lit(float(beta)) * F.col("v") if beta else F.lit(0.0)).alias("_by"))
    out = ax.join(yy, "i", "full_outer")
    return out.select("i", (F.coalesce("_ax", F.lit(0.0)) + F.coalesce("_by", F.lit(0.0))).alias("v"))


#: Rows and columns of a matrix block: a dense block is half a megabyte.
BLOCK = 256


def _blocks(m: DataFrame, outer: str, inner: str, name: str) -> DataFrame:
    """Non-empty blocks as rows: (``<name>b``, kb, ``<name>``: arrays of places inside the block and
    values).  A block has BLOCK x BLOCK places; entries of one place are added up first, so its row is
    bounded."""
    at = m.groupBy(F.col(outer).alias("o"), F.col(inner).alias("k")).agg(F.sum("v").alias("v"))
    place = F.struct((F.pmod("o", F.lit(BLOCK)) * BLOCK + F.pmod("k", F.lit(BLOCK))).cast("int").alias("p"), F.col("v").alias("v"))
    b = at.groupBy(F.floor(F.col("o") / BLOCK).alias(f"{name}b"), F.floor(F.col("k") / BLOCK).alias("kb")).agg(F.collect_list(place).alias("_e"))
    return b.select(f"{name}b", "kb", F.col("_e.p").alias(f"{name}p"), F.col("_e.v").alias(f"{name}v"))


def _multiply(batches):
    """Partial products of block pairs: one matrix product each, and one of the filled places, which
    says what entries the result has (a sum of zero is an entry too)."""
    for batch in batches:
        for r in range(batch.num_rows):
            ib, jb, ip, iv, jp, jv = (batch.column(c)[r] for c in range(6))
            left, right = np.zeros((BLOCK, BLOCK)), np.zeros((BLOCK, BLOCK))
            has_left, has_right = np.zeros((BLOCK, BLOCK), np.float32), np.zeros((BLOCK, BLOCK), np.float32)
            ip, jp = ip.values.to_numpy(), jp.values.to_numpy()
            left.ravel()[ip], has_left.ravel()[ip] = iv.values.to_numpy(), 1
            right.ravel()[jp], has_right.ravel()[jp] = jv.values.to_numpy(), 1
            i, j = np.nonzero(has_left @ has_right.T)
            yield pa.RecordBatch.from_arrays([pa.array(ib.as_py() * BLOCK + i), pa.array(jb.as_py() * BLOCK + j), pa.array((left @ right.T)[i, j])], names=["i", "j", "v"])


def matmul(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None,
           shape: tuple[int, int, int] | None = None, threshold: int | None = 4096) -> DataFrame:
    """alpha * A B + beta * C -> (i, j, v).  Every entry of ``c`` is in the result; with ``beta`` 0 its
    values count as zero.

    ``shape`` (rows of A, inner size, columns of B) checks the indices of all operands; without it
    an inner index that only one side has adds nothing.

    Coordinates are gathered into blocks of BLOCK x BLOCK places; blocks meet on the inner block
    index, are multiplied in NumPy and the partial products added up by (i, j), in each task first.
    The blocks of an inner index with more than ``threshold`` of them are dealt over several
    tasks, each with the other side's blocks of that index.  Values that are not finite spread over
    their block's row or column, as in any dense product."""
    if shape is not None:
        n, k, m = shape
        _check_shapes((a, "i", n, "A's rows"), (a, "j", k, "A's columns"), (b, "i", k, "B's rows"), (b, "j", m, "B's columns"),
                      *([(c, "i", n, "C's rows"), (c, "j", m, "C's columns")] if c is not None else []))
    left, hot = skew.salt_hot(cut_lineage(_blocks(a, "i", "j", "i")), "kb", "ib", threshold=threshold)
    pairs = skew.join_hot(left, "kb", cut_lineage(_blocks(b, "j", "i", "j")), hot).select("ib", "jb", "ip", "iv", "jp", "jv")
    ab = (pairs.mapInArrow(_multiply, "i bigint, j bigint, v double").groupBy("i", "j")
          .agg((F.lit(float(alpha)) * F.sum("v")).alias("_ab")))
    if c is None:
        return ab.select("i", "j", F.col("_ab").alias("v"))
    cc = c.select("i", "j", (F.lit(float(beta)) * F.col("v") if beta else F.lit(0.0)).alias("_c"))
    out = ab.join(cc, ["i", "j"], "full_outer")
    return out.select("i", "j", (F.coalesce("_ab", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))).alias("v"))


def matrix_add(x: DataFrame, y: DataFrame, a: float = 1.0) -> DataFrame:
    """y + a * x for coordinate matrices -> (i, j, v)."""
    parts = x.select("i", "j", (F.lit(float(a)) * F.col("v")).alias("v")).unionByName(y.select("i", "j", "v"))
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose_coo(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
