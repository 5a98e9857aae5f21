"""Vector column expressions.

Dense vectors are ``array<double>``; sparse vectors are
``struct<size:int, indices:array<int>, values:array<double>>`` with strictly increasing
0-based indices.  Everything here is a Catalyst expression (higher-order array functions),
so it runs inside the executor JVM with no Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._util import as_col, let

SPARSE_TYPE = "struct<size:int,indices:array<int>,values:array<double>>"


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda a, x: a + x)


def sparse(size, indices, values) -> Column:
    return F.struct(
        as_col(size).cast("int").alias("size"),
        as_col(indices).cast("array<int>").alias("indices"),
        as_col(values).cast("array<double>").alias("values"),
    )


def values_of(v, is_sparse: bool = False) -> Column:
    """The stored values: the whole array (dense) or the active values (sparse)."""
    v = as_col(v)
    return v.getField("values") if is_sparse else v


def norm(v, p: float = 2.0, is_sparse: bool = False) -> Column:
    """p-norm for p >= 1 (``float('inf')`` for the max norm); sparse uses stored values only."""
    if p < 1.0:
        raise ValueError(f"norm requires p >= 1, got {p}")
    vals = values_of(v, is_sparse)
    if p == 1.0:
        return _dsum(F.transform(vals, lambda x: F.abs(x)))
    if p == 2.0:
        return F.sqrt(_dsum(F.transform(vals, lambda x: x * x)))
    if math.isinf(p):
        return F.coalesce(F.array_max(F.transform(vals, lambda x: F.abs(x))), F.lit(0.0))
    return F.pow(_dsum(F.transform(vals, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def _check_same_size(a: Column, b: Column, sa: Column, sb: Column, expr: Column, what: str) -> Column:
    return F.when(sa == sb, expr).otherwise(F.raise_error(F.lit(f"{what}: vector sizes differ")))


def sqdist(a, b) -> Column:
    """Squared Euclidean distance of two dense vectors (exact difference form)."""
    a, b = as_col(a), as_col(b)
    expr = _dsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    return _check_same_size(a, b, F.size(a), F.size(b), expr, "sqdist")


def dot(a, b) -> Column:
    """Dot product of two dense vectors."""
    a, b = as_col(a), as_col(b)
    expr = _dsum(F.zip_with(a, b, lambda x, y: x * y))
    return _check_same_size(a, b, F.size(a), F.size(b), expr, "dot")


def get(v, i: int, is_sparse: bool = False) -> Column:
    """i-th element (0-based); sparse returns 0.0 for inactive positions."""
    v = as_col(v)
    if not is_sparse:
        return F.get(v, F.lit(int(i)))
    pos = F.array_position(v.getField("indices"), F.lit(int(i)))
    return F.when(pos > 0, F.element_at(v.getField("values"), pos.cast("int"))).otherwise(F.lit(0.0))


def to_sparse(v) -> Column:
    """Dense -> sparse, dropping zeros."""
    v = as_col(v)
    n = F.size(v)
    pairs = F.filter(
        F.arrays_zip(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).alias("i"), v.alias("x")),
        lambda p: p["x"] != 0.0,
    )
    return F.struct(
        n.cast("int").alias("size"),
        F.transform(pairs, lambda p: p["i"]).cast("array<int>").alias("indices"),
        F.transform(pairs, lambda p: p["x"]).cast("array<double>").alias("values"),
    )


def sparse_compact(v) -> Column:
    """Sparse -> sparse without explicit zeros (canonical form used for equality)."""
    v = as_col(v)
    pairs = F.filter(F.arrays_zip(v.getField("indices").alias("i"), v.getField("values").alias("x")),
                     lambda p: p["x"] != 0.0)
    return F.struct(
        v.getField("size").alias("size"),
        F.transform(pairs, lambda p: p["i"]).cast("array<int>").alias("indices"),
        F.transform(pairs, lambda p: p["x"]).cast("array<double>").alias("values"),
    )


def to_dense(v) -> Column:
    """Sparse -> dense, filling inactive positions with 0.0."""
    v = as_col(v)
    size = v.getField("size")
    dense = let(F.map_from_arrays(v.getField("indices"), v.getField("values")),
                lambda m: F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
                                      lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0))))
    return F.when(size > 0, dense).otherwise(F.array().cast("array<double>"))


def sparse_nnz(v) -> Column:
    return F.size(F.filter(as_col(v).getField("values"), lambda x: x != 0.0))


def compress(v, is_sparse: bool = False) -> Column:
    """Choose the smaller storage: sparse iff 1.5 * (nnz + 1) < size.  Returns a sparse struct
    plus a ``dense`` array (one of the two is NULL)."""
    v = as_col(v)
    sp = sparse_compact(v) if is_sparse else to_sparse(v)
    size = sp.getField("size")
    nnz = F.size(sp.getField("indices"))
    use_sparse = F.lit(1.5) * (nnz + 1) < size
    dense = to_dense(v) if is_sparse else v
    return F.struct(
        use_sparse.alias("is_sparse"),
        F.when(use_sparse, sp).alias("sparse"),
        F.when(~use_sparse, dense).alias("dense"),
    )


def argmax(v, is_sparse: bool = False) -> Column:
    """Index of the first maximal element; -1 for an empty vector.  For sparse input the
    implicit zeros take part (the first inactive index wins a tie with an explicit 0)."""
    v = as_col(v)
    if not is_sparse:
        n = F.size(v)
        return F.when(n == 0, F.lit(-1)).otherwise(
            (F.array_position(v, F.array_max(v)) - 1).cast("int"))
    size, idx, vals = v.getField("size"), v.getField("indices"), v.getField("values")
    nact = F.size(idx)
    best_val = F.array_max(vals)
    best_active = F.element_at(idx, F.array_position(vals, best_val).cast("int"))
    # first index not stored explicitly (exists iff nact < size); indices ascend
    gaps = F.filter(F.sequence(F.lit(0), F.greatest(nact, F.lit(0))),
                    lambda k: (k == nact) | (F.get(idx, k) != k))
    first_inactive = F.element_at(gaps, 1)
    has_inactive = nact < size
    first_zero_active = F.element_at(F.filter(F.arrays_zip(idx.alias("i"), vals.alias("x")),
                                              lambda p: p["x"] == 0.0), 1)["i"]
    zero_pos = F.when(first_zero_active.isNull(), first_inactive).otherwise(
        F.least(first_zero_active, first_inactive))
    return (
        F.when(size == 0, F.lit(-1))
        .when(nact == 0, F.lit(0))
        .when(~has_inactive, best_active)
        .when(best_val > 0.0, best_active)
        .when(best_val == 0.0, zero_pos)
        .otherwise(first_inactive)
        .cast("int")
    )


def select(v, idxs: list[int]) -> Column:
    """Slice by an index list; result in the requested order and renumbered 0..len-1."""
    v = as_col(v)
    return F.array(*[F.get(v, F.lit(int(i))) for i in idxs]).cast("array<double>") if idxs \
        else F.array().cast("array<double>")


def append_bias(v) -> Column:
    return F.concat(as_col(v), F.array(F.lit(1.0)))


def scale_add(a: float, x, y) -> Column:
    """y + a * x for two dense vector columns of equal size."""
    x, y = as_col(x), as_col(y)
    expr = F.zip_with(x, y, lambda xi, yi: yi + F.lit(float(a)) * xi)
    return _check_same_size(x, y, F.size(x), F.size(y), expr, "scale_add")


def log1p_exp(x) -> Column:
    """Overflow-safe log(1 + exp(x))."""
    x = as_col(x)
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def round_stable(x, places: int = 6) -> Column:
    """Rounding used for cross-engine comparison of floating sums: a tiny offset keeps exact
    half-way ties from rounding differently, and ``+ 0.0`` clears negative zero."""
    return F.round(as_col(x) + F.lit(1.234567e-7), places) + F.lit(0.0)
