"""Distances and dot products of two vector columns, dense and sparse in any mix.

A batch of rows becomes two flat lists of (row, index) keys, both ascending because sparse
indices are; one binary search of one list in the other is the merge of all rows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = float(np.finfo(np.float64).eps)


def is_dense(df: DataFrame, col: str) -> bool:
    kind = df.schema[col].dataType
    if isinstance(kind, T.ArrayType):
        return True
    if isinstance(kind, T.StructType) and {"size", "indices", "values"} <= set(kind.names):
        return False
    raise ValueError(f"{col} is no vector column: {kind.simpleString()}")


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    offsets = col.offsets.to_numpy().astype(np.int64)
    return np.diff(offsets), col.flatten()


def _parts(col: pa.Array, dense: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the vectors, the row and index of each stored value, and the values."""
    if col.null_count:
        raise ValueError("vectors must not be null")
    counts, values = _lists(col if dense else pc.struct_field(col, "values"))
    if values.null_count:
        raise ValueError("vector values must not be null")
    row = np.repeat(np.arange(len(counts)), counts)
    if dense:
        sizes, index = counts, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    else:
        sizes = pc.struct_field(col, "size").to_numpy(zero_copy_only=False).astype(np.int64)
        n, index = _lists(pc.struct_field(col, "indices"))
        if index.null_count or (n != counts).any():
            raise ValueError("a sparse vector needs as many indices as values")
        index = index.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.ones(len(index), bool)
        inside[1:] = (index[1:] > index[:-1]) | (row[1:] != row[:-1])
        if not (inside & (index >= 0) & (index < sizes[row])).all():
            raise ValueError("sparse indices must ascend and lie inside the vector")
    return sizes, row, index, values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def pair_values(a: pa.Array, b: pa.Array, a_dense: bool, b_dense: bool, what: str, precision: float = 1e-6) -> np.ndarray:
    """One number a row: ``dot``, ``sqdist`` (from differences), or ``guarded`` (from norms and dot
    where that is precise enough, else from differences)."""
    n = len(a)
    size_a, row_a, at_a, x = _parts(a, a_dense)
    size_b, row_b, at_b, y = _parts(b, b_dense)
    if (size_a != size_b).any():
        raise ValueError("vector sizes differ")
    width = int(size_a.max(initial=0)) + 1
    key_a, key_b = row_a * width + at_a, row_b * width + at_b
    found = np.searchsorted(key_b, key_a)
    both = found < len(key_b)
    both[both] = key_b[found[both]] == key_a[both]
    mate = found[both]
    dot = np.bincount(row_a[both], x[both] * y[mate], n) if what != "sqdist" else None
    if what == "dot":
        return dot
    alone = np.ones(len(key_b), bool)
    alone[mate] = False
    exact = (np.bincount(row_a[both], (x[both] - y[mate]) ** 2, n) + np.bincount(row_a[~both], x[~both] ** 2, n)
             + np.bincount(row_b[alone], y[alone] ** 2, n))
    if what == "sqdist":
        return exact
    norm_a, norm_b = np.sqrt(np.bincount(row_a, x * x, n)), np.sqrt(np.bincount(row_b, y * y, n))
    squares = norm_a ** 2 + norm_b ** 2
    short = squares - 2.0 * dot
    sure = 2.0 * EPSILON * squares / ((norm_a - norm_b) ** 2 + EPSILON) < precision
    if a_dense and b_dense:
        return np.where(sure, short, exact)
    short_of_zero = np.maximum(short, 0.0)
    fair = EPSILON + 2.0 * np.abs(dot) * EPSILON / (short_of_zero + EPSILON) <= precision
    return np.where(sure, short, np.where(fair, short_of_zero, exact))


def pair_column(df: DataFrame, a: str, b: str, what: str, precision: float = 1e-6) -> Column:
    """``pair_values`` of two vector columns as a narrow Arrow expression."""
    a_dense, b_dense = is_dense(df, a), is_dense(df, b)

    def values(left, right):
        return pa.array(pair_values(left, right, a_dense, b_dense, what, precision), pa.float64())

    values.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(values, "double")(F.col(a), F.col(b))
