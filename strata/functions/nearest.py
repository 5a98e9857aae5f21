"""Nearest centers of a batch of points: the numpy kernel behind assignment, cost and Lloyd steps.

A model of k centers is one matrix, sorted by norm and cut into tiles.  Points are taken in tiles
of similar norm too; the centers nearest in norm come first, and since |x - c| >= ||x| - |c||, all
tiles beyond the worst distance found so far are skipped.  Inside a pair of tiles one matrix
product gives every distance up to rounding; those that rounding could make the smallest are
computed again from the differences, so results and ties (lowest center id) are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 1024
_EPS = np.finfo(np.float64).eps


def matrix_of(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Lists of doubles as rows of a matrix; a row may hold several points of ``dim`` values one after
    the other.  Null rows, null values and other sizes raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    if dim is None:
        dim = int(sizes[0]) if len(sizes) else 0
        if (sizes != dim).any():
            raise ValueError("vectors differ in size")
    if column.null_count or values.null_count or (dim and ((sizes % dim).any() or not sizes.all())):
        raise ValueError(f"every point must hold {dim} values, none of them null")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, max(dim, 1) if len(values) else dim)


@dataclass
class Centers:
    """Center ids in ascending order and their vectors, one row each."""

    ids: np.ndarray
    rows: np.ndarray

    @staticmethod
    def collect(centers: DataFrame, id_col: str = "center_id", col: str = "center") -> Centers:
        """The model as one matrix: k x dim doubles, the size of the result that every fit returns."""
        got = centers.select(F.col(id_col).cast("long").alias("i"), F.col(col).cast("array<double>").alias("c")).toArrow()
        if not got.num_rows:
            raise ValueError("no centers")
        ids = got["i"].to_numpy()
        if len(np.unique(ids)) != len(ids):
            raise ValueError("center ids must be unique")
        order = np.argsort(ids)
        return Centers(ids[order], matrix_of(got["c"])[order])

    def __post_init__(self) -> None:
        square = np.einsum("ij,ij->i", self.rows, self.rows)
        order = np.argsort(square, kind="stable")
        self._tiles = []
        for a in range(0, len(order), TILE):
            at = order[a:a + TILE]
            self._tiles.append((self.rows[at], square[at], self.ids[at]))
        self._low = np.sqrt([t[1][0] for t in self._tiles])
        self._high = np.sqrt([t[1][-1] for t in self._tiles])

    @property
    def dim(self) -> int:
        return self.rows.shape[1]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id of each row's nearest center (ties: lowest id) and its squared distance.  A row with a
        value that is not finite has the lowest id and no number as distance."""
        if x.shape[1] != self.dim:
            raise ValueError(f"points have {x.shape[1]} values, centers {self.dim}")
        label, best = np.full(len(x), self.ids[0]), np.full(len(x), np.nan)
        square = np.einsum("ij,ij->i", x, x)
        finite = np.flatnonzero(np.isfinite(square))
        order = finite[np.argsort(square[finite], kind="stable")]
        for a in range(0, len(order), TILE):
            rows = order[a:a + TILE]
            label[rows], best[rows] = self._tile(x[rows], square[rows])
        return label, best

    def _tile(self, p: np.ndarray, pn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, label = np.full(len(p), np.inf), np.full(len(p), np.iinfo(np.int64).max)
        low, high = np.sqrt(pn[0]), np.sqrt(pn[-1])
        gap = np.maximum(0, np.maximum(self._low - high, low - self._high))
        for t in np.argsort(gap, kind="stable"):
            if gap[t] ** 2 * (1 - 1e-9) > d.max():
                break
            c, cn, ids = self._tiles[t]
            about = pn[:, None] + cn[None, :] - 2.0 * (p @ c.T)
            slack = 8 * (self.dim + 4) * _EPS * (pn + cn[-1])
            row, col = np.nonzero(about <= (np.minimum(d, about.min(axis=1)) + slack)[:, None])
            for s in range(0, len(row), 1 << 16):
                r, k = row[s:s + (1 << 16)], col[s:s + (1 << 16)]
                diff = p[r] - c[k]
                exact, at = np.einsum("ij,ij->i", diff, diff), ids[k]
                by = np.lexsort((at, exact, r))
                by = by[np.r_[True, np.diff(r[by]) != 0]]
                r, exact, at = r[by], exact[by], at[by]
                better = (exact < d[r]) | ((exact == d[r]) & (at < label[r]))
                d[r[better]], label[r[better]] = exact[better], at[better]
        return label, d

    def partials(self, x: np.ndarray) -> np.ndarray:
        """k x (dim + 2): sums of the points nearest to each center, their number and their cost."""
        label, d = self.nearest(x)
        at = np.searchsorted(self.ids, label)
        out = np.zeros((len(self.ids), self.dim + 2))
        if len(x):
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            present = at[order][first]
            out[present, :-2] = np.add.reduceat(x[order], first, axis=0)
            out[:, -2] = np.bincount(at, minlength=len(out))
            out[:, -1] = np.bincount(at, weights=d, minlength=len(out))
        return out


def nearest_column(df: DataFrame, col: str | Column, centers: Centers) -> Column:
    """struct(cluster, sqdist) of each row's nearest center: a narrow Arrow map, the same plan for any
    number of centers.  The matrix is broadcast once to each executor."""
    shared = df.sparkSession.sparkContext.broadcast((centers.ids, centers.rows))
    state: dict[str, Centers] = {}

    def assign(batch: pa.Array) -> pa.Array:
        if "model" not in state:
            state["model"] = Centers(*shared.value)
        model = state["model"]
        label, d = model.nearest(matrix_of(batch, model.dim)) if len(batch) else (np.zeros(0, np.int64), np.zeros(0))
        if len(label) != len(batch):
            raise ValueError(f"every point must hold {model.dim} values")
        return pa.StructArray.from_arrays([pa.array(label.astype(np.int32)), pa.array(d)], names=["cluster", "sqdist"])

    assign.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(assign, "struct<cluster:int,sqdist:double>")(F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>"))
