"""Data-layout transforms: row numbering, transpose, packed blocks and their inverse.

Layouts
-------
row      (id, features array<double>)
column   (dim, block_id, values array<double>)    one array per dimension and row block
columns  (block_id, n, dim, cols array<array<double>>, norms array<double>)
flat     (block_id, n, dim, flat array<double>)   row-major, element (r, i) at r*dim + i

Every grouped layout is cut into row blocks of at most ``block_rows`` rows, so no group
(and no single array) grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.nearest import matrix_of
from strata.session import cut_lineage

DEFAULT_BLOCK_ROWS = 4096

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index in the upper 31 bits


def row_index(df: DataFrame, order_by: str | list[str], out_col: str = "row") -> DataFrame:
    """Contiguous 0-based row numbers in ``order_by`` order (keys should be unique).

    Range-partitions and sorts within partitions, numbers rows locally, and writes that one
    ordering with its partition number as a column; counts and offsets (one row per partition,
    broadcast) are then taken from the written rows, so both sides of the join see the same
    partitions whatever the planner does.  No global single-partition window is used."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    tagged = ordered.withColumn("_ri_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_ri_part", F.shiftright("_ri_mid", _LOCAL_BITS)).withColumn(
        "_ri_local", F.col("_ri_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
    tagged = cut_lineage(tagged.drop("_ri_mid"))
    counts = tagged.groupBy("_ri_part").agg(F.count("*").alias("_ri_n"))
    # The count table has one row per partition; a single-partition window over it is bounded.
    offsets = counts.select("_ri_part", (F.sum("_ri_n").over(Window.orderBy("_ri_part")) - F.col("_ri_n")).alias("_ri_off"))
    out = tagged.join(F.broadcast(offsets), "_ri_part")
    return out.select(*df.columns, (F.col("_ri_off") + F.col("_ri_local")).alias(out_col))


def zip_columns(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Positional zip of two tables: row k of ``a`` (in ``order_a`` order) with row k of ``b``."""
    ia = row_index(a, order_a, "_row")
    ib = row_index(b, order_b, "_row")
    return ia.join(ib, "_row").drop("_row")


def rows_by_index(points: DataFrame, idx: DataFrame, row_col: str = "row") -> DataFrame:
    """Gather the rows whose row number appears in ``idx`` (semi join keeps each row once)."""
    return points.join(idx.select(row_col), row_col, "left_semi")


def _with_blocks(points: DataFrame, row_col: str, block_rows: int) -> DataFrame:
    if block_rows <= 0:
        raise ValueError("block_rows must be positive")
    return points.withColumn("block_id", F.floor(F.col(row_col) / block_rows).cast("long"))


def _per_block(blocks: DataFrame, build: Callable[[pa.Table], list[pa.Array]], fields: str) -> DataFrame:
    """One call for each ``block_id``; a block's rows reach it once, whole, and bounded by its size."""
    names = [f.strip().split(" ", 1)[0] for f in fields.split(";")]

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_arrays(build(table), names=names)

    return blocks.groupBy("block_id").applyInArrow(run, fields.replace(";", ","))


def _matrix(table: pa.Table, order: str, col: str) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by(order)
    return table, matrix_of(table[col])


def _lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _blocked(points: DataFrame, col: str, row_col: str, block_rows: int) -> DataFrame:
    rows = points.select(F.col(row_col).cast("long").alias("row"), F.col(col).cast("array<double>").alias("x"))
    return _with_blocks(rows, "row", block_rows)


def transpose(points: DataFrame, col: str = "features", row_col: str = "row",
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Row layout -> column layout (dim, block_id, first_row, values), rows in order inside a block.
    Whole rows are shuffled to their block and turned there; rows of different sizes raise."""
    def turn(table: pa.Table) -> list[pa.Array]:
        table, x = _matrix(table, "row", "x")
        dims, first = x.shape[1], table["row"][0].as_py()
        return [pa.array(np.arange(dims), pa.int32()), pa.array([table["block_id"][0].as_py()] * dims, pa.int64()),
                pa.array([first] * dims, pa.int64()), _lists(x.T)]

    return _per_block(_blocked(points, col, row_col, block_rows), turn, "dim int; block_id bigint; first_row bigint; values array<double>")


def untranspose(columns: DataFrame, out_col: str = "features", row_col: str = "row") -> DataFrame:
    """Column layout -> row layout (row, features).  A block whose dimensions differ in length raises."""
    def turn(table: pa.Table) -> list[pa.Array]:
        table, x = _matrix(table, "dim", "values")
        return [pa.array(table["first_row"][0].as_py() + np.arange(x.shape[1])), _lists(x.T)]

    return _per_block(columns.select("block_id", "dim", "first_row", "values"), turn, f"{row_col} bigint; {out_col} array<double>")


def columns_to_flat(columns: DataFrame) -> DataFrame:
    """Column layout -> flat blocks, as ``pack_flat`` makes them, without going through rows."""
    def turn(table: pa.Table) -> list[pa.Array]:
        table, x = _matrix(table, "dim", "values")
        return [pa.array([v], t) for v, t in ((table["block_id"][0].as_py(), pa.int64()), (x.shape[1], pa.int32()), (len(x), pa.int32()), (table["first_row"][0].as_py(), pa.int64()))] + [
            _lists(np.ascontiguousarray(x.T).reshape(1, -1))]

    return _per_block(columns.select("block_id", "dim", "first_row", "values"), turn, _FLAT)


_FLAT = "block_id bigint; n int; dim int; first_row bigint; flat array<double>"


def _head(table: pa.Table, x: np.ndarray) -> list[pa.Array]:
    return [pa.array([v], t) for v, t in ((table["block_id"][0].as_py(), pa.int64()), (x.shape[0], pa.int32()), (x.shape[1], pa.int32()), (table["row"][0].as_py(), pa.int64()))]


def pack_columns(points: DataFrame, col: str = "features", row_col: str = "row",
                 block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Row layout -> blocks of per-dimension arrays plus per-row L2 norms."""
    def turn(table: pa.Table) -> list[pa.Array]:
        table, x = _matrix(table, "row", "x")
        cols = pa.ListArray.from_arrays(pa.array([0, x.shape[1]], pa.int32()), _lists(x.T))
        return [*_head(table, x), cols, _lists(np.sqrt(np.einsum("ij,ij->i", x, x)).reshape(1, -1))]

    return _per_block(_blocked(points, col, row_col, block_rows), turn, _FLAT.replace("flat array<double>", "cols array<array<double>>; norms array<double>"))


def pack_flat(points: DataFrame, col: str = "features", row_col: str = "row",
              block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Row layout -> blocks with one row-major array."""
    def turn(table: pa.Table) -> list[pa.Array]:
        table, x = _matrix(table, "row", "x")
        return [*_head(table, x), _lists(x.reshape(1, -1))]

    return _per_block(_blocked(points, col, row_col, block_rows), turn, _FLAT)


def unpack_blocks(blocks: DataFrame, out_col: str = "features", row_col: str = "row") -> DataFrame:
    """Either packed layout -> row layout (row, features).  Narrow: no shuffle."""
    if "flat" in blocks.columns:
        ex = blocks.select("first_row", "dim", "flat", F.explode(
            F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("k"))
        ex = ex.filter(F.col("k") < F.size("flat") / F.greatest(F.col("dim"), F.lit(1)))
        return ex.select((F.col("first_row") + F.col("k")).alias(row_col),
                         F.slice("flat", F.col("k") * F.col("dim") + 1, F.col("dim")).alias(out_col))
    ex = blocks.select("first_row", "dim", "cols", F.explode(
        F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("k"))
    return ex.select((F.col("first_row") + F.col("k")).alias(row_col),
                     F.transform("cols", lambda c: F.get(c, F.col("k"))).alias(out_col))


def sort_edges(edges: DataFrame, global_order: bool = True) -> DataFrame:
    """Lexicographic (src, dst).  ``global_order=False`` sorts inside the existing partitions
    (the per-partition sorted edge layout) without a range shuffle."""
    return edges.orderBy("src", "dst") if global_order else edges.sortWithinPartitions("src", "dst")
