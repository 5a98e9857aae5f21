"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (random signs and a fast Hadamard transform, three
times) and hashed to the nearest signed axis; a query looks into the buckets of its nearest few
axes in every table, and what it finds is ranked by the exact distance of the original vectors.
Vectors of one table meet queries in ``(table, bucket, salt)`` groups: large buckets are split, so
no group grows with the data.  Equal vectors are one class that keeps the few smallest ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import staged

TABLES, HASHES, PROBES = 10, 1, 9
#: Vectors of a bucket that one group holds at most, on average.
GROUP_ROWS = 20_000
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.sqrt(n)


def axis_scores(x: np.ndarray, table: int, part: int, seed: int = SEED) -> np.ndarray:
    """How near each row is to each of the 2n signed axes after the rotation of (table, part)."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, :x.shape[1]] = x
    rng = np.random.default_rng([seed, table, part, width])
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width))
    return np.concatenate([y, -y], axis=1)


def buckets(x: np.ndarray, table: int, probes: int, hashes: int = HASHES) -> np.ndarray:
    """Bucket numbers (rows x probes**hashes) of unit rows, the nearest axes first."""
    tops, axes = [], 0
    for part in range(hashes):
        z = axis_scores(x, table, part)
        axes, p = z.shape[1], min(probes, z.shape[1])
        tops.append(np.argsort(-z, axis=1, kind="stable")[:, :p])
    out = []
    for pick in itertools.product(*(range(t.shape[1]) for t in tops)):
        b = np.zeros(len(x), np.int64)
        for t, i in zip(tops, pick, strict=True):
            b = b * axes + t[:, i]
        out.append(b)
    return np.stack(out, axis=1)


def usable(vec: Column) -> Column:
    """Not null, not empty, not all zero, and every component a finite number."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one row ``(cls, ids, vec, dim, shell)``: ``cls`` is the smallest id, ``ids``
    the ``keep`` smallest.  Ids are cut per salt first, so a vector that fills the table is never
    gathered in one task."""
    salts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = vectors.withColumn("_s", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    first = F.row_number().over(Window.partitionBy("vec", "_s").orderBy("vec_id"))
    few = salted.withColumn("_r", first).filter(F.col("_r") <= keep)
    again = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = few.withColumn("_r", again).filter(F.col("_r") <= keep)
    # the largest component is taken out before squaring, so no norm overflows or vanishes
    top = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    rest = F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v / F.col("top")) * (v / F.col("top")))
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("top", top).select(
        F.col("ids")[0].alias("cls"), "ids", "vec", F.size("vec").alias("dim"), F.round(F.log2("top") + F.log2(rest) / 2).cast("int").alias("shell"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hashed(rows: DataFrame, tables: int, probes: int, hashes: int) -> DataFrame:
    """``(dim, shell, tab, bucket, cls, vec)``: each row once for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = np.asarray(whole.column("dim"))
            for dim in np.unique(dims):
                mine = whole.take(pa.array(np.flatnonzero(dims == dim)))
                for lo in range(0, mine.num_rows, 2000):
                    b = mine.slice(lo, 2000)
                    x = _matrix(b.column("vec"))
                    x = x / np.abs(x).max(1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for t in range(tables):
                        at = buckets(x, t, probes, hashes)
                        row = pa.array(np.repeat(np.arange(len(x)), at.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [b.column("dim").take(row), b.column("shell").take(row), pa.array(np.full(at.size, t), pa.int32()), pa.array(at.ravel()),
                             b.column("cls").take(row), b.column("vec").take(row)], names=["dim", "shell", "tab", "bucket", "cls", "vec"])

    return rows.select("dim", "shell", "cls", "vec").mapInArrow(run, "dim int, shell int, tab int, bucket bigint, cls bigint, vec array<double>")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; where squares would overflow or vanish, with the largest
    difference taken out first."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = a - b
        out = np.sqrt((diff ** 2).sum(1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
        if len(odd):
            top = np.abs(diff[odd]).max(1, initial=0.0)
            part = diff[odd] / np.where(top > 0, top, 1.0)[:, None]
            out[odd] = np.where(np.isfinite(top), top * np.sqrt((part ** 2).sum(1)), np.inf)
    return out


def nearest_in_group(data: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of queries: query row, id, distance of the ``k`` nearest, ties to smaller ids."""
    scale = max(np.abs(data).max(initial=0.0), np.abs(query).max(initial=0.0)) or 1.0
    small = data / scale  # only to find the nearest; distances are taken from the vectors themselves
    sq = (small * small).sum(1)
    for lo in range(0, len(query), 128):
        q = query[lo:lo + 128] / scale
        rough = (q * q).sum(1)[:, None] + sq - 2 * q @ small.T
        if len(ids) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            near = rough <= (kth + 1e-9 * ((q * q).sum(1) + sq.max() + kth))[:, None]
        else:
            near = np.ones(rough.shape, bool)
        r, c = np.nonzero(near)
        d = distances(query[lo + r], data[c])
        o = np.lexsort([ids[c], d, r])
        r, c, d = r[o], c[o], d[o]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        top = place < k
        yield r[top] + lo, ids[c[top]], d[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query row, nearest
    first, ties to the smaller id; the row with the query's own id is left out.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components take no
    part; repeated (id, vector) rows count once; vectors of other lengths never meet.  Every row is
    indexed.  Directions are hashed within shells of norms a factor two wide, and a query looks
    into every shell, so lengths other than one are found as well.  A query that has not found ``k``
    rows this way is compared with every row, so it has ``k`` neighbours, or all there are."""

    def clean(df):
        vec = F.col(vec_col)
        return df.filter(F.col(id_col).isNotNull() & usable(vec)).select(F.col(id_col).cast("long").alias("vec_id"), vec.cast("array<double>").alias("vec")).distinct()

    cls = staged(classes(clean(vectors), k + 1))
    asked = clean(queries)
    known = staged(asked.join(cls.select("vec", "cls"), "vec", "left").select("vec_id", "vec", F.coalesce("cls", -F.col("vec_id") - 1).alias("qcls")))
    one = known.groupBy("vec").agg(F.min("qcls").alias("cls")).withColumn("dim", F.size("vec"))
    shells = cls.select("dim", "shell").distinct()  # norms are doubles: at most some 2,100 shells a length
    data = staged(hashed(cls, tables, 1, hashes))
    spots = ["dim", "shell", "tab", "bucket"]
    salts = staged(data.groupBy(*spots).count().select(*spots, F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("salts")))
    left = data.join(salts, spots).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).drop("salts")
    probed = hashed(one.withColumn("shell", F.lit(0)), tables, probes, hashes).drop("shell").join(F.broadcast(shells), "dim")
    right = probed.join(salts.toDF(*salts.columns), spots).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spots = [*spots, "salt"]

    def meet(got: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = []
        if got.num_rows and wanted.num_rows:
            qid = np.asarray(wanted.column("cls"))
            for r, c, d in nearest_in_group(_matrix(got.column("vec")), np.asarray(got.column("cls")), _matrix(wanted.column("vec")), k + 1):
                parts.append(pa.table({"qcls": qid[r], "cls": c, "score": d}))
        return pa.concat_tables(parts) if parts else pa.table({"qcls": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    fields = "qcls bigint, cls bigint, score double"
    found = left.groupBy(*spots).cogroup(right.groupBy(*spots)).applyInArrow(meet, fields)
    found = staged(found.groupBy("qcls", "cls").agg(F.min("score").alias("score")))
    # A query whose buckets hold too few rows looks into every bucket of one table.
    size = found.join(cls.select("cls", F.size("ids").alias("n")), "cls").groupBy("qcls").agg(F.sum("n").alias("n")).filter(F.col("n") > k)
    short = staged(one.join(size, one["cls"] == size["qcls"], "left_anti").select("cls", "vec", "dim"))
    if not short.isEmpty():
        every = short.join(salts.filter("tab = 0"), "dim").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        rest = left.filter("tab = 0").groupBy(*spots).cogroup(every.groupBy(*spots)).applyInArrow(meet, fields)
        found = found.unionByName(rest).groupBy("qcls", "cls").agg(F.min("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("qcls").orderBy("score", "cls"))
    found = found.withColumn("_r", best).filter(F.col("_r") <= k + 1).drop("_r")
    near = found.join(cls.select("cls", "ids"), "cls").select("qcls", "score", F.explode("ids").alias("vec_id"))
    own = known.select(F.col("vec_id").alias("query_id"), "qcls")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (own.join(near, "qcls").filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank)
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
