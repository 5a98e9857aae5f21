"""Vector DataFrame operators (row-wise; the per-row work is in ``strata.functions.vectors``)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import vectors as V


def vector_norm(df: DataFrame, col: str = "features", p: float = 2.0, is_sparse: bool = False,
                out_col: str = "norm") -> DataFrame:
    if p < 1.0:
        raise ValueError(f"norm requires p >= 1, got {p}")
    return df.withColumn(out_col, V.norm(col, p, is_sparse))


def vector_profile(df: DataFrame, col: str = "features", is_sparse: bool = False) -> DataFrame:
    """Adds size, n_active (stored entries), nnz (non-zero entries) and argmax."""
    c = F.col(col)
    if is_sparse:
        size, n_active = c.getField("size"), F.size(c.getField("indices"))
        nnz = V.sparse_nnz(c)
    else:
        size = n_active = F.size(c)
        nnz = F.size(F.filter(c, lambda x: x != 0.0))
    return df.select("*", size.alias("size"), n_active.alias("n_active"), nnz.alias("nnz"),
                     V.argmax(c, is_sparse).alias("argmax"))


def vector_get(df: DataFrame, i: int, col: str = "features", is_sparse: bool = False,
               out_col: str = "value") -> DataFrame:
    return df.withColumn(out_col, V.get(col, i, is_sparse))


def to_sparse(df: DataFrame, col: str = "features", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, V.to_sparse(col))


def to_dense(df: DataFrame, col: str = "features", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, V.to_dense(col))


def compress_vectors(df: DataFrame, col: str = "features", is_sparse: bool = False,
                     out_col: str = "compressed") -> DataFrame:
    return df.withColumn(out_col, V.compress(col, is_sparse))


def sparse_from_pairs(pairs: DataFrame, size: int, id_col: str = "id", index_col: str = "index",
                      value_col: str = "value", out_col: str = "features") -> DataFrame:
    """Unordered (id, index, value) pairs -> one sparse vector per id.

    A group is one vector, so its size is bounded by ``size`` (the vector length), not by
    the data volume.  Duplicate or out-of-range indices raise."""
    sorted_pairs = F.array_sort(F.collect_list(F.struct(F.col(index_col).cast("int").alias("i"),
                                                        F.col(value_col).cast("double").alias("v"))))
    g = pairs.groupBy(id_col).agg(sorted_pairs.alias("_p"))
    idx = F.transform("_p", lambda p: p["i"])
    vals = F.transform("_p", lambda p: p["v"])
    ok_unique = F.size(F.array_distinct(idx)) == F.size(idx)
    ok_range = (F.coalesce(F.array_min(idx), F.lit(0)) >= 0) & (F.coalesce(F.array_max(idx), F.lit(-1)) < size)
    checked = F.when(ok_unique & ok_range, F.lit(True)).otherwise(
        F.raise_error(F.lit("sparse_from_pairs: duplicate or out-of-range index")))
    return g.select(id_col, F.when(checked, V.sparse(F.lit(size), idx, vals)).alias(out_col))


def select_features(df: DataFrame, idxs: list[int], col: str = "features",
                    out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, V.select(col, idxs))


def append_bias(df: DataFrame, col: str = "features", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, V.append_bias(col))


def log_loss(scored: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Mean logistic loss: avg(log(1 + e^s) - y * s), overflow safe.  One row."""
    s, y = F.col(score_col), F.col(label_col).cast("double")
    return scored.agg(F.avg(V.log1p_exp(s) - y * s).alias("log_loss"))


def dedupe_vectors(df: DataFrame, col: str = "features", id_col: str = "id",
                   is_sparse: bool = False) -> DataFrame:
    """Distinct vectors under vector equality (dense == sparse, explicit zeros ignored):
    (key vector in canonical sparse form, representative = lowest id, n_copies).

    Canonicalises then aggregates by the canonical form; a hot duplicate group is reduced by
    the partial aggregate before the shuffle, so its size does not matter."""
    canon = V.sparse_compact(col) if is_sparse else V.to_sparse(col)
    return (df.select(F.col(id_col), canon.alias("_key"))
            .groupBy("_key").agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies"))
            .withColumnRenamed("_key", "vector"))


def vector_sum_by(df: DataFrame, key: str, col: str = "features") -> DataFrame:
    """(key, pos, sum, n): per-key sum of vectors, long form.  Partial sums are formed per task
    before the shuffle, so each key costs at most dim rows per task however hot it is."""
    exploded = df.select(key, F.posexplode(col).alias("pos", "x"))
    sums = exploded.groupBy(key, "pos").agg(F.sum("x").alias("sum"), F.count("*").alias("n"))
    return sums


def vector_mean_by(df: DataFrame, key: str, col: str = "features") -> DataFrame:
    """(key, pos, mean) long form."""
    return vector_sum_by(df, key, col).select(key, "pos", (F.col("sum") / F.col("n")).alias("mean"))


def long_to_vectors(long_df: DataFrame, key: str, pos_col: str = "pos", value_col: str = "value",
                    out_col: str = "features") -> DataFrame:
    """Long (key, pos, value) -> (key, array ordered by pos).  Groups are one vector each."""
    g = long_df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos_col, value_col))).alias("_p"))
    return g.select(key, F.transform("_p", lambda p: p[value_col].cast("double")).alias(out_col))


def scale_add(df: DataFrame, a: float, x: str, y: str, out_col: str = "result") -> DataFrame:
    if math.isnan(a):
        raise ValueError("a must be a number")
    return df.withColumn(out_col, V.scale_add(a, x, y))
