"""Sampling, splits and cross-validation folds.

Deterministic variants draw a uniform number from a hash of the row id and a seed, so the
assignment of a row does not depend on partitioning or on re-execution after a lost task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.hashing import uniform
from strata.plans.kmeans import take_sample, weighted_sample  # noqa: F401  (re-exported)


def random_split(df: DataFrame, weights: list[float], seed: int = 42, id_col: str | None = None) -> list[DataFrame]:
    """Disjoint splits with the given relative weights.  With ``id_col`` the split is a pure
    function of (id, seed); without it Spark's ``randomSplit`` is used."""
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must be non-negative and sum to a positive value")
    if id_col is None:
        return df.randomSplit(weights, seed)
    total = float(sum(weights))
    bounds = [0.0]
    for w in weights:
        bounds.append(bounds[-1] + w / total)
    u = uniform(seed, id_col)
    return [df.filter((u >= lo) & ((u < hi) if i < len(weights) - 1 else F.lit(True)))
            for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]))]


def split_by_id(df: DataFrame, weights: list[float], id_col: str, prime: int = 7919, buckets: int = 10) -> list[DataFrame]:
    """Arithmetic split on pmod(id * prime, buckets), reproducible in plain SQL; weights are
    rounded to whole buckets."""
    total = float(sum(weights))
    cuts = [0]
    acc = 0.0
    for w in weights:
        acc += w / total
        cuts.append(round(acc * buckets))
    b = F.pmod(F.col(id_col) * F.lit(prime), F.lit(buckets))
    return [df.filter((b >= lo) & (b < hi)) for lo, hi in zip(cuts[:-1], cuts[1:])]


def split_label(df: DataFrame, weights: list[float], seed: int, id_col: str, out_col: str = "split") -> DataFrame:
    """Tag every row with its split number (same rule as ``random_split`` with ``id_col``)."""
    total = float(sum(weights))
    u = uniform(seed, id_col)
    expr = F.lit(len(weights) - 1)
    acc = 0.0
    cases = []
    for i, w in enumerate(weights[:-1]):
        acc += w / total
        cases.append((i, acc))
    for i, hi in reversed(cases):
        expr = F.when(u < hi, F.lit(i)).otherwise(expr)
    return df.withColumn(out_col, expr.cast("int"))


def k_fold(df: DataFrame, k: int, seed: int = 42, id_col: str | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """k (training, validation) pairs; fold f validates the cell [f/k, (f+1)/k) of one uniform
    draw per row and trains on the complement."""
    if k < 2:
        raise ValueError("k must be >= 2")
    u = uniform(seed, id_col) if id_col else F.rand(seed)
    tagged = df.withColumn("_u", u)
    out = []
    for f in range(k):
        lo, hi = f / k, (f + 1) / k
        inside = (F.col("_u") >= lo) & (F.col("_u") < hi)
        out.append((tagged.filter(~inside).drop("_u"), tagged.filter(inside).drop("_u")))
    return out


def fold_label(df: DataFrame, k: int, seed: int, id_col: str, out_col: str = "fold") -> DataFrame:
    """Validation fold of each row (same rule as ``k_fold`` with ``id_col``)."""
    return df.withColumn(out_col, F.least(F.floor(uniform(seed, id_col) * k), F.lit(k - 1)).cast("int"))


def fold_by_id(df: DataFrame, k: int, id_col: str, prime: int = 7919, out_col: str = "fold") -> DataFrame:
    """Arithmetic fold assignment pmod(id * prime, k), reproducible in plain SQL."""
    return df.withColumn(out_col, F.pmod(F.col(id_col) * F.lit(prime), F.lit(k)).cast("int"))
