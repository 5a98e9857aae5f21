"""Equi-joins whose keys may be hot on the large side.

``salt_hot`` finds the keys with more rows than a threshold and deals their rows over salts;
``join_hot`` repeats the matching rows of the other side once for each salt.  Both sides of a hot
key then meet in many tasks, and all other keys are joined as usual.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.session import cut_lineage_counted, release

#: A key is hot if it has more rows than this and more than the 1 / HOT_SHARE part of all rows, so
#: there are at most HOT_SHARE hot keys to broadcast.
HOT_ROWS = 200_000
HOT_SHARE = 100_000


def salt_hot(df: DataFrame, key: str, by: str | Column, salt: str = "_salt", threshold: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Adds ``salt``: 0, or for a hot key a hash of ``by`` over so many salts that each has about
    ``threshold`` rows.  Also returns the hot keys (_hot_key, n_salt), or None if there are none.
    Rows of a hot key with equal ``by`` share a salt, so ``by`` should tell its rows apart."""
    if threshold is None:
        threshold = max(HOT_ROWS, math.ceil(df.count() / HOT_SHARE))
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > threshold)
    hot, n = cut_lineage_counted(rows.select(F.col(key).alias("_hot_key"), F.ceil(F.col("_n") / threshold).cast("int").alias("n_salt")))
    if not n:
        release(hot)
        return df.withColumn(salt, F.lit(0)), None
    dealt = F.coalesce(F.pmod(F.xxhash64(by), F.col("n_salt")), F.lit(0)).cast("int")
    return df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(salt, dealt).drop("_hot_key", "n_salt"), hot


def join_hot(df: DataFrame, key: str, side: DataFrame, hot: DataFrame | None, salt: str = "_salt", how: str = "inner", hashed: bool = False) -> DataFrame:
    """Joins rows salted by ``salt_hot`` with the rows of ``side`` that have the same ``key``.  ``hashed``: rows that
    already lie by (key, salt), or by key if nothing is hot, are neither moved nor sorted again."""
    if hot is None:
        return df.join(side.hint("shuffle_hash") if hashed else side, key, how)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salt"), F.lit(1)) - 1))
    held = side.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(salt, copies)
    held = held.drop("_hot_key", "n_salt")
    return df.join(held.hint("shuffle_hash") if hashed else held, [key, salt], how)
