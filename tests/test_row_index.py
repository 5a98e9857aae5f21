"""Row numbers and running sums on rows wide and many enough to be split and coalesced."""

import pytest
from pyspark.sql import functions as F

from strata.functions import text as T
from strata.operators import graph as G
from strata.operators import layout as L
from strata.operators import text as X


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("partitions", [4, 16])
def test_row_index_keeps_every_wide_row(spark, aqe, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n = 20_000
        wide = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i * 0.5).alias("features"))
        got = L.row_index(wide, "id", "row").select("id", "row").collect()
        assert sorted(r["row"] for r in got) == list(range(n))
        assert all(r["id"] == r["row"] for r in got)
        sums = G.prefix_sum(wide.select("id", F.lit(2).cast("long").alias("v"), "features"), ["id"], "v", "at").select("id", "at").collect()
        assert len(sums) == n and all(r["at"] == 2 * r["id"] for r in sums)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trim_keeps_line_separators_beyond_the_trim_class(spark):
    odd = "abc " + chr(0x2028)
    df = spark.createDataFrame([(1, odd)], "doc_id long, text string")
    tokens = df.select(T.tokens("text").alias("t")).first()["t"]
    back = X.tokens_from_offsets(X.token_offsets(df)).first()["tokens"]
    assert tokens == back
