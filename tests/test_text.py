import duckdb
from pyspark.sql import functions as F

from strata.functions.hashing import hash_index, hash_native
from strata.operators import text as X

# Golden values: legacy MurmurHash3_x86_32 (seed 42) and index at 2^20 features.
GOLDEN = {"a": (1485273170, 489554), "ab": (-97053317, 464251), "abc": (1322437556, 183220),
          "abcd": (-396302900, 58828), "abcde": (814637928, 942952), "word": (-281256481, 810463),
          "ä": (1085608887, 332727), "étranger": (-664342168, 455016)}


def test_murmur3_golden(spark):
    df = spark.createDataFrame([(w,) for w in GOLDEN], "t string")
    got = {r.t: (r.h, r.i) for r in df.select("t", F.hash("t").alias("h"), hash_index("t").alias("i")).collect()}
    assert got == GOLDEN


def test_murmur3_other_types(spark):
    r = spark.createDataFrame([(True, 1, 1, 1.0, 1.0)], "b boolean, i int, l long, f float, d double").select(
        F.hash("b"), F.hash("i"), F.hash("l"), F.hash("f"), F.hash("d"), F.hash(F.lit(None))).first()
    assert tuple(r) == (-559580957, -559580957, -1712319331, -466301895, -460888942, 42)


def test_native_hash_matches_jvm_string_hash(spark):
    words = ["abc", "hello world", "ä", "étranger", "", "zzzzzzzzzzzzzzzz"]

    def java_hash(s):
        h = 0
        units = [int.from_bytes(s.encode("utf-16-be")[i:i + 2], "big") for i in range(0, len(s.encode("utf-16-be")), 2)]
        for u in units:
            h = (31 * h + u) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    df = spark.createDataFrame([(w,) for w in words + ["a\U0001F600b"]], "t string")
    got = {r.t: r.h for r in df.select("t", hash_native("t").alias("h")).collect()}
    for w in words + ["a\U0001F600b"]:
        assert got[w] == java_hash(w), w


def test_tokenize_trim_and_split(spark):
    df = spark.createDataFrame([(1, "\x01 ab  cd\t\n"), (2, "   "), (3, "x")], "doc_id long, text string")
    toks = {r.doc_id: r.tokens for r in X.tokenize(df).collect()}
    assert toks == {1: ["ab", "cd"], 2: [], 3: ["x"]}


def test_offsets_golden_and_inverse(spark):
    df = spark.createDataFrame([(1, " ab cd\n é f ")], "doc_id long, text string")
    o = X.token_offsets(df)
    assert o.first().offsets == [1, 3, 4, 6, 8, 9, 10, 11]
    assert X.tokens_from_offsets(o).first().tokens == ["ab", "cd", "é", "f"]


def test_token_parity_with_duckdb(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tc = X.term_counts(docs)
    assert tc.count() == 54737
    assert tc.agg(F.sum("tf")).first()[0] == 79047
    con = duckdb.connect()
    n = con.execute(
        f"SELECT count(*) FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array("
        f"regexp_replace(text, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '\\s+'), lambda w: w <> '')) "
        f"FROM '{sf}/documents.parquet')").fetchall()[0][0]
    assert n == 54737


def test_hashing_tf_binary_and_collisions(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "")], "doc_id long, text string")
    ib = spark.createDataFrame([("b",)], "t string").select(hash_index("t")).first()[0]
    tf = {(r.doc_id, r.idx): r.tf for r in X.hashing_tf(df).collect()}
    assert tf == {(1, 489554): 2.0, (1, ib): 1.0}
    tfb = {(r.doc_id, r.idx): r.tf for r in X.hashing_tf(df, binary=True).collect()}
    assert set(tfb.values()) == {1.0}
    # with 1 feature every term collides into index 0 and counts add up
    one = X.hashing_tf(df, num_features=1).collect()
    assert [(r.doc_id, r.idx, r.tf) for r in one] == [(1, 0, 3.0)]


def test_idf_two_documents(spark):
    tf = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0)], "doc_id long, idx int, tf double")
    idf = {r.idx: r.idf for r in X.idf_fit(tf).collect()}
    assert idf[0] == 0.0
    assert abs(idf[1] - 0.4054651081081644) < 1e-15


def test_idf_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "")], "doc_id long, text string")
    tf = X.hashing_tf(docs)
    idf = X.idf_fit(tf, documents=docs).first()
    import math
    assert abs(idf.idf - math.log(3 / 2)) < 1e-15


def test_min_doc_freq(spark):
    tf = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0)], "doc_id long, idx int, tf double")
    idf = {r.idx: r.idf for r in X.idf_fit(tf, min_doc_freq=2).collect()}
    assert idf[1] == 0.0


def test_native_hash_of_longs(spark):
    from pyspark.sql import types as T

    values = [-1, -5, 0, 7, 2**31 - 1, -(2**31), 2**31, 2**32, -(2**31) - 1, 2**63 - 1]
    def java(v):
        u = v % 2**64
        h = (u ^ (u >> 32)) % 2**32
        return v if -(2**31) <= v < 2**31 else h - 2**32 if h >= 2**31 else h
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.h for r in df.select(hash_native("v", T.LongType()).alias("h")).collect()] == [java(v) for v in values]


def test_batch_hashes_equal_the_column_functions(spark):
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F

    from strata.functions import counting as CO
    from strata.functions import hashing as H

    rnd = random.Random(1)
    words = ["".join(rnd.choice("abzé中\U0001f600ÿ\x00") for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["", "x" * 10_001]
    rows = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", F.hash("w").alias("m"), H.hash_native("w").alias("n")).orderBy("i").collect()
    assert CO.murmur3(pa.array(words)).tolist() == [r.m for r in rows]
    assert CO.native(pa.array(words)).tolist() == [r.n for r in rows]


def test_counts_of_awkward_texts(spark):
    from strata.operators import text as X

    texts = ["\x00\x1c a b\x1ca  a\x0b\t\x85b \x1f", None, "", " \n", "x\x00 \x00", "\x85 q \xa0", "a " * 2_000_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, tf int")
    got = {(r.doc_id, r.term): r.tf for r in X.term_counts(df).collect()}
    assert got == {(r.doc_id, r.term): r["count"] for r in X.tokens_long(df).groupBy("doc_id", "term").count().collect()} and got[6, "a"] == 2_000_000
    sizes = {r.doc_id: r.n for r in X.hashing_tf_vectors(df).selectExpr("doc_id", "size(features.indices) AS n").collect()}
    assert sizes == {0: 3, 1: 0, 2: 0, 3: 0, 4: 1, 5: 3, 6: 1}
    assert X.term_counts(df.limit(0)).count() == 0 and X.tfidf_job(df.limit(0)).count() == 0


def test_tfidf_shuffles_no_term_frequencies(spark, sf):
    from strata import catalog as C
    from strata.operators import text as X

    plan = X.tfidf_job(C.docs(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("hashpartitioning") == 1 and "hashpartitioning(idx" in plan and "BroadcastHashJoin" in plan


def test_standard_hash_equals_spark_ml(spark):
    from pyspark.ml.feature import HashingTF

    from strata.functions import hashing as H

    words = ["", "a", "ab", "abc", "abcd", "abcde", "éa", "中文字", "\U0001f600x", "x" * 1001]
    ml = HashingTF(numFeatures=1 << 20)
    rows = spark.createDataFrame([*enumerate(words), (99, None)], "i int, w string").select("i", H.hash_index("w", algo="standard").alias("h")).collect()
    assert {r.i: r.h for r in rows} == {i: ml.indexOf(w) for i, w in enumerate(words)} | {99: 42}


def test_offsets_run_in_arrow_and_match_the_tokens(spark):
    """Character-array expressions cost some microseconds a character, whatever the text; the places of a batch come from one pass."""
    texts = ["", None, " ", "\x01a\x02b \x03", "\x01\x02", "x", "é\t\U0001F600z     y\x00", "a\x1fb\x1f", "no end", "\x0bq\x0c\rr\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    o = X.token_offsets(df)
    assert "ArrowEvalPython" in o._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in X.tokens_from_offsets(o).collect()}
    want = {r.doc_id: r.tokens or [] for r in X.tokenize(df).collect()}
    assert {k: r.tokens for k, r in got.items()} == want
    for k, r in got.items():
        assert [texts[k][a:b] for a, b in zip(r.offsets[::2], r.offsets[1::2])] == want[k]


def test_tokens_from_any_offsets(spark):
    rows = [("aéb c", [1, 3, 0, 1, 1, 3]), ("ab", [1, 9, 7, 9]), ("ab", None), (None, [0, 1]), ("ab", [None, 1, 0, 2]), ("ab", [0]), ("ab", [0, 1, 1]), ("", [0, 0]), ("abc", [-3, -2, -9, -8])]
    df = spark.createDataFrame(rows, "text string, offsets array<int>").coalesce(1)
    assert [r.tokens for r in X.tokens_from_offsets(df).collect()] == [
        ["éb", "a", "éb"], ["b", ""], [], [None], [None, "ab"], [None], ["a"], [""], ["b", ""]]
