"""Registered queries over the driver tables, each with its DuckDB oracle where SQL can express it.

Each query reads whole tables (or data Spark derives from them).  Array results are
exploded to long form and floating values rounded with ``round_stable`` on both sides, so
results compare exactly across engines.  Inputs:

* points      embeddings -> (id = vec_id, features = embedding as array<double>, label)
* sparse      the same with |x| < 0.1 set to zero, stored sparse
* edges       src = l_orderkey, dst = l_partkey from lineitem, every row
* hub edges   the edges and one vertex, -1, with an edge to the part of every lineitem row
* centers     the 10 points with the lowest vec_id
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import oracle_sql as Q
from strata.functions import hashing as H
from strata.functions import vectors as V
from strata.operators import graph as G
from strata.operators import layout as L
from strata.operators import linalg as LA
from strata.operators import sampling as S
from strata.operators import text as X
from strata.operators import vectors as VO
from strata.plans import graph as GP
from strata.plans import kmeans as KM
from strata.plans import tree as TR
from strata.session import checkpoint_dir
from strata.sources import files as FI
from strata.sources import text_formats as TF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

R = V.round_stable
K_CENTERS = 10
N_ITER = 5
SPARSE_EPS = 0.1
ROOT = 0
PR_ITER = 5


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ----------------------------------------------------------------------------- inputs

def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def points(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"),
                    F.col("label").cast("long").alias("label"))


def thresholded(col="features"):
    return F.transform(col, lambda x: F.when(F.abs(x) < SPARSE_EPS, F.lit(0.0)).otherwise(x))


def sparse_points(spark, d) -> DataFrame:
    return points(spark, d).select("id", "label", V.to_sparse(thresholded()).alias("features"))


def edges(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


def hub_edges(spark, d) -> DataFrame:
    e = edges(spark, d)
    return e.unionByName(e.select(F.lit(-1).cast("long").alias("src"), "dst"))


def weighted_edges(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"),
                                              F.col("l_quantity").cast("double").alias("attr"))


def shared_path(spark, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lowest_centers(spark, d) -> DataFrame:
    return KM.initial_centers_lowest(points(spark, d), K_CENTERS)


def long_vec(df: DataFrame, key: str, col: str, round_values: bool = True) -> DataFrame:
    ex = df.select(key, F.posexplode(col).alias("pos", "value"))
    return ex.select(key, F.col("pos").cast("long"), R("value").alias("value") if round_values else "value")


# SQL building blocks (DuckDB)
PTS = "(SELECT vec_id AS id, embedding::DOUBLE[] AS f, label::BIGINT AS label FROM embeddings)"
PTS_LONG = f"(SELECT id, unnest(range(len(f))) AS pos, unnest(f) AS x FROM {PTS})"
THR = f"(SELECT id, label, [CASE WHEN abs(x) < {SPARSE_EPS} THEN 0.0 ELSE x END for x in f] AS f FROM {PTS})"
SP_LONG = f"(SELECT id, label, pos, x FROM (SELECT id, label, unnest(range(len(f))) AS pos, unnest(f) AS x FROM {THR}) WHERE x <> 0)"
EDGES = "(SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem)"
HUB_EDGES = f"(SELECT * FROM {EDGES} UNION ALL SELECT -1, l_partkey FROM lineitem)"
VERTS = f"(SELECT src AS id FROM {EDGES} UNION SELECT dst FROM {EDGES})"
CENTERS0 = f"(SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cid, f AS c FROM (SELECT * FROM {PTS} ORDER BY id LIMIT {K_CENTERS}))"
TOKS = f"(SELECT doc_id, {Q.tokens()} AS tk FROM documents)"
TERM_COUNTS = f"(SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(tk) AS term FROM {TOKS}) GROUP BY doc_id, term)"


def rs(x: str, places: int = 6) -> str:
    return Q.round_stable(x, places)


def sqdist_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


# ============================================================================= TEXT

@register("tokenize", f"SELECT doc_id, unnest(range(len(tk)))::BIGINT AS pos, unnest(tk) AS term FROM {TOKS}")
def q_tokenize(spark, d):
    t = X.tokens_long(docs(spark, d))
    return t.select("doc_id", F.col("pos").cast("long"), "term")


_OFFSETS_SQL = f"""
WITH d AS (SELECT doc_id, length(regexp_extract(text, '^[\\x00-\\x20]*', 0)) AS lead,
                  regexp_extract_all(regexp_replace(text, '{Q.TRIM_RE}', '', 'g'), '\\s+|\\S+') AS pieces
           FROM documents),
p AS (SELECT doc_id, lead, unnest(pieces) AS piece, unnest(range(len(pieces))) AS ord FROM d),
c AS (SELECT doc_id, lead, piece, ord,
             sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS endpos
      FROM p),
tk AS (SELECT doc_id, lead + endpos - length(piece) AS s, lead + endpos AS e,
              row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS j
       FROM c WHERE NOT regexp_matches(piece, '^\\s'))
SELECT doc_id, (2 * j)::BIGINT AS k, s::BIGINT AS "offset" FROM tk
UNION ALL SELECT doc_id, (2 * j + 1)::BIGINT, e::BIGINT FROM tk"""


@register("token_offsets", _OFFSETS_SQL)
def q_token_offsets(spark, d):
    o = X.token_offsets(docs(spark, d))
    return o.select("doc_id", F.posexplode("offsets").alias("k", "offset")).select(
        "doc_id", F.col("k").cast("long"), F.col("offset").cast("long"))


@register("tokens_from_offsets", ORACLES["tokenize"])
def q_tokens_from_offsets(spark, d):
    t = X.tokens_from_offsets(X.token_offsets(docs(spark, d)))
    return t.select("doc_id", F.posexplode("tokens").alias("pos", "term")).select(
        "doc_id", F.col("pos").cast("long"), "term")


@register("term_counts", f"SELECT doc_id, term, tf FROM {TERM_COUNTS}")
def q_term_counts(spark, d):
    return X.term_counts(docs(spark, d))


def _murmur_terms_sql(num_features: int = H.DEFAULT_NUM_FEATURES) -> tuple[str, str]:
    ctes, rel = Q.murmur3_ctes(f"(SELECT DISTINCT term FROM {TERM_COUNTS})")
    return ctes, f"(SELECT term, h::BIGINT AS h, {Q.pmod('h', num_features)}::BIGINT AS idx FROM {rel})"


_MM_CTES, _MM_TERMS = _murmur_terms_sql()


@register("hash_murmur3", f"WITH {_MM_CTES} SELECT term, h, idx FROM {_MM_TERMS}")
def q_hash_murmur3(spark, d):
    terms = X.term_counts(docs(spark, d)).select("term").distinct()
    return terms.select("term", H.hash_murmur3("term").cast("long").alias("h"),
                        H.hash_index("term").cast("long").alias("idx"))


_NATIVE_TERMS = (f"(SELECT term, {Q.native_hash('term')}::BIGINT AS h, "
                 f"{Q.pmod(Q.native_hash('term'), H.DEFAULT_NUM_FEATURES)}::BIGINT AS idx "
                 f"FROM (SELECT DISTINCT term FROM {TERM_COUNTS}))")


@register("hash_native", f"SELECT term, h, idx FROM {_NATIVE_TERMS}")
def q_hash_native(spark, d):
    terms = X.term_counts(docs(spark, d)).select("term").distinct()
    return terms.select("term", H.hash_native("term").cast("long").alias("h"),
                        H.hash_index("term", algo="native").cast("long").alias("idx"))


def _htf_sql(terms_rel: str, ctes: str | None, binary: bool = False) -> str:
    tfexpr = "1.0::DOUBLE" if binary else "sum(c.tf)::DOUBLE"
    body = (f"SELECT c.doc_id, h.idx::INTEGER AS idx, {tfexpr} AS tf FROM {TERM_COUNTS} c "
            f"JOIN {terms_rel} h USING (term) GROUP BY c.doc_id, h.idx")
    return f"WITH {ctes} {body}" if ctes else body


@register("hashing_tf", _htf_sql(_MM_TERMS, _MM_CTES))
def q_hashing_tf(spark, d):
    return X.hashing_tf(docs(spark, d))


@register("hashing_tf_native", _htf_sql(_NATIVE_TERMS, None))
def q_hashing_tf_native(spark, d):
    return X.hashing_tf(docs(spark, d), algo="native")


def _standard_sql() -> tuple[str, str]:
    ctes, rel = Q.murmur3_ctes(f"(SELECT DISTINCT term FROM {TERM_COUNTS})", standard=True)
    return ctes, f"(SELECT term, h::BIGINT AS h, {Q.pmod('h', H.DEFAULT_NUM_FEATURES)}::BIGINT AS idx FROM {rel})"


_ST_CTES, _ST_TERMS = _standard_sql()


@register("hash_standard", f"WITH {_ST_CTES} SELECT term, h, idx FROM {_ST_TERMS}")
def q_hash_standard(spark, d):
    terms = X.term_counts(docs(spark, d)).select("term").distinct()
    return terms.select("term", H.hash_standard("term").cast("long").alias("h"),
                        H.hash_index("term", algo="standard").cast("long").alias("idx"))


@register("hashing_tf_standard", _htf_sql(_ST_TERMS, _ST_CTES))
def q_hashing_tf_standard(spark, d):
    return X.hashing_tf(docs(spark, d), algo="standard")


@register("hashing_tf_binary", _htf_sql(_MM_TERMS, _MM_CTES, binary=True))
def q_hashing_tf_binary(spark, d):
    return X.hashing_tf(docs(spark, d), binary=True)


@register("hash_collisions", f"WITH {_MM_CTES} SELECT idx::INTEGER AS idx, count(*)::BIGINT AS n_terms "
                             f"FROM {_MM_TERMS} GROUP BY idx HAVING count(*) > 1")
def q_hash_collisions(spark, d):
    return X.hash_collisions(docs(spark, d))


def _tfidf_ctes() -> str:
    """Each step once: term counts, hashes of the distinct terms, term frequencies, idf."""
    murmur, rel = Q.murmur3_ctes("(SELECT DISTINCT term FROM tc)")
    return f"""tc AS MATERIALIZED {TERM_COUNTS}, {murmur},
mm AS MATERIALIZED (SELECT term, {Q.pmod('h', H.DEFAULT_NUM_FEATURES)}::INTEGER AS idx FROM {rel}),
tf AS MATERIALIZED (SELECT tc.doc_id, mm.idx, sum(tc.tf)::DOUBLE AS tf FROM tc JOIN mm USING (term) GROUP BY tc.doc_id, mm.idx),
idf AS MATERIALIZED (SELECT idx, count(*)::BIGINT AS doc_freq, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY idx)"""


@register("idf_fit", f"WITH {_tfidf_ctes()} SELECT idx, doc_freq, {rs('idf')} AS idf FROM idf")
def q_idf_fit(spark, d):
    dd = docs(spark, d)
    idf = X.idf_fit(X.hashing_tf(dd), documents=dd)
    return idf.select("idx", "doc_freq", R("idf").alias("idf"))


@register("tfidf", f"WITH {_tfidf_ctes()} SELECT tf.doc_id, tf.idx, tf.tf, {rs('idf.idf')} AS idf, "
                   f"{rs('tf.tf * idf.idf')} AS tfidf FROM tf JOIN idf USING (idx)")
def q_tfidf(spark, d):
    t = X.tfidf_job(docs(spark, d))
    return t.select("doc_id", "idx", "tf", R("idf").alias("idf"), R("tfidf").alias("tfidf"))


@register("tfidf_terms", f"""WITH m AS (SELECT count(*) AS m FROM documents),
idf AS (SELECT term, ln((m.m + 1.0) / (count(*) + 1.0)) AS idf FROM {TERM_COUNTS}, m GROUP BY term, m.m)
SELECT c.doc_id, c.term, c.tf, {rs('idf.idf')} AS idf, {rs('c.tf * idf.idf')} AS tfidf
FROM {TERM_COUNTS} c JOIN idf USING (term)""")
def q_tfidf_terms(spark, d):
    dd = docs(spark, d)
    tc = X.term_counts(dd)
    idf = X.idf_fit(tc, documents=dd, key_col="term")
    t = X.tfidf(tc, idf, key_col="term")
    return t.select("doc_id", "term", "tf", R("idf").alias("idf"), R("tfidf").alias("tfidf"))


# ============================================================================= VECTORS

@register("vector_norm", f"""SELECT id, {rs('list_sum([abs(x) for x in f])')} AS l1,
{rs('sqrt(list_sum([x * x for x in f]))')} AS l2, {rs('list_max([abs(x) for x in f])')} AS linf,
{rs('pow(list_sum([pow(abs(x), 3.0) for x in f]), 1.0 / 3.0)')} AS l3 FROM {PTS}""")
def q_vector_norm(spark, d):
    p = points(spark, d)
    return p.select("id", R(V.norm("features", 1)).alias("l1"), R(V.norm("features", 2)).alias("l2"),
                    R(V.norm("features", float("inf"))).alias("linf"), R(V.norm("features", 3)).alias("l3"))


@register("vector_profile", f"""SELECT id, len(f)::BIGINT AS size, len(f)::BIGINT AS n_active,
len([x for x in f if x <> 0])::BIGINT AS nnz, (list_position(f, list_max(f)) - 1)::BIGINT AS argmax FROM {PTS}""")
def q_vector_profile(spark, d):
    p = VO.vector_profile(points(spark, d).select("id", "features"))
    return p.select("id", *[F.col(c).cast("long") for c in ("size", "n_active", "nnz", "argmax")])


@register("vector_profile_sparse", f"""SELECT id, len(f)::BIGINT AS size, len([x for x in f if x <> 0])::BIGINT AS n_active,
len([x for x in f if x <> 0])::BIGINT AS nnz, (list_position(f, list_max(f)) - 1)::BIGINT AS argmax FROM {THR}""")
def q_vector_profile_sparse(spark, d):
    p = VO.vector_profile(sparse_points(spark, d).select("id", "features"), is_sparse=True)
    return p.select("id", *[F.col(c).cast("long") for c in ("size", "n_active", "nnz", "argmax")])


@register("vector_get", f"SELECT id, f[1] AS v0, f[32] AS v31, f[64] AS v63, "
                        f"(CASE WHEN abs(f[32]) < {SPARSE_EPS} THEN 0.0 ELSE f[32] END) AS s31 FROM {PTS}")
def q_vector_get(spark, d):
    p = points(spark, d).select("id", "features", V.to_sparse(thresholded()).alias("sp"))
    return p.select("id", V.get("features", 0).alias("v0"), V.get("features", 31).alias("v31"),
                    V.get("features", 63).alias("v63"), V.get("sp", 31, is_sparse=True).alias("s31"))


@register("to_sparse", f"""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::BIGINT AS k,
pos::BIGINT AS idx, x AS value, 64::BIGINT AS size FROM {SP_LONG}""")
def q_to_sparse(spark, d):
    sp = sparse_points(spark, d)
    ex = sp.select("id", F.col("features.size").cast("long").alias("size"),
                   F.posexplode(F.arrays_zip("features.indices", "features.values")).alias("k", "p"))
    return ex.select("id", F.col("k").cast("long"), F.col("p.indices").cast("long").alias("idx"),
                     F.col("p.values").alias("value"), "size")


@register("to_dense", f"SELECT id, unnest(range(len(f)))::BIGINT AS pos, unnest(f) AS value FROM {THR}")
def q_to_dense(spark, d):
    sp = sparse_points(spark, d)
    return long_vec(sp.select("id", V.to_dense("features").alias("dense")), "id", "dense", round_values=False)


@register("compress_vectors", f"""SELECT id, (1.5 * (len([x for x in f if x <> 0]) + 1) < len(f)) AS is_sparse,
len([x for x in f if x <> 0])::BIGINT AS nnz FROM {THR}""")
def q_compress_vectors(spark, d):
    c = VO.compress_vectors(points(spark, d).select("id", thresholded().alias("features")))
    return c.select("id", F.col("compressed.is_sparse").alias("is_sparse"),
                    F.coalesce(F.size("compressed.sparse.indices"),
                               F.size(F.filter("compressed.dense", lambda x: x != 0.0))).cast("long").alias("nnz"))


@register("sparse_from_pairs", ORACLES["to_sparse"])
def q_sparse_from_pairs(spark, d):
    sp = sparse_points(spark, d)
    pairs = sp.select("id", F.inline(F.arrays_zip(F.col("features.indices").alias("index"),
                                                    F.col("features.values").alias("value"))))
    v = VO.sparse_from_pairs(pairs, 64)
    ex = v.select("id", F.col("features.size").cast("long").alias("size"),
                  F.posexplode(F.arrays_zip("features.indices", "features.values")).alias("k", "p"))
    return ex.select("id", F.col("k").cast("long"), F.col("p.indices").cast("long").alias("idx"),
                     F.col("p.values").alias("value"), "size")


_SEL = [5, 0, 63, 17]


@register("select_features", f"SELECT id, unnest(range({len(_SEL)}))::BIGINT AS pos, "
                             f"unnest([{', '.join(f'f[{i + 1}]' for i in _SEL)}]) AS value FROM {PTS}")
def q_select_features(spark, d):
    s = VO.select_features(points(spark, d), _SEL)
    return long_vec(s, "id", "features", round_values=False)


@register("append_bias", f"SELECT id, (len(f) + 1)::BIGINT AS size, 1.0::DOUBLE AS last, {rs('list_sum(f) + 1.0')} AS total FROM {PTS}")
def q_append_bias(spark, d):
    a = VO.append_bias(points(spark, d))
    return a.select("id", F.size("features").cast("long").alias("size"), F.element_at("features", -1).alias("last"),
                    R(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)).alias("total"))


_SCORE_SQL = "(list_sum(f) + 0.5)"


_LOSS_TERM = (f"CASE WHEN {_SCORE_SQL} > 0 THEN {_SCORE_SQL} + ln(1 + exp(-{_SCORE_SQL})) "
              f"ELSE ln(1 + exp({_SCORE_SQL})) END - (label % 2) * {_SCORE_SQL}")


@register("log_loss", f"SELECT {rs(f'avg({_LOSS_TERM})')} AS log_loss FROM {PTS}")
def q_log_loss(spark, d):
    p = points(spark, d)
    scored = p.select((F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x) + F.lit(0.5)).alias("score"),
                      (F.col("label") % 2).alias("label"))
    return VO.log_loss(scored).select(R("log_loss").alias("log_loss"))


@register("dedupe_vectors", f"""WITH {_MM_CTES}, tf AS ({_htf_sql(_MM_TERMS, None)}),
vk AS (SELECT doc_id, list(struct_pack(i := idx, v := tf) ORDER BY idx) FILTER (idx IS NOT NULL) AS key FROM documents LEFT JOIN tf USING (doc_id) GROUP BY doc_id)
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n_copies FROM vk GROUP BY key""")
def q_dedupe_vectors(spark, d):
    v = X.hashing_tf_vectors(docs(spark, d))
    dd = VO.dedupe_vectors(v, "features", "doc_id", is_sparse=True)
    return dd.select("doc_id", "n_copies")


@register("vector_sum_by", f"SELECT label, pos::BIGINT AS pos, {rs('sum(x)')} AS sum, count(*)::BIGINT AS n "
                           f"FROM (SELECT p.label, l.pos, l.x FROM {PTS_LONG} l JOIN {PTS} p USING (id)) GROUP BY label, pos")
def q_vector_sum_by(spark, d):
    s = VO.vector_sum_by(points(spark, d), "label")
    return s.select("label", F.col("pos").cast("long"), R("sum").alias("sum"), "n")


@register("vector_mean_by", f"SELECT label, pos::BIGINT AS pos, {rs('avg(x)')} AS mean "
                            f"FROM (SELECT p.label, l.pos, l.x FROM {PTS_LONG} l JOIN {PTS} p USING (id)) GROUP BY label, pos")
def q_vector_mean_by(spark, d):
    s = VO.vector_mean_by(points(spark, d), "label")
    return s.select("label", F.col("pos").cast("long"), R("mean").alias("mean"))


@register("scale_add", f"""SELECT id, unnest(range(len(f)))::BIGINT AS pos,
unnest([{rs('p[2] + 0.5 * p[1]')} for p in list_zip(f, list_reverse(f))]) AS value FROM {PTS}""")
def q_scale_add(spark, d):
    p = points(spark, d).select("id", "features", F.reverse("features").alias("y"))
    s = VO.scale_add(p, 0.5, "features", "y")
    return long_vec(s, "id", "result")


@register("pairwise_distance", f"""SELECT a.id, {rs(sqdist_sql('a.f', 'b.f'))} AS sqdist,
{rs('list_dot_product(a.f, b.f)')} AS dot FROM {PTS} a JOIN (SELECT id - 1 AS id, f FROM {PTS}) b USING (id)""")
def q_pairwise_distance(spark, d):
    a = points(spark, d).select("id", "features")
    b = a.select((F.col("id") - 1).alias("id"), "features")
    sq = LA.pairwise_sqdist(a, b, "id")
    dt = LA.pairwise_dot(a, b, "id")
    return sq.join(dt, "id").select("id", R("sqdist").alias("sqdist"), R("dot").alias("dot"))


_PAIR_KINDS = [("dense", "dense"), ("dense", "sparse"), ("sparse", "dense"), ("sparse", "sparse")]


def _pair_sql(body) -> str:
    rel = {"dense": PTS, "sparse": THR}
    return " UNION ALL ".join(
        f"SELECT a.id, '{x}' AS left_kind, '{y}' AS right_kind, {body} FROM {rel[x]} a JOIN (SELECT id - 1 AS id, f FROM {rel[y]}) b USING (id)"
        for x, y in _PAIR_KINDS)


def _pair_queries(spark, d, make) -> DataFrame:
    kinds = {"dense": points(spark, d).select("id", "features"), "sparse": sparse_points(spark, d).select("id", "features")}
    out = None
    for x, y in _PAIR_KINDS:
        got = make(kinds[x], kinds[y].withColumn("id", F.col("id") - 1)).withColumn("left_kind", F.lit(x)).withColumn("right_kind", F.lit(y))
        out = got if out is None else out.unionByName(got)
    return out


@register("pairwise_sqdist_mixed", _pair_sql(f"{rs(sqdist_sql('a.f', 'b.f'))} AS sqdist"))
def q_pairwise_sqdist_mixed(spark, d):
    return _pair_queries(spark, d, lambda a, b: LA.pairwise_sqdist(a, b, "id").withColumn("sqdist", R("sqdist")))


@register("pairwise_dot_mixed", _pair_sql(f"{rs('list_dot_product(a.f, b.f)')} AS dot"))
def q_pairwise_dot_mixed(spark, d):
    return _pair_queries(spark, d, lambda a, b: LA.pairwise_dot(a, b, "id").withColumn("dot", R("dot")))


@register("pairwise_sqdist_from_norms", _pair_sql(f"{rs(sqdist_sql('a.f', 'b.f'))} AS sqdist"))
def q_pairwise_sqdist_from_norms(spark, d):
    return _pair_queries(spark, d, lambda a, b: LA.pairwise_sqdist_from_norms(a, b, "id").withColumn("sqdist", R("sqdist")))


# ---- k-means: unrolled Lloyd steps for the oracle

def _assign_sql(centers_rel: str) -> str:
    return f"""(SELECT id, f, arg_min(cid, struct_pack(d := d, cid := cid)) AS cluster, min(d) AS sqdist FROM (
SELECT p.id, p.f, c.cid, {sqdist_sql('p.f', 'c.c')} AS d FROM {PTS} p, {centers_rel} c) GROUP BY id, f)"""


def _step_sql(centers_rel: str) -> str:
    a = _assign_sql(centers_rel)
    means = f"""(SELECT cluster AS cid, list(m ORDER BY pos) AS c FROM (
SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(range(len(f))) AS pos, unnest(f) AS x FROM {a})
GROUP BY cluster, pos) GROUP BY cluster)"""
    return f"(SELECT o.cid, coalesce(n.c, o.c) AS c FROM {centers_rel} o LEFT JOIN {means} n USING (cid))"


def _unrolled(n: int) -> tuple[str, str]:
    ctes = [f"c0 AS {CENTERS0}"]
    for i in range(1, n + 1):
        ctes.append(f"c{i} AS {_step_sql(f'c{i - 1}')}")
    return ", ".join(ctes), f"c{n}"


def _centers_long_sql(rel: str) -> str:
    return f"SELECT cid AS center_id, unnest(range(len(c)))::BIGINT AS pos, unnest([{rs('x')} for x in c]) AS value FROM {rel}"


def centers_long(c: DataFrame) -> DataFrame:
    return long_vec(c.select(F.col("center_id").cast("int"), "center"), "center_id", "center")


@register("nearest_center", f"WITH c0 AS {CENTERS0} SELECT id, cluster, {rs('sqdist')} AS sqdist FROM {_assign_sql('c0')}")
def q_nearest_center(spark, d):
    nc = LA.nearest_center(points(spark, d).select("id", "features"), lowest_centers(spark, d))
    return nc.select("id", "cluster", R("sqdist").alias("sqdist"))


@register("total_cost", f"WITH c0 AS {CENTERS0} SELECT {rs('sum(sqdist)', 4)} AS cost FROM {_assign_sql('c0')}")
def q_total_cost(spark, d):
    return KM.total_cost(points(spark, d), lowest_centers(spark, d)).select(V.round_stable("cost", 4).alias("cost"))


@register("cluster_sizes", f"WITH c0 AS {CENTERS0} SELECT cluster, count(*)::BIGINT AS size FROM {_assign_sql('c0')} GROUP BY cluster")
def q_cluster_sizes(spark, d):
    return KM.cluster_sizes(KM.kmeans_predict(points(spark, d), lowest_centers(spark, d)))


_C1, _C1N = _unrolled(1)
_CN, _CNN = _unrolled(N_ITER)


@register("lloyd_step", f"WITH {_C1} {_centers_long_sql(_C1N)}")
def q_lloyd_step(spark, d):
    return centers_long(KM.lloyd_step(points(spark, d), lowest_centers(spark, d), method="sql"))


@register("kmeans_fit_fixed", f"WITH {_CN} {_centers_long_sql(_CNN)}")
def q_kmeans_fit_fixed(spark, d):
    return centers_long(KM.kmeans_fit_fixed(points(spark, d), lowest_centers(spark, d), N_ITER))


@register("kmeans_fit_sql", ORACLES["kmeans_fit_fixed"])
def q_kmeans_fit_sql(spark, d):
    return centers_long(KM.kmeans_fit_fixed(points(spark, d), lowest_centers(spark, d), N_ITER, method="sql"))


@register("kmeans_from_model", ORACLES["kmeans_fit_fixed"])
def q_kmeans_from_model(spark, d):
    # warm start; eps = 0 stops early only at an exact fixed point, which equals further steps
    return centers_long(KM.kmeans_from_model(points(spark, d), lowest_centers(spark, d), K_CENTERS,
                                             max_iter=N_ITER, eps=0.0))


def _trace_sql(n: int) -> str:
    ctes, _ = _unrolled(n - 1)
    parts = [f"SELECT {i}::INTEGER AS iteration, {rs('sum(sqdist)', 4)} AS cost FROM {_assign_sql(f'c{i}')}"
             for i in range(n)]
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


@register("kmeans_trace", _trace_sql(N_ITER))
def q_kmeans_trace(spark, d):
    t = KM.kmeans_trace(points(spark, d), lowest_centers(spark, d), N_ITER)
    return t.select("iteration", V.round_stable("cost", 4).alias("cost"))


@register("kmeans_predict", f"WITH {_CN} SELECT id, cluster FROM {_assign_sql(_CNN)}")
def q_kmeans_predict(spark, d):
    pts = points(spark, d)
    c = KM.kmeans_fit_fixed(pts, lowest_centers(spark, d), N_ITER)
    return KM.kmeans_predict(pts, c).select("id", "cluster")


@register("kmeans_cost", f"WITH {_CN} SELECT {rs('sum(sqdist)', 4)} AS cost FROM {_assign_sql(_CNN)}")
def q_kmeans_cost(spark, d):
    pts = points(spark, d)
    c = KM.kmeans_fit_fixed(pts, lowest_centers(spark, d), N_ITER)
    return KM.kmeans_cost(pts, c).select(V.round_stable("cost", 4).alias("cost"))


def _rows(spark, d) -> DataFrame:
    """points with contiguous row numbers in vec_id order (row layout input)."""
    return L.row_index(points(spark, d), "id", "row")


@register("kmeans_fit_columns", ORACLES["kmeans_fit_fixed"])
def q_kmeans_fit_columns(spark, d):
    cols = L.transpose(_rows(spark, d), block_rows=128)
    return centers_long(KM.kmeans_fit_columns(cols, lowest_centers(spark, d), N_ITER))


@register("kmeans_fit_blocks", ORACLES["kmeans_fit_fixed"])
def q_kmeans_fit_blocks(spark, d):
    blocks = L.pack_flat(_rows(spark, d), block_rows=128)
    return centers_long(KM.kmeans_fit_blocks(blocks, lowest_centers(spark, d), N_ITER))


def _centers_values_sql(rel: str) -> str:
    return f"SELECT cid::INTEGER AS center_id, unnest(range(len(c)))::BIGINT AS pos, unnest([{rs('x')} for x in c]) AS value FROM {rel}"


_EPS, _FIT_ITER, _STEPS = 1e-4, 20, 2


def _random_ctes(seed: int) -> tuple[list[str], str]:
    return Q.random_centers("p", K_CENTERS, seed)


def _parallel_ctes(seed: int) -> tuple[list[str], str]:
    return Q.parallel_centers("p", K_CENTERS, _STEPS, seed)


def _start_sql(start, seed: int) -> str:
    ctes, rel = start(seed)
    return "WITH " + ", ".join([f"p AS MATERIALIZED (SELECT id, f FROM {PTS})", *ctes]) + " " + _centers_values_sql(rel)


def _fit_sql(start, seed: int) -> str:
    ctes, rel = start(seed)
    more, last = Q.lloyd_until("p", rel, _FIT_ITER, _EPS)
    return "WITH " + ", ".join([f"p AS MATERIALIZED (SELECT id, f FROM {PTS})", *ctes, *more]) + " " + _centers_values_sql(last)


@register("kmeans_fit", _fit_sql(_parallel_ctes, 7))
def q_kmeans_fit(spark, d):
    c = KM.kmeans_fit(points(spark, d), k=K_CENTERS, max_iter=_FIT_ITER, init="k-means||", seed=7)
    return centers_long(c)


@register("kmeans_fit_random", _fit_sql(_random_ctes, 7))
def q_kmeans_fit_random(spark, d):
    return centers_long(KM.kmeans_fit(points(spark, d), k=K_CENTERS, max_iter=_FIT_ITER, init="random", seed=7))


@register("kmeans_fit_ml")
def q_kmeans_fit_ml(spark, d):
    return centers_long(KM.kmeans_fit_ml(points(spark, d), k=K_CENTERS, max_iter=20, seed=7))


@register("kmeans_init_random", _start_sql(_random_ctes, 3))
def q_kmeans_init_random(spark, d):
    return centers_long(KM.kmeans_init_random(points(spark, d), K_CENTERS, seed=3))


@register("kmeans_init_parallel", _start_sql(_parallel_ctes, 3))
def q_kmeans_init_parallel(spark, d):
    return centers_long(KM.kmeans_init_parallel(points(spark, d), K_CENTERS, steps=_STEPS, seed=3))


def _candidates_sql(seed: int) -> str:
    ctes, rel = Q.parallel_candidates("p", K_CENTERS, _STEPS, seed)
    return "WITH " + ", ".join([f"p AS MATERIALIZED (SELECT id, f FROM {PTS})", *ctes]) + " " + _centers_values_sql(rel)


@register("kmeans_candidates", _candidates_sql(3))
def q_kmeans_candidates(spark, d):
    return centers_long(KM.parallel_candidates(points(spark, d), K_CENTERS, steps=_STEPS, seed=3))


def _reduce_sql(seed: int) -> str:
    ctes, rel = Q.reduced_centers("q", K_CENTERS, seed, KM.REDUCE_STEPS)
    weighed = f"q AS MATERIALIZED (SELECT id AS cid, f AS c, (1 + label)::DOUBLE AS w FROM {PTS})"
    return "WITH " + ", ".join([weighed, *ctes]) + " " + _centers_values_sql(rel)


@register("kmeans_reduce_candidates", _reduce_sql(5))
def q_kmeans_reduce_candidates(spark, d):
    """Every point is a candidate, weighted by its label."""
    p = points(spark, d)
    cands = p.select(F.col("id").alias("center_id"), F.col("features").alias("center"))
    weights = p.select(F.col("id").alias("cluster"), (F.col("label") + 1).alias("size"))
    return centers_long(KM.kmeans_reduce_candidates(cands, weights, K_CENTERS, seed=5))


@register("gram_matrix", f"""SELECT a.pos::BIGINT AS i, b.pos::BIGINT AS j, {rs('sum(a.x * b.x)', 4)} AS v
FROM {PTS_LONG} a JOIN {PTS_LONG} b USING (id) GROUP BY a.pos, b.pos""")
def q_gram_matrix(spark, d):
    g = LA.gram_matrix(points(spark, d))
    return g.select("i", "j", V.round_stable("v", 4).alias("v"))


# matrices: A = embeddings as (vec_id, pos, value); B = A^T restricted to... the whole table
_A_SQL = f"(SELECT id AS i, pos AS j, x AS v FROM {PTS_LONG})"


def coo(spark, d) -> DataFrame:
    return points(spark, d).select(F.col("id").alias("i"), F.posexplode("features").alias("j", "v")).select(
        "i", F.col("j").cast("long"), "v")


@register("matvec", f"""WITH a AS {_A_SQL}, x AS (SELECT j AS i, (j % 5) - 2.0 AS v FROM range(64) t(j)),
y AS (SELECT id AS i, label::DOUBLE AS v FROM {PTS}),
ax AS (SELECT a.i, 2.0 * sum(a.v * x.v) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i)
SELECT coalesce(ax.i, y.i) AS i, {rs('coalesce(ax.v, 0) + coalesce(0.5 * y.v, 0)')} AS v FROM ax FULL OUTER JOIN y ON ax.i = y.i""")
def q_matvec(spark, d):
    a = coo(spark, d)
    x = a.select(F.col("j").alias("i")).distinct().select("i", ((F.col("i") % 5) - 2.0).alias("v"))
    y = points(spark, d).select(F.col("id").alias("i"), F.col("label").cast("double").alias("v"))
    r = LA.matvec(a, x, alpha=2.0, beta=0.5, y=y, n_cols=64)
    return r.select("i", R("v").alias("v"))


@register("matmul", f"""WITH a AS {_A_SQL}
SELECT a.j AS i, b.j AS j, {rs('sum(a.v * b.v)', 4)} AS v FROM a JOIN a b ON a.i = b.i GROUP BY a.j, b.j""")
def q_matmul(spark, d):
    a = coo(spark, d)
    r = LA.matmul(LA.transpose_coo(a), a)  # A^T A: the Gram matrix through the generic product
    return r.select("i", "j", V.round_stable("v", 4).alias("v"))


@register("matrix_add", f"""WITH a AS {_A_SQL}
SELECT i, j, {rs('sum(v)')} AS v FROM (SELECT i, j, 3.0 * v AS v FROM a UNION ALL SELECT j AS i, i AS j, v FROM a) GROUP BY i, j""")
def q_matrix_add(spark, d):
    a = coo(spark, d)
    r = LA.matrix_add(a, LA.transpose_coo(a), 3.0)
    return r.select("i", "j", R("v").alias("v"))


# ============================================================================= LAYOUT

@register("row_index", f"SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS row FROM {PTS}")
def q_row_index(spark, d):
    return L.row_index(points(spark, d).select("id"), "id", "row")


_ROWS_LONG = (f"(SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS row, id, f FROM {PTS})")


@register("transpose", f"SELECT unnest(range(len(f)))::BIGINT AS dim, row, unnest(f) AS value FROM {_ROWS_LONG}")
def q_transpose(spark, d):
    t = L.transpose(_rows(spark, d), block_rows=128)
    ex = t.select("dim", "first_row", F.posexplode("values").alias("k", "value"))
    return ex.select(F.col("dim").cast("long"), (F.col("first_row") + F.col("k")).cast("long").alias("row"), "value")


@register("untranspose", f"SELECT row, unnest(range(len(f)))::BIGINT AS pos, unnest(f) AS value FROM {_ROWS_LONG}")
def q_untranspose(spark, d):
    back = L.untranspose(L.transpose(_rows(spark, d), block_rows=128))
    return long_vec(back, "row", "features", round_values=False)


@register("pack_columns", f"""SELECT row, unnest(range(len(f)))::BIGINT AS pos, unnest(f) AS value,
{rs('sqrt(list_sum([x * x for x in f]))')} AS norm FROM {_ROWS_LONG}""")
def q_pack_columns(spark, d):
    b = L.pack_columns(_rows(spark, d), block_rows=128)
    per_row = b.select("first_row", "cols", F.posexplode("norms").alias("k", "norm"))
    ex = per_row.select((F.col("first_row") + F.col("k")).alias("row"), "norm", "k",
                        F.posexplode("cols").alias("pos", "col"))
    return ex.select(F.col("row").cast("long"), F.col("pos").cast("long"),
                     F.get("col", F.col("k")).alias("value"), R("norm").alias("norm"))


@register("pack_flat", ORACLES["untranspose"])
def q_pack_flat(spark, d):
    b = L.pack_flat(_rows(spark, d), block_rows=128)
    ex = b.select("first_row", "dim", F.posexplode("flat").alias("k", "value"))
    return ex.select((F.col("first_row") + F.floor(F.col("k") / F.col("dim"))).cast("long").alias("row"),
                     F.pmod(F.col("k"), F.col("dim")).cast("long").alias("pos"), "value")


@register("unpack_blocks", ORACLES["untranspose"])
def q_unpack_blocks(spark, d):
    back = L.unpack_blocks(L.pack_flat(_rows(spark, d), block_rows=128))
    return long_vec(back, "row", "features", round_values=False)


@register("unpack_columns", ORACLES["untranspose"])
def q_unpack_columns(spark, d):
    back = L.unpack_blocks(L.pack_columns(_rows(spark, d), block_rows=128))
    return long_vec(back, "row", "features", round_values=False)


@register("zip_columns", f"""SELECT a.row, a.id AS a_id, b.id AS b_id FROM
(SELECT (row_number() OVER (ORDER BY id) - 1) AS row, id FROM {PTS}) a JOIN
(SELECT (row_number() OVER (ORDER BY id DESC) - 1) AS row, id FROM {PTS}) b USING (row)""")
def q_zip_columns(spark, d):
    p = points(spark, d).select("id")
    a = p.select(F.col("id").alias("a_id"))
    b = p.select(F.col("id").alias("b_id"), (-F.col("id")).alias("neg"))
    z = L.zip_columns(a, b, "a_id", "neg")
    z2 = L.row_index(z.select("a_id", "b_id"), "a_id", "row")
    return z2.select(F.col("row").cast("long"), "a_id", "b_id")


@register("rows_by_index", f"SELECT row, id FROM (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS row, id, label FROM {PTS}) WHERE label = 3")
def q_rows_by_index(spark, d):
    rows = _rows(spark, d)
    idx = rows.filter(F.col("label") == 3).select("row")
    return L.rows_by_index(rows, idx).select("row", "id")


@register("sort_edges", f"SELECT src, dst, (row_number() OVER (ORDER BY src, dst) - 1)::BIGINT AS k FROM {EDGES}")
def q_sort_edges(spark, d):
    e = L.sort_edges(edges(spark, d))
    return L.row_index(e, ["src", "dst"], "k").select("src", "dst", F.col("k").cast("long"))


# ============================================================================= GRAPH

@register("read_edge_list", f"SELECT src, dst, 1 AS attr FROM {EDGES}")
def q_read_edge_list(spark, d):
    e = edges(spark, d)
    # "src dst weight" lines plus a comment line per source with a single edge
    lines = e.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"),
                                 F.lit("1")).alias("value"))
    comments = e.groupBy("src").count().filter(F.col("count") == 1).select(
        F.concat(F.lit("# source "), F.col("src").cast("string")).alias("value"))
    return TF.parse_edge_lines(lines.unionByName(comments))


@register("edges_canonical", f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM {EDGES}")
def q_edges_canonical(spark, d):
    return G.edges_canonical(edges(spark, d))


@register("graph_from_edges", f"SELECT id, 1 AS attr FROM {VERTS}")
def q_graph_from_edges(spark, d):
    return G.graph_from_edges(edges(spark, d))


@register("out_degrees", f"SELECT src, count(*)::BIGINT AS out_degree FROM {EDGES} GROUP BY src")
def q_out_degrees(spark, d):
    return G.out_degrees(edges(spark, d))


@register("vertex_dictionary", f"SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS local_id FROM {VERTS}")
def q_vertex_dictionary(spark, d):
    return G.vertex_dictionary(edges(spark, d))


@register("adjacency", f"""WITH a AS (SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::BIGINT AS k,
count(*) OVER (PARTITION BY src) AS degree FROM {EDGES}),
o AS (SELECT src, (sum(degree) OVER (ORDER BY src) - degree)::BIGINT AS "offset" FROM (SELECT DISTINCT src, degree FROM a))
SELECT a.src, 0 AS chunk, a.k, a.dst, a.degree::BIGINT AS degree, o."offset" FROM a JOIN o USING (src)""")
def q_adjacency(spark, d):
    a = G.adjacency(edges(spark, d))
    ex = a.select("src", "chunk", "degree", "offset", F.posexplode("dsts").alias("k", "dst"))
    return ex.select("src", "chunk", F.col("k").cast("long"), "dst", "degree", "offset")


_HUB_CHUNK = 4096


@register("adjacency_hub", f"""WITH a AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k,
row_number() OVER (ORDER BY src, dst) - 1 AS g FROM {HUB_EDGES}),
c AS (SELECT src, (k // {_HUB_CHUNK})::INTEGER AS chunk, (k % {_HUB_CHUNK})::BIGINT AS k, dst, min(g) OVER (PARTITION BY src) AS base FROM a),
o AS (SELECT src, chunk, count(*)::BIGINT AS degree, (min(base) + chunk * {_HUB_CHUNK})::BIGINT AS "offset" FROM c GROUP BY src, chunk)
SELECT c.src, c.chunk, c.k, c.dst, o.degree, o."offset" FROM c JOIN o USING (src, chunk)""")
def q_adjacency_hub(spark, d):
    a = G.adjacency(hub_edges(spark, d), max_chunk=_HUB_CHUNK)
    ex = a.select("src", "chunk", "degree", "offset", F.posexplode("dsts").alias("k", "dst"))
    return ex.select("src", "chunk", F.col("k").cast("long"), "dst", "degree", "offset")


_VDEG = f"(SELECT v.id, coalesce(o.n, 0)::BIGINT AS attr FROM {VERTS} v LEFT JOIN (SELECT src, count(*) AS n FROM {EDGES} GROUP BY src) o ON v.id = o.src)"


def _vdeg(spark, d) -> DataFrame:
    e = edges(spark, d)
    v = G.graph_from_edges(e).select("id")
    return v.join(G.out_degrees(e).withColumnRenamed("src", "id"), "id", "left").select(
        "id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("attr"))


@register("triplets", f"""SELECT e.src, e.dst, 1 AS attr, s.attr AS src_attr, t.attr AS dst_attr
FROM {EDGES} e JOIN {_VDEG} s ON e.src = s.id JOIN {_VDEG} t ON e.dst = t.id""")
def q_triplets(spark, d):
    e = edges(spark, d).withColumn("attr", F.lit(1))
    return G.triplets(e, _vdeg(spark, d)).select("src", "dst", "attr", "src_attr", "dst_attr")


@register("triplets_hub", f"""SELECT e.src, e.dst, (s.id % 7)::BIGINT AS src_attr, (t.id % 7)::BIGINT AS dst_attr FROM {HUB_EDGES} e
JOIN (SELECT src AS id FROM {HUB_EDGES} UNION SELECT dst FROM {HUB_EDGES}) s ON e.src = s.id JOIN {VERTS} t ON e.dst = t.id""")
def q_triplets_hub(spark, d):
    e = hub_edges(spark, d)
    v = G.map_vertices(G.graph_from_edges(e), (F.col("id") % 7).cast("long"))
    return G.triplets(e, v, threshold=5000).select("src", "dst", "src_attr", "dst_attr")


@register("aggregate_messages", f"""SELECT e.dst AS id, sum(s.attr)::BIGINT AS msg FROM {EDGES} e JOIN {_VDEG} s ON e.src = s.id
JOIN {_VDEG} t ON e.dst = t.id WHERE s.attr > t.attr GROUP BY e.dst""")
def q_aggregate_messages(spark, d):
    t = G.triplets(edges(spark, d), _vdeg(spark, d))
    m = G.aggregate_messages(t, F.col("src_attr"), "sum", when=F.col("src_attr") > F.col("dst_attr"))
    return m.select("id", F.col("msg").cast("long"))


@register("map_vertices", f"SELECT id, (id % 7)::BIGINT AS attr FROM {VERTS}")
def q_map_vertices(spark, d):
    return G.map_vertices(G.graph_from_edges(edges(spark, d)), (F.col("id") % 7).cast("long"))


_BFS_SQL = f"""WITH RECURSIVE v AS {VERTS}, e AS {EDGES},
r(id, d) AS (SELECT id, 0 FROM v WHERE id = {ROOT} UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id WHERE r.d < 2000)
SELECT v.id, coalesce(min(r.d)::DOUBLE, 'inf'::DOUBLE) AS dist FROM v LEFT JOIN r USING (id) GROUP BY v.id"""


@register("bfs", _BFS_SQL)
def q_bfs(spark, d):
    return GP.bfs(edges(spark, d), ROOT)


@register("bfs_pregel", _BFS_SQL)
def q_bfs_pregel(spark, d):
    return GP.bfs_pregel(edges(spark, d), ROOT)


@register("bfs_hub", f"""WITH RECURSIVE e AS {HUB_EDGES}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r(id, d) AS (SELECT id, 0 FROM v WHERE id = -1 UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id WHERE r.d < 2000)
SELECT v.id, coalesce(min(r.d)::DOUBLE, 'inf'::DOUBLE) AS dist FROM v LEFT JOIN r USING (id) GROUP BY v.id""")
def q_bfs_hub(spark, d):
    return GP.bfs(hub_edges(spark, d), -1, partitions=8)


_BOTH_WAYS = f"(SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES})"


@register("connected_components", f"""WITH RECURSIVE e AS MATERIALIZED {_BOTH_WAYS},
r(id, c) USING KEY (id) AS (SELECT id, id FROM {VERTS}
UNION SELECT e.dst, min(r.c) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS now ON now.id = e.dst WHERE r.c < now.c GROUP BY e.dst)
SELECT id, c AS component FROM r""")
def q_connected_components(spark, d):
    return GP.connected_components(edges(spark, d))


_WEIGHTED = "(SELECT l_orderkey AS src, l_partkey AS dst, l_quantity::DOUBLE AS w FROM lineitem)"


@register("shortest_paths", f"""WITH RECURSIVE e AS MATERIALIZED {_WEIGHTED},
r(id, d) USING KEY (id) AS (SELECT id, CASE WHEN id = {ROOT} THEN 0.0 ELSE 'inf'::DOUBLE END FROM {VERTS}
UNION SELECT e.dst, min(r.d + e.w) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS now ON now.id = e.dst WHERE r.d + e.w < now.d GROUP BY e.dst)
SELECT id, d AS dist FROM r""")
def q_shortest_paths(spark, d):
    return GP.shortest_paths(weighted_edges(spark, d), ROOT)


def _pagerank_sql(n: int, reset: float = 0.15, edges_sql: str = EDGES) -> str:
    ctes = [f"e AS {edges_sql}", "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)",
            "od AS (SELECT src, count(*) AS n FROM e GROUP BY src)",
            "r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    for i in range(1, n + 1):
        ctes.append(f"""r{i} AS (SELECT v.id, {reset} + {1 - reset} * coalesce(s.s, 0.0) AS rank FROM v LEFT JOIN
(SELECT e.dst, sum(r.rank / od.n) AS s FROM e JOIN r{i - 1} r ON e.src = r.id JOIN od ON od.src = e.src GROUP BY e.dst) s
ON v.id = s.dst)""")
    return "WITH " + ", ".join(ctes) + f" SELECT id, {rs('rank')} AS rank FROM r{n}"


@register("static_pagerank", _pagerank_sql(PR_ITER))
def q_static_pagerank(spark, d):
    return GP.static_pagerank(edges(spark, d), PR_ITER).select("id", R("rank").alias("rank"))


@register("static_pagerank_hub", _pagerank_sql(PR_ITER, edges_sql=HUB_EDGES))
def q_static_pagerank_hub(spark, d):
    return GP.static_pagerank(hub_edges(spark, d), PR_ITER, partitions=8).select("id", R("rank").alias("rank"))


@register("label_vertices", _pagerank_sql(PR_ITER).replace(
    f" SELECT id, {rs('rank')} AS rank FROM r{PR_ITER}",
    f" SELECT r.id, {rs('r.rank')} AS rank, p.p_name FROM r{PR_ITER} r JOIN part p ON p.p_partkey = r.id"))
def q_label_vertices(spark, d):
    ranks = GP.static_pagerank(edges(spark, d), PR_ITER).select("id", R("rank").alias("rank"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return G.label_vertices(ranks, names)


# ============================================================================= SOURCES (parsers on derived lines)

@register("read_points", f"SELECT id, unnest(range(len(f)))::BIGINT AS pos, unnest(f) AS value FROM {PTS}")
def q_read_points(spark, d):
    p = points(spark, d)
    lines = TF.format_point_lines(p.select("id", "features"), sep=", ", keep=["id"])
    return long_vec(TF.parse_point_lines(lines, sep=r",\s*", keep=["id"]), "id", "features", round_values=False)


@register("read_points_by_column", ORACLES["untranspose"])
def q_read_points_by_column(spark, d):
    # one column file per row block: line `dim` of block b holds that dimension of the block's rows
    cols = L.transpose(_rows(spark, d), block_rows=128)
    lines = cols.select("block_id", "first_row", "dim",
                        F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value"))
    pts = TF.parse_column_lines(lines, keep=["block_id", "first_row"])
    out = pts.select((F.col("first_row") + F.col("row")).cast("long").alias("row"), "features")
    return long_vec(out, "row", "features", round_values=False)


@register("read_edge_list_file", f"SELECT src, dst, 1 AS attr FROM {EDGES}")
def q_read_edge_list_file(spark, d):
    path = shared_path(spark, "edges")
    TF.format_edge_lines(edges(spark, d)).write.text(path)
    return TF.read_edge_list(spark, path)


@register("read_points_file", f"SELECT pos::BIGINT AS pos, x AS value, count(*)::BIGINT AS n FROM {PTS_LONG} GROUP BY pos, x")
def q_read_points_file(spark, d):
    path = shared_path(spark, "points")
    TF.format_point_lines(points(spark, d)).write.text(path)
    got = TF.read_points(spark, path).select(F.posexplode("features").alias("pos", "value"))
    return got.groupBy(F.col("pos").cast("long").alias("pos"), "value").agg(F.count(F.lit(1)).alias("n"))


@register("read_points_by_column_file", ORACLES["untranspose"])
def q_read_points_by_column_file(spark, d):
    """A real file: one line for each dimension, all points long."""
    cols = L.transpose(_rows(spark, d), block_rows=1 << 40)
    lines = cols.select("dim", F.array_join(F.transform("values", lambda x: x.cast("string")), " ").alias("value"))
    path = shared_path(spark, "columns")
    lines.repartitionByRange(1, "dim").sortWithinPartitions("dim").select("value").write.text(path)
    return long_vec(TF.read_points_by_column(spark, path, block_rows=100), "row", "features", round_values=False)


def _sparse_long_keyed(parsed: DataFrame, key: str, extra=()) -> DataFrame:
    ex = parsed.select(key, *extra, F.col("features.size").cast("long").alias("size"),
                       F.posexplode(F.arrays_zip(F.col("features.indices").alias("i"),
                                                 F.col("features.values").alias("v"))).alias("k", "p"))
    return ex.select(key, *extra, "size", F.col("k").cast("long"), F.col("p.i").cast("long").alias("idx"),
                     F.col("p.v").alias("value"))


_LIBSVM_SQL = f"""SELECT id, label::DOUBLE AS label, 64::BIGINT AS size,
(row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::BIGINT AS k, pos::BIGINT AS idx, x AS value FROM {SP_LONG}"""


@register("read_libsvm", _LIBSVM_SQL)
def q_read_libsvm(spark, d):
    sp = sparse_points(spark, d)
    lines = TF.format_libsvm_lines(sp, keep=["id"])
    return _sparse_long_keyed(TF.parse_libsvm_lines(lines, num_features=64, keep=["id"]), "id", ["label"])


@register("infer_num_features", f"SELECT max(pos)::BIGINT + 1 AS num_features FROM {SP_LONG}")
def q_infer_num_features(spark, d):
    return TF.infer_num_features(sparse_points(spark, d)).select(F.col("num_features").cast("long"))


@register("write_libsvm", f"SELECT label::DOUBLE AS label, pos::BIGINT AS idx, x AS value, count(*)::BIGINT AS n FROM {SP_LONG} GROUP BY ALL")
def q_write_libsvm(spark, d):
    path = shared_path(spark, "libsvm")
    TF.write_libsvm(sparse_points(spark, d), path)
    got = TF.read_libsvm(spark, path)
    pairs = F.arrays_zip(F.col("features.indices").alias("idx"), F.col("features.values").alias("value"))
    return got.select("label", F.inline(pairs)).groupBy("label", F.col("idx").cast("long").alias("idx"), "value").agg(F.count(F.lit(1)).alias("n"))


_VEC_SQL = f"""SELECT id, 0::BIGINT AS type, 64::BIGINT AS size,
(row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::BIGINT AS k, pos::BIGINT AS idx, x AS value FROM {SP_LONG}
UNION ALL SELECT id + 1000000000, 1::BIGINT, 64::BIGINT, pos::BIGINT, pos::BIGINT, x FROM {PTS_LONG}"""


def _vector_rows(spark, d) -> DataFrame:
    """Both vector kinds in one VectorUDT-shaped column: sparse rows keep their id, dense rows id + 1e9."""
    sp = sparse_points(spark, d).select("id", TF.sparse_vector("features").alias("v"))
    dn = points(spark, d).select((F.col("id") + 1000000000).alias("id"), TF.dense_vector("features").alias("v"))
    return sp.unionByName(dn)


def _vector_long(df: DataFrame, extra=()) -> DataFrame:
    v = F.col("v")
    idx = F.when(v["type"] == 1, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(v["indices"])
    size = F.when(v["type"] == 1, F.size(v["values"])).otherwise(v["size"])
    ex = df.select("id", *extra, v["type"].cast("long").alias("type"), size.cast("long").alias("size"),
                   F.posexplode(F.arrays_zip(idx.alias("i"), v["values"].alias("x"))).alias("k", "p"))
    return ex.select("id", *extra, "type", "size", F.col("k").cast("long"), F.col("p.i").cast("long").alias("idx"),
                     F.col("p.x").alias("value"))


@register("read_vectors", _VEC_SQL)
def q_read_vectors(spark, d):
    rows = _vector_rows(spark, d)
    lines = rows.select("id", TF.format_vector_text("v").alias("value"))
    return _vector_long(lines.select("id", TF.parse_vector_text("value").alias("v")))


@register("read_vectors_json", _VEC_SQL)
def q_read_vectors_json(spark, d):
    rows = _vector_rows(spark, d)
    lines = rows.select("id", TF.format_vector_json("v").alias("value"))
    return _vector_long(lines.select("id", TF.parse_vector_json("value").alias("v")))


_VEC_COUNTS = f"SELECT type, size, k, idx, value, count(*)::BIGINT AS n FROM ({_VEC_SQL}) GROUP BY ALL"


def _vector_counts(read: DataFrame) -> DataFrame:
    long = _vector_long(read.select(F.lit(0).alias("id"), F.col("features").alias("v")))
    return long.groupBy("type", "size", "k", "idx", "value").agg(F.count(F.lit(1)).alias("n"))


@register("write_vectors", _VEC_COUNTS)
def q_write_vectors(spark, d):
    path = shared_path(spark, "vectors")
    TF.write_vectors(_vector_rows(spark, d), path, "v")
    return _vector_counts(TF.read_vectors(spark, path))


@register("write_vectors_json", _VEC_COUNTS)
def q_write_vectors_json(spark, d):
    path = shared_path(spark, "vectors-json")
    TF.write_vectors_json(_vector_rows(spark, d), path, "v")
    return _vector_counts(TF.read_vectors_json(spark, path))


@register("save_load_clusters", f"SELECT cid AS center_id, unnest(range(len(c)))::BIGINT AS pos, unnest(c) AS value FROM {CENTERS0}")
def q_save_load_clusters(spark, d):
    path = shared_path(spark, "clusters")
    FI.save_clusters(lowest_centers(spark, d), path)
    return long_vec(FI.load_clusters(spark, path), "center_id", "center", round_values=False)


@register("read_documents", "SELECT doc_id, text || chr(10) AS text FROM documents WHERE text IS NOT NULL")
def q_read_documents(spark, d):
    """Each document as a file of its own, in a folder named after its id, read back whole."""
    path = shared_path(spark, "documents")
    FI.write_documents(docs(spark, d), path)
    got = FI.read_documents(spark, path, nested=True)
    return got.select(F.regexp_extract("path", r"doc_id=(-?\d+)", 1).cast("long").alias("doc_id"), "text")


@register("repair_utf8", "SELECT doc_id, text || chr(65533) || 'x' || chr(65533) || text AS text FROM documents")
def q_repair_utf8(spark, d):
    """Texts with a byte that starts nothing and one that ends nothing between two copies."""
    raw = F.encode("text", "utf-8")
    broken = docs(spark, d).select("doc_id", F.concat(raw, F.unhex(F.lit("FF78A0")), raw).alias("text"))
    return FI.repair_utf8(broken, "text")


@register("read_labeled_points", f"""SELECT id, label::DOUBLE AS label, 0::BIGINT AS type, 64::BIGINT AS size,
(row_number() OVER (PARTITION BY id ORDER BY pos) - 1)::BIGINT AS k, pos::BIGINT AS idx, x AS value FROM {SP_LONG}""")
def q_read_labeled_points(spark, d):
    sp = sparse_points(spark, d)
    lines = sp.select("id", TF.format_labeled_point("label", TF.sparse_vector("features")).alias("value"))
    parsed = lines.select("id", TF.parse_labeled_point("value").alias("p")).select(
        "id", "p.label", F.col("p.features").alias("v"))
    return _vector_long(parsed, ["label"])


# ============================================================================= SAMPLING / SPLITS

@register("k_fold", f"SELECT id, ((id * 7919) % 5)::INTEGER AS fold FROM {PTS}")
def q_k_fold(spark, d):
    return S.fold_by_id(points(spark, d).select("id"), 5, "id")


@register("random_split", f"""SELECT id, CASE WHEN (id * 7919) % 10 < 7 THEN 0 ELSE 1 END AS split,
label FROM {PTS}""")
def q_random_split(spark, d):
    p = points(spark, d).select("id", "label")
    parts = S.split_by_id(p, [0.7, 0.3], "id")
    return parts[0].withColumn("split", F.lit(0)).unionByName(parts[1].withColumn("split", F.lit(1))).select(
        "id", "split", "label")


@register("random_split_hash", f"SELECT id, CASE WHEN {Q.uniform(11, 'id')} < 0.7 THEN 0 ELSE 1 END AS split FROM {PTS}")
def q_random_split_hash(spark, d):
    return S.split_label(points(spark, d).select("id"), [0.7, 0.3], seed=11, id_col="id")


@register("random_split_seeded", f"SELECT id, CASE WHEN {Q.uniform(11, 'id')} < 0.25 THEN 0 WHEN {Q.uniform(11, 'id')} < 0.75 THEN 1 ELSE 2 END AS split FROM {PTS}")
def q_random_split_seeded(spark, d):
    parts = S.random_split(points(spark, d).select("id"), [1, 2, 1], seed=11, id_col="id")
    out = parts[0].withColumn("split", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("split", F.lit(i)))
    return out


@register("k_fold_seeded", f"""SELECT f AS fold, id, CASE WHEN u >= f / 5.0 AND u < (f + 1) / 5.0 THEN 'validation' ELSE 'training' END AS part
FROM (SELECT id, {Q.uniform(13, 'id')} AS u FROM {PTS}), (SELECT unnest(range(5))::INTEGER AS f)""")
def q_k_fold_seeded(spark, d):
    out = None
    for f, pair in enumerate(S.k_fold(points(spark, d).select("id"), 5, seed=13, id_col="id")):
        for df, part in zip(pair, ("training", "validation"), strict=True):
            df = df.select(F.lit(f).alias("fold"), "id", F.lit(part).alias("part"))
            out = df if out is None else out.unionByName(df)
    return out


@register("take_sample", f"SELECT id, label FROM {PTS} ORDER BY {Q.uniform(5, 'id')}, id LIMIT 50")
def q_take_sample(spark, d):
    return KM.take_sample(points(spark, d).select("id", "label"), 50, seed=5)


@register("weighted_sample", f"""WITH c0 AS {CENTERS0}, a AS MATERIALIZED (SELECT id, sqdist FROM {_assign_sql('c0')})
SELECT id, {rs('sqdist')} AS sqdist FROM a WHERE {Q.uniform(9, 'id')} < {2 * K_CENTERS} * sqdist / (SELECT sum(sqdist) FROM a)""")
def q_weighted_sample(spark, d):
    pts = points(spark, d)
    nc = LA.nearest_center(pts.select("id", "features"), lowest_centers(spark, d))
    total = nc.agg(F.sum("sqdist")).first()[0]
    return KM.weighted_sample(nc.select("id", "sqdist"), "sqdist", K_CENTERS, total, seed=9).withColumn("sqdist", R("sqdist"))


# ============================================================================= TREE

@register("test_error", f"""SELECT {rs('avg((label <> (list_position(f, list_max(f)) - 1))::DOUBLE)')} AS test_error FROM {PTS}""")
def q_test_error(spark, d):
    p = points(spark, d)
    pred = p.select("label", V.argmax("features").cast("double").alias("prediction"))
    return TR.test_error(pred).select(R("test_error").alias("test_error"))


def _tree_sets(spark, d):
    p = points(spark, d)
    train, test = S.split_by_id(p, [0.7, 0.3], "id")
    return train, test


@register("tree_predict")
def q_tree_predict(spark, d):
    train, test = _tree_sets(spark, d)
    model = TR.tree_fit(train, num_classes=10, max_depth=5, max_bins=32)
    return TR.tree_predict(model, test).select("id", "label", "prediction")


@register("tree_test_error")
def q_tree_test_error(spark, d):
    train, test = _tree_sets(spark, d)
    model = TR.tree_fit(train, num_classes=10, max_depth=5, max_bins=32)
    return TR.test_error(TR.tree_predict(model, test))


@register("tree_quality")
def q_tree_quality(spark, d):
    """Second data set: document quality from text-length features."""
    lab = table(spark, d, "labels")
    feats = table(spark, d, "documents").select(
        "doc_id", F.array(F.col("n_chars").cast("double"), F.size(X.tokens("text")).cast("double"),
                          F.length(F.regexp_replace("text", r"[^\n]", "")).cast("double")).alias("features"))
    data = lab.join(feats, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "features")
    train, test = S.split_by_id(data, [0.7, 0.3], "id")
    model = TR.tree_fit(train, num_classes=2, max_depth=4, max_bins=32)
    return TR.tree_predict(model, test).select("id", "label", "prediction")


@register("tree_dump")
def q_tree_dump(spark, d):
    train, _ = _tree_sets(spark, d)
    model = TR.tree_fit(train, num_classes=10, max_depth=3, max_bins=32)
    lines = TR.tree_dump(model)
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
