"""Text operators: tokens, token offsets, term counts, hashing TF, IDF and TF-IDF.

Plan shape at scale
-------------------
A document is one row, so every per-document step (tokenising, counting terms, hashing) is narrow:
counts and hashes are made batch by batch through Arrow, where the documents are read.  TF-IDF writes one packed row a document (indices and counts as arrays), so
texts are tokenised once; document frequencies are aggregated from the packed rows, partially
before the shuffle and into at most ``num_features`` groups, and that bounded IDF table is
broadcast back to the packed rows.  No term-frequency row is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from strata.functions import counting as C
from strata.functions import hashing as H
from strata.functions import offsets as P
from strata.functions.text import tokens
from strata.session import cut_lineage_counted

_SPARSE = StructType([StructField("size", IntegerType()), StructField("indices", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])


def tokenize(df: DataFrame, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """Add ``tokens`` = trim(chars <= 0x20), split on whitespace, empties dropped."""
    return df.withColumn(out_col, tokens(text_col))


def tokens_long(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per token occurrence: (id, pos, term)."""
    return df.select(id_col, F.posexplode(tokens(text_col)).alias("pos", "term"))


def token_offsets(df: DataFrame, text_col: str = "text", out_col: str = "offsets") -> DataFrame:
    """Compact token layout: ``offsets`` = [start0, end0, start1, end1, ...] (0-based, end exclusive,
    in characters) such that ``tokens_from_offsets`` reproduces ``tokenize`` exactly.

    A null text has none.  Linear per document: a batch's texts are read as one run of bytes, through Arrow."""
    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        found = [P.places(b.column(0)) for b in C.text_slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(out_col, find(F.col(text_col)))


def tokens_from_offsets(df: DataFrame, text_col: str = "text", offsets_col: str = "offsets",
                        out_col: str = "tokens") -> DataFrame:
    """Offsets + text -> tokens (inverse view of ``token_offsets``).  Null offsets are none."""
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, offsets: pa.Array) -> pa.Array:
        both = pa.RecordBatch.from_arrays([texts, offsets], ["t", "o"])
        found = [P.tokens_at(b.column(1), b.column(0)) for b in C.text_slices(both, "t")]
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    return df.withColumn(out_col, cut(F.col(text_col), F.col(offsets_col)))


def term_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf bigint): exact-term frequencies per document.  Narrow: a batch of documents is
    counted where it is read, through Arrow."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.text_slices(whole, "_text"):
                row, code, n, words = C.token_counts(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.take(pa.array(code)), pa.array(n, pa.int64())], names=[id_col, "term", "tf"])

    return rows.mapInArrow(count, StructType([rows.schema[id_col], StructField("term", StringType()), StructField("tf", LongType())]))


def hash_terms(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               num_features: int = H.DEFAULT_NUM_FEATURES, algo: str = "murmur3") -> DataFrame:
    """(id, term, idx): every distinct term of each document with its feature index."""
    tc = term_counts(df, id_col, text_col)
    return tc.select(id_col, "term", H.hash_index("term", num_features, algo).alias("idx"))


def hashing_tf(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               num_features: int = H.DEFAULT_NUM_FEATURES, binary: bool = False,
               algo: str = "murmur3") -> DataFrame:
    """Long-form hashed term frequencies (id, idx int, tf double).  Colliding terms add up;
    ``binary`` sets every present index to 1.0.  Narrow: no shuffle."""
    return unpack_tf(hashing_tf_vectors(df, id_col, text_col, num_features, binary, algo), id_col)


def hashing_tf_vectors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       num_features: int = H.DEFAULT_NUM_FEATURES, binary: bool = False,
                       algo: str = "murmur3") -> DataFrame:
    """Vector form: (id, features struct<size, indices, values>) with ascending indices.  A null or
    empty text has no indices."""
    if num_features <= 0:
        raise ValueError("num_features must be positive")
    if algo not in C.HASHES:
        raise ValueError(f"algo must be one of {sorted(C.HASHES)}")
    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.text_slices(whole, "_text"):
                at, index, n = C.hashed_counts(batch.column(1), num_features, algo)
                at = pa.array(at, pa.int32())
                values = pa.array(np.ones(len(n)) if binary else n, pa.float64())
                features = pa.StructArray.from_arrays([pa.array(np.full(len(batch), num_features), pa.int32()), pa.ListArray.from_arrays(at, pa.array(index, pa.int32())),
                                                       pa.ListArray.from_arrays(at, values)], names=["size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([batch.column(0), features], names=[id_col, "features"])

    return rows.mapInArrow(count, StructType([rows.schema[id_col], StructField("features", _SPARSE)]))


def hash_collisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    num_features: int = H.DEFAULT_NUM_FEATURES, algo: str = "murmur3") -> DataFrame:
    """Indices shared by more than one distinct term: (idx, n_terms).

    Distinct terms are first reduced per document (in-row), then de-duplicated with a partial
    aggregate on (idx, term) before the count per idx."""
    ht = hash_terms(df, id_col, text_col, num_features, algo)
    return (ht.select("idx", "term").distinct()
            .groupBy("idx").agg(F.count("*").alias("n_terms"))
            .filter(F.col("n_terms") > 1))


def idf_fit(tf: DataFrame, documents: DataFrame | None = None, key_col: str = "idx",
            id_col: str = "doc_id", min_doc_freq: int = 0) -> DataFrame:
    """(key, doc_freq bigint, idf double) with idf = ln((m + 1) / (df + 1)), m = number of documents.

    ``m`` counts ``documents`` when given (documents without any token count too), else the
    distinct ids present in ``tf``.  Keys with df < ``min_doc_freq`` get idf 0.  The document
    count is a one-row aggregate joined back, so nothing is collected on the driver."""
    present = tf.filter(F.col("tf") != 0) if "tf" in tf.columns else tf
    dfreq = present.groupBy(key_col).agg(F.count("*").alias("doc_freq"))
    if documents is not None:
        m = documents.agg(F.count("*").alias("_m"))
    else:
        m = tf.select(id_col).distinct().agg(F.count("*").alias("_m"))
    return idf_values(dfreq.crossJoin(F.broadcast(m)), F.col("_m"), min_doc_freq).select(key_col, "doc_freq", "idf")


def idf_values(doc_freq: DataFrame, n_docs: Column, min_doc_freq: int = 0) -> DataFrame:
    """Adds ``idf`` = ln((m + 1) / (doc_freq + 1)), 0 below ``min_doc_freq``."""
    idf = F.log((n_docs + 1.0) / (F.col("doc_freq") + 1.0))
    return doc_freq.withColumn("idf", F.when(F.col("doc_freq") >= min_doc_freq, idf).otherwise(F.lit(0.0)))


def tfidf(tf: DataFrame, idf: DataFrame, key_col: str = "idx", num_features: int | None = None) -> DataFrame:
    """(id, key, tf, idf, tfidf).  Every tf row is kept (a zero idf gives an explicit zero).

    ``num_features`` says that keys are hashed: the IDF table then has at most that many rows, as
    a fitted model has, and is broadcast.  For exact terms (unbounded vocabulary) the join is left
    to the planner, which AQE turns into a broadcast only after measuring the side."""
    side = idf.select(key_col, "idf")
    joined = tf.join(side if num_features is None else F.broadcast(side), key_col, "left")
    return joined.withColumn("idf", F.coalesce("idf", F.lit(0.0))).withColumn("tfidf", F.col("tf") * F.col("idf"))


def unpack_tf(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Long form (id, idx, tf) of packed term frequencies."""
    pairs = F.arrays_zip(F.col("features.indices").alias("idx"), F.col("features.values").alias("tf"))
    return packed.select(id_col, F.inline(pairs))


def tfidf_job(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              num_features: int = H.DEFAULT_NUM_FEATURES, algo: str = "murmur3",
              min_doc_freq: int = 0) -> DataFrame:
    """End-to-end TF-IDF over a documents table (long form).

    The packed term frequencies are written once to the shared checkpoint folder and read twice:
    their indices alone for the document frequencies, and whole for the product."""
    packed, n_docs = cut_lineage_counted(hashing_tf_vectors(documents.select(id_col, text_col), id_col, text_col, num_features, algo=algo))
    counted = packed.select(F.explode("features.indices").alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("doc_freq"))
    return tfidf(unpack_tf(packed, id_col), idf_values(counted, F.lit(n_docs), min_doc_freq), "idx", num_features)
