"""The library's operators on Structured Streaming sources.

The original jobs are batch only; nothing here adds new semantics.  Row-local operators
(tokenising, hashing TF, nearest-center assignment) are narrow and run unchanged on a
streaming DataFrame; the one aggregate, document frequency for IDF, becomes a running
streaming aggregation whose state is one row per feature index (at most ``num_features``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import hashing as H
from strata.functions.nearest import Centers, nearest_column
from strata.operators import text as X

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_document_stream(spark: SparkSession, directory: str, file_glob: str = "*.parquet",
                         schema: str = DOCUMENT_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in ``directory`` as a stream of documents."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def stream_hashing_tf(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      num_features: int = H.DEFAULT_NUM_FEATURES, algo: str = "murmur3") -> DataFrame:
    """Per-document hashed term frequencies for each arriving document (append mode)."""
    return X.hashing_tf(stream.select(id_col, text_col), id_col, text_col, num_features, algo=algo)


def stream_document_frequency(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                              num_features: int = H.DEFAULT_NUM_FEATURES, algo: str = "murmur3") -> DataFrame:
    """Running (idx, doc_freq) over all documents seen so far (update / complete mode)."""
    tf = stream_hashing_tf(stream, id_col, text_col, num_features, algo)
    return tf.groupBy("idx").agg(F.count("*").alias("doc_freq"))


def stream_assign(stream: DataFrame, centers: list[tuple[int, list[float]]], col: str = "features") -> DataFrame:
    """Nearest-center assignment of arriving points against a fixed model."""
    model = Centers(np.array([i for i, _ in sorted(centers)]), np.array([c for _, c in sorted(centers)], dtype=float))
    return stream.withColumn("_nc", nearest_column(stream, col, model)).select(*stream.columns, "_nc.cluster", "_nc.sqdist")
