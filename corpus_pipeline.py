"""The corpus pipeline: language ID, near duplicates, benchmark contamination, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
documents, the last one the packed pieces.  ``run`` writes each stage's rows as Parquet in the
session's shared checkpoint folder and reads them back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontam, jaccard, language, packing, secrets
from strata.llm.common import id_fold, staged, table
from strata.llm.queries import TOKENIZER


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are too far from every learned language go, and those without a letter."""
    model = language.fit(docs.filter(id_fold("doc_id", 3) != 1).select("text", "lang"))
    return language.identify(docs, model).filter(~F.col("rejected")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 the smallest id stays."""
    return jaccard.one_of_each(docs, jaccard.join(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    out = secrets.redact(secrets.scan(docs))
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages hold models, MinHash and a tokenizer that SQL can't express; tests compare them with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
