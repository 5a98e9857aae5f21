from pyspark.sql import functions as F

from strata import streaming as ST
from strata.operators import text as X


def test_streaming_doc_freq_equals_batch(spark, sf, tmp_path):
    stream = ST.read_document_stream(spark, sf, file_glob="documents.parquet")
    df = ST.stream_document_frequency(stream)
    q = (df.writeStream.outputMode("complete").format("memory").queryName("strata_df_test")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.idx: r.doc_freq for r in spark.sql("SELECT * FROM strata_df_test").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.idx: r.doc_freq for r in X.idf_fit(X.hashing_tf(docs)).collect()}
    assert got == want


def test_streaming_assignment(spark, sf, tmp_path):
    from strata import catalog as C

    cs = [(r.center_id, r.center) for r in C.lowest_centers(spark, sf).collect()]
    stream = (spark.readStream.schema("vec_id long, embedding array<float>, label int")
              .option("pathGlobFilter", "embeddings.parquet").parquet(sf))
    out = ST.stream_assign(stream.select("vec_id", F.col("embedding").alias("features")), cs)
    q = (out.select("vec_id", "cluster").writeStream.format("memory").queryName("strata_assign_test")
         .option("checkpointLocation", str(tmp_path / "ckpt2")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("SELECT count(*) FROM strata_assign_test").first()[0] == 500
