"""The pipeline on a small table with planted cases."""

import corpus_pipeline
from test_operators import words


def test_stages_take_effect(spark, tmp_path):
    item, text = words(500, 40), words(501, 100)
    rows = [(i, words(510 + i, 60), "xx") for i in range(30)]
    rows += [(40, text, "xx"), (41, text, "xx"), (42, text.replace(" ", " q ", 1), "xx"), (43, words(502, 20) + " " + item, "xx"),
             (44, words(503, 30) + " token=abcdef99 end", "xx"), (45, None, "xx"), (46, "", None)]
    docs = spark.createDataFrame([(i, t, l, "s", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path)).cache()
        seen[name] = out
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        kept = out
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    clean = set(range(30))
    assert ids["language_id"] == clean | {40, 41, 42, 43, 44}
    assert ids["ngram_jaccard_join"] == clean | {40, 43, 44}
    assert ids["benchmark_decontamination"] == clean | {40, 44} == ids["secret_scan"] == ids["best_fit_packing"]
    assert "[secret]" in seen["secret_scan"].filter("doc_id = 44").first()["text"]
