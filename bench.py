"""Headline timings on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value" (sum of per-query medians), "unit", "queries", "sf", ...}.
Each query runs fully (``noop`` sink: every row is produced, nothing is collected) and its
median over ``$BENCH_REPS`` runs (default 3) is reported; session start is excluded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from strata import catalog as C  # noqa: E402
from strata.operators import layout as L  # noqa: E402
from strata.operators import linalg as LA  # noqa: E402
from strata.operators import text as X  # noqa: E402
from strata.plans import graph as GP  # noqa: E402
from strata.plans import kmeans as KM  # noqa: E402
from strata.session import cut_lineage, local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))
LLOYD_ITERS = 5
COPIES = 100
PR_ROUNDS = 5


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS) * 2), app="strata-bench")
    spark.sparkContext.setLogLevel("OFF")
    d = SF_DIR
    docs = cut_lineage(C.docs(spark, d).repartition(2 * int(CPUS)))  # several files, as any large table has
    pts = C.points(spark, d)
    rows = L.row_index(pts, "id", "row").persist()
    rows.count()
    edges = C.edges(spark, d).persist()
    edges.count()
    centers = C.lowest_centers(spark, d)
    n_docs = docs.count()
    n_pts = pts.count()
    # enough vectors to measure throughput: each point COPIES times, moved a little each time
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    many = pts.select("id", "features", copy.alias("c")).select(
        (F.col("id") * COPIES + F.col("c")).alias("id"), F.transform("features", lambda x: x + F.col("c") * 1e-3).alias("features"))
    many = cut_lineage(many.repartition(2 * int(CPUS))).persist()
    n_many = many.count()
    assert n_many == COPIES * n_pts >= 200_000 or n_pts < 2000

    def q_tfidf():
        run(X.tfidf_job(docs))

    def q_term_counts():
        run(X.term_counts(docs))

    def q_lloyd_row():
        KM.kmeans_fit_fixed(pts, centers, LLOYD_ITERS, method="arrow")

    def q_lloyd_row_sql():
        KM.kmeans_fit_fixed(pts, centers, LLOYD_ITERS, method="sql")

    blocks = L.pack_flat(rows, block_rows=256).persist()
    blocks.count()

    def q_lloyd_packed():
        KM.kmeans_fit_blocks(blocks, centers, LLOYD_ITERS)

    def q_pagerank():
        run(GP.static_pagerank(edges, PR_ROUNDS))

    def q_bfs():
        run(GP.bfs(edges, C.ROOT))

    def q_lloyd_many():
        KM.kmeans_fit_fixed(many, centers, LLOYD_ITERS, method="arrow")

    def q_nearest_many():
        run(LA.nearest_center(many, centers))

    def q_gram_many():
        assert LA.gram_matrix(many).count() == 64 * 64

    def q_transpose():
        run(L.transpose(rows, block_rows=256))

    def q_pack_flat():
        run(L.pack_flat(rows, block_rows=256))

    def q_unpack():
        run(L.unpack_blocks(blocks))

    def q_gram():
        run(LA.gram_matrix(pts))

    def q_nearest_center():
        run(LA.nearest_center(pts.select("id", "features"), centers))

    plan = [
        ("tfidf", q_tfidf), ("term_counts", q_term_counts),
        ("lloyd_row_5it", q_lloyd_row), ("lloyd_row_sql_5it", q_lloyd_row_sql), ("lloyd_packed_5it", q_lloyd_packed),
        ("nearest_center", q_nearest_center), ("pagerank_5r", q_pagerank), ("bfs", q_bfs),
        ("transpose", q_transpose), ("pack_flat", q_pack_flat), ("unpack_blocks", q_unpack), ("gram_matrix", q_gram),
        ("lloyd_200k_5it", q_lloyd_many), ("nearest_center_200k", q_nearest_many), ("gram_matrix_200k", q_gram_many),
    ]
    only = set(sys.argv[1:])
    times = {}
    for name, fn in plan:
        if only and name not in only:
            continue
        ts = []
        for _ in range(REPS):
            t0 = time.perf_counter()
            fn()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
    extra = {}
    if "tfidf" in times:
        extra["tfidf_docs_per_sec"] = round(n_docs / times["tfidf"], 1)
    for k in ("lloyd_row_5it", "lloyd_row_sql_5it", "lloyd_packed_5it"):
        if k in times:
            extra[k.replace("_5it", "_sec_per_iter")] = round(times[k] / LLOYD_ITERS, 3)
    if "pagerank_5r" in times:
        extra["pagerank_sec_per_round"] = round(times["pagerank_5r"] / PR_ROUNDS, 3)
    for k in ("transpose", "pack_flat", "unpack_blocks"):
        if k in times:
            extra[f"{k}_rows_per_sec"] = round(n_pts / times[k], 1)
    for k in ("lloyd_200k_5it", "nearest_center_200k", "gram_matrix_200k"):
        if k in times:
            extra[f"{k}_vectors_per_sec"] = round(n_many * (LLOYD_ITERS if "5it" in k else 1) / times[k], 1)
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")),
                      "cpus": int(CPUS), "reps": REPS, "derived": extra}))


if __name__ == "__main__":
    main()
