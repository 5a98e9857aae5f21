"""k-means: assignment, cost, Lloyd steps, fitting loops, initialisation, layouts.

Points are ``(id, features array<double>)``; centers are ``(center_id int, center array<double>)``.

A model is k x dim doubles and lives on the driver between steps, as one matrix that is broadcast
to the executors.  Per Lloyd step the points are scanned once (they are persisted across steps);
each task assigns its points and forms partial (sum, count, cost) rows per cluster, and only
those cross the shuffle.  Two step engines share the assignment:

* ``method="sql"``   Catalyst sums: ``posexplode`` and one aggregate (the oracle-friendly form);
* ``method="arrow"`` ``mapInArrow``: a task adds its batches up in NumPy; the reduction stays a
                     Spark aggregate.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.hashing import uniform
from strata.functions.nearest import Centers, matrix_of, nearest_column
from strata.operators.layout import columns_to_flat, row_index, unpack_blocks
from strata.operators.linalg import nearest_center
from strata.session import cut_lineage


def centers_frame(spark, centers: list[tuple[int, list[float]]]) -> DataFrame:
    return spark.createDataFrame([(int(i), [float(x) for x in c]) for i, c in centers],
                                 "center_id int, center array<double>")


def _model_frame(spark, model: Centers) -> DataFrame:
    table = pa.table({"center_id": pa.array(model.ids.astype(np.int32)),
                      "center": pa.array(model.rows.tolist(), pa.list_(pa.float64()))})
    return spark.createDataFrame(table, "center_id int, center array<double>")


def initial_centers_lowest(points: DataFrame, k: int, id_col: str = "id", col: str = "features") -> DataFrame:
    """Deterministic init: the k points with the lowest ids, numbered 0..k-1 (a top-k)."""
    if k <= 0:
        raise ValueError("k must be positive")
    top = points.orderBy(id_col).limit(k).select(id_col, F.col(col).alias("center"))
    from pyspark.sql import Window
    return top.select((F.row_number().over(Window.orderBy(id_col)) - 1).cast("int").alias("center_id"), "center")


# ----------------------------------------------------------------------------- assignment / cost

def kmeans_predict(points: DataFrame, centers: DataFrame, col: str = "features") -> DataFrame:
    """Adds ``cluster`` (nearest center, lowest id on ties) and ``sqdist``."""
    return nearest_center(points, centers, col)


def total_cost(points: DataFrame, centers: DataFrame, col: str = "features") -> DataFrame:
    """Within-set sum of squared distances to the nearest center (one row: cost)."""
    return kmeans_predict(points.select(col), centers, col).agg(F.sum("sqdist").alias("cost"))


kmeans_cost = total_cost


def cluster_sizes(assigned: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return assigned.groupBy(cluster_col).agg(F.count("*").alias("size"))


# ----------------------------------------------------------------------------- partial sums
#
# One long aggregate per step: (cluster, pos, s) where pos < dim are coordinate sums,
# pos = dim is the point count and pos = dim + 1 the cost.  Each task contributes at most
# k * (dim + 2) rows after its partial aggregate, whatever the number of points.

def _partials_sql(points: DataFrame, model: Centers, col: str) -> DataFrame:
    a = points.select(nearest_column(points, col, model).alias("_nc"), F.col(col).alias("_x"))
    ext = F.concat(F.col("_x"), F.array(F.lit(1.0), F.col("_nc.sqdist")))
    ex = a.select(F.col("_nc.cluster").alias("cluster"), F.posexplode(ext).alias("pos", "x"))
    return ex.groupBy("cluster", "pos").agg(F.sum("x").alias("s"))


def _partials_arrow(points: DataFrame, model: Centers, col: str) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast((model.ids, model.rows))

    def add_up(batches):
        held = Centers(*shared.value)
        sums = np.zeros((len(held.ids), held.dim + 2))
        for batch in batches:  # rows of points, or flat row-major blocks of whole points
            sums += held.partials(matrix_of(batch.column(0), held.dim))
        present = np.flatnonzero(sums[:, -2] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held.ids[present], held.dim + 2).astype(np.int32)),
             pa.array(np.tile(np.arange(held.dim + 2, dtype=np.int32), len(present))), pa.array(sums[present].ravel())],
            names=["cluster", "pos", "s"])

    parts = points.select(F.col(col).cast("array<double>").alias("x")).mapInArrow(add_up, "cluster int, pos int, s double")
    return parts.groupBy("cluster", "pos").agg(F.sum("s").alias("s"))


def _step_stats(points: DataFrame, model: Centers, col: str, method: str) -> DataFrame:
    if method == "sql":
        return _partials_sql(points, model, col)
    if method == "arrow":
        return _partials_arrow(points, model, col)
    raise ValueError("method must be 'sql' or 'arrow'")


def lloyd_step(points: DataFrame, centers: DataFrame, col: str = "features", method: str = "sql") -> DataFrame:
    """One Lloyd step as a plan: (center_id, center).  A center without points keeps its value."""
    model = Centers.collect(centers)
    d = model.dim
    st = _step_stats(points, model, col, method)
    cnt = st.filter(F.col("pos") == d).select("cluster", F.col("s").alias("n"))
    means = (st.filter(F.col("pos") < d).join(cnt, "cluster")
             .select(F.col("cluster").alias("center_id"), "pos", (F.col("s") / F.col("n")).alias("m")))
    new = means.groupBy("center_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_p")).select(
        "center_id", F.transform("_p", lambda p: p["m"]).alias("new_center"))
    return (centers.select(F.col("center_id").cast("int"), "center").join(new, "center_id", "left")
            .select("center_id", F.coalesce("new_center", "center").alias("center")))


def _driver_step(points: DataFrame, model: Centers, col: str, method: str) -> tuple[Centers, float]:
    """Run one step (one job); return the new model and the cost before the update.  What comes back
    is the model's own size, k x (dim + 2) values in Arrow columns."""
    got = _step_stats(points, model, col, method).toArrow()
    sums = np.zeros((len(model.ids), model.dim + 2))
    sums[np.searchsorted(model.ids, got["cluster"].to_numpy()), got["pos"].to_numpy()] = got["s"].to_numpy()
    n = sums[:, -2:-1]
    rows = np.where(n > 0, sums[:, :-2] / np.maximum(n, 1.0), model.rows)
    return Centers(model.ids, rows), float(sums[:, -1].sum())


def lloyd_loop(points: DataFrame, centers: DataFrame, max_iter: int, eps: float | None, col: str = "features",
               method: str = "arrow", persist: bool = True):
    """Driver loop of Lloyd steps; returns (centers DataFrame, iterations run, cost trace).

    Stops after ``max_iter`` steps or when every center moved at most ``eps`` (eps=None: never)."""
    if max_iter < 0:
        raise ValueError("max_iter must be >= 0")
    if eps is not None and eps < 0:
        raise ValueError("eps must be >= 0")
    spark = points.sparkSession
    pts = points.select(F.col(col).cast("array<double>").alias(col))
    if persist:
        pts = pts.persist(StorageLevel.MEMORY_AND_DISK)
    model = Centers.collect(centers)
    trace = []
    try:
        for it in range(max_iter):
            new, cost = _driver_step(pts, model, col, method)
            trace.append((it, cost))
            moved = ((new.rows - model.rows) ** 2).sum(axis=1).max()
            model = new
            if eps is not None and moved <= eps * eps:
                break
    finally:
        if persist:
            pts.unpersist()
    return _model_frame(spark, model), len(trace), trace


def kmeans_fit_fixed(points: DataFrame, init_centers: DataFrame, num_iter: int, col: str = "features",
                     method: str = "arrow") -> DataFrame:
    """Exactly ``num_iter`` Lloyd steps from the given centers."""
    return lloyd_loop(points, init_centers, num_iter, None, col, method)[0]


def kmeans_from_model(points: DataFrame, model_centers: DataFrame, k: int, max_iter: int = 20,
                      eps: float = 1e-4, col: str = "features", method: str = "arrow") -> DataFrame:
    """Warm start from saved centers; their number must equal k."""
    n = model_centers.count()
    if n != k:
        raise ValueError(f"model has {n} centers, expected k={k}")
    return lloyd_loop(points, model_centers, max_iter, eps, col, method)[0]


def kmeans_trace(points: DataFrame, init_centers: DataFrame, num_iter: int, col: str = "features",
                 method: str = "arrow") -> DataFrame:
    """Cost (against the centers going into the step) per iteration: (iteration, cost)."""
    _, _, trace = lloyd_loop(points, init_centers, num_iter, None, col, method)
    return points.sparkSession.createDataFrame(trace, "iteration int, cost double")


def kmeans_fit(points: DataFrame, k: int = 2, max_iter: int = 20, eps: float = 1e-4, init: str = "k-means||",
               init_steps: int = 2, seed: int = 42, init_centers: DataFrame | None = None,
               col: str = "features", method: str = "arrow") -> DataFrame:
    """Fit k-means; returns (center_id, center).  Fewer than k centers come back when the data
    has fewer distinct points.  ``init``: 'given' (use ``init_centers``), 'random', 'k-means||'."""
    if k <= 0:
        raise ValueError("k must be positive")
    if max_iter < 0 or eps < 0 or init_steps <= 0:
        raise ValueError("max_iter >= 0, eps >= 0 and init_steps > 0 are required")
    if init == "given":
        if init_centers is None:
            raise ValueError("init='given' needs init_centers")
        start = init_centers
    elif init == "random":
        start = kmeans_init_random(points, k, seed, col=col)
    elif init == "k-means||":
        start = kmeans_init_parallel(points, k, init_steps, seed, col=col)
    else:
        raise ValueError(f"unknown init mode {init!r}")
    return lloyd_loop(points, start, max_iter, eps, col, method)[0]


def kmeans_fit_ml(points: DataFrame, k: int = 2, max_iter: int = 20, eps: float = 1e-4, init: str = "k-means||",
                  init_steps: int = 2, seed: int = 42, col: str = "features") -> DataFrame:
    """The same fit through Spark ML's KMeans (random or k-means|| init)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if init not in ("random", "k-means||"):
        raise ValueError(f"unknown init mode {init!r}")
    df = points.select(array_to_vector(F.col(col).cast("array<double>")).alias("_v"))
    model = KMeans(k=k, maxIter=max_iter, tol=eps, initMode=init, initSteps=init_steps, seed=seed,
                   featuresCol="_v").fit(df)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return centers_frame(points.sparkSession, centers)


# ----------------------------------------------------------------------------- initialisation

def take_sample(points: DataFrame, k: int, seed: int, id_col: str = "id") -> DataFrame:
    """k rows without replacement, in a seeded hash order (a top-k by the hash)."""
    if k < 0:
        raise ValueError("k must be >= 0")
    return points.withColumn("_u", uniform(seed, id_col)).orderBy("_u", id_col).limit(k).drop("_u")


def weighted_sample(points: DataFrame, cost_col: str, k: int, total: float, seed: int, id_col: str = "id") -> DataFrame:
    """Keep each row with probability 2 * cost * k / total (seeded, deterministic per id)."""
    if total <= 0:
        return points.limit(0)
    return points.filter(uniform(seed, id_col) < F.lit(2.0 * k) * F.col(cost_col) / F.lit(float(total)))


def _numbered(rows: DataFrame, id_col: str, col: str) -> DataFrame:
    """Distinct vectors as centers, numbered in the order of the lowest id that has them."""
    from strata.operators.vectors import dedupe_vectors

    first = dedupe_vectors(rows, col, id_col).select(id_col)
    kept = row_index(rows.dropDuplicates([id_col]).join(first, id_col, "left_semi").select(id_col, col), id_col, "_n")
    return kept.select(F.col("_n").cast("int").alias("center_id"), F.col(col).alias("center"))


def kmeans_init_random(points: DataFrame, k: int, seed: int, id_col: str = "id", col: str = "features") -> DataFrame:
    """Sample k points and drop duplicate vectors: (center_id, center), numbered by id.  An empty
    table raises."""
    if k <= 0:
        raise ValueError("k must be positive")
    sample = cut_lineage(take_sample(points.select(id_col, F.col(col).cast("array<double>").alias(col)), k, seed, id_col))
    if sample.isEmpty():
        raise ValueError("empty input")
    return _numbered(sample, id_col, col)


def parallel_candidates(points: DataFrame, k: int, steps: int = 2, seed: int = 42, id_col: str = "id",
                        col: str = "features") -> DataFrame:
    """Oversampled k-means|| candidates as a table (center_id, center) of distinct vectors.

    One seed point; each step keeps each point with probability min(1, 2 k cost / total cost).  The
    candidates of a step go to a table of their own and only they are compared with the points to
    lower their costs; a step's costs are complete in the cache before the last step's are
    released, so no step is ever computed twice."""
    if k <= 0 or steps <= 0:
        raise ValueError("k > 0 and steps > 0 are required")
    pts = points.select(id_col, F.col(col).cast("array<double>").alias(col))
    new = cut_lineage(take_sample(pts, 1, seed, id_col))
    if new.isEmpty():
        raise ValueError("empty input")
    chosen, cost = [new], pts.withColumn("_cost", F.lit(float("inf")))
    held = None
    try:
        for step in range(steps):
            if new is not None:
                model = Centers.collect(row_index(new, id_col, "_n"), "_n", col)
                nearer = cost.withColumn("_cost", F.least("_cost", nearest_column(cost, col, model)["sqdist"]))
                nearer = nearer.persist(StorageLevel.MEMORY_AND_DISK)
                total = nearer.agg(F.sum("_cost")).first()[0] or 0.0  # fills the cache
                if held is not None:
                    held.unpersist()
                held = cost = nearer
            if total <= 0:
                break
            new = cut_lineage(weighted_sample(cost, "_cost", k, total, seed + 1 + step, id_col).select(id_col, col))
            if new.isEmpty():
                new = None
            else:
                chosen.append(new)
    finally:
        if held is not None:
            held.unpersist()
    rows = chosen[0]
    for c in chosen[1:]:
        rows = rows.unionByName(c)
    return cut_lineage(_numbered(rows, id_col, col))


def kmeans_init_parallel(points: DataFrame, k: int, steps: int = 2, seed: int = 42, id_col: str = "id",
                         col: str = "features") -> DataFrame:
    """k-means||: the candidates of ``parallel_candidates``, weighted by the points they attract and
    reduced to k by ``kmeans_reduce_candidates``; k candidates or fewer are the result themselves.
    (center_id, center).  An empty table raises."""
    cands = parallel_candidates(points, k, steps, seed, id_col, col)
    if cands.count() <= k:
        return cands
    weights = cut_lineage(cluster_sizes(kmeans_predict(points.select(col), cands, col)))
    return kmeans_reduce_candidates(cands, weights, k, seed)


#: Lloyd steps over the candidates at most.
REDUCE_STEPS = 30


def draw_key(seed: int, draw: int, center_id: int, mass: float) -> float:
    """Exponential race: the candidate with the smallest key is drawn with a chance in proportion to
    its mass, whatever order the candidates come in.  No mass, never drawn."""
    u = int(hashlib.md5(f"{seed}:{draw}:{center_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return -np.log(u) / mass if u > 0 and mass > 0 else np.inf


def kmeans_reduce_candidates(cands: DataFrame, weights: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Weighted k-means++ over the candidates: (center_id, center).

    Draws k candidates one after the other, each in proportion to its weight times the squared
    distance to those drawn before (the first by weight alone), then runs weighted Lloyd steps
    until no candidate changes its center, ``REDUCE_STEPS`` at most.  Centers are numbered as drawn;
    one that loses all candidates stays where it is.  Candidates without a row in ``weights``
    weigh nothing; fewer distinct ones than k give fewer centers.

    The candidates of k-means|| are 2 k a step on average, so like the model they depend on k and
    not on the data, and each draw depends on the one before: they are reduced on the driver."""
    if k <= 0:
        raise ValueError("k must be positive")
    rows = cands.join(weights.select(F.col("cluster").alias("center_id"), F.col("size").cast("double").alias("_w")), "center_id", "left")
    got = rows.select(F.col("center_id").cast("long").alias("i"), F.col("center").cast("array<double>").alias("c"), F.coalesce("_w", F.lit(0.0)).alias("w")).orderBy("i").toArrow()
    if not got.num_rows:
        raise ValueError("no candidates")
    ids, x, w = got["i"].to_numpy(), matrix_of(got["c"]), got["w"].to_numpy()
    drawn: list[int] = []
    near = np.ones(len(ids))
    for draw in range(min(k, len(ids))):
        keys = [draw_key(seed, draw, i, m) for i, m in zip(ids.tolist(), (w * near).tolist(), strict=True)]
        at = int(np.argmin(keys))
        if not np.isfinite(keys[at]):
            break
        drawn.append(at)
        far = ((x - x[at]) ** 2).sum(axis=1)
        near = np.minimum(near, far) if draw else far
    if not drawn:
        raise ValueError("no candidate has a weight")
    model, before = Centers(np.arange(len(drawn)), x[drawn]), None
    for _ in range(REDUCE_STEPS):
        label, _ = model.nearest(x)
        if before is not None and (label == before).all():
            break
        before = label
        mass = np.bincount(label, weights=w, minlength=len(drawn))
        sums = np.zeros_like(model.rows)
        np.add.at(sums, label, x * w[:, None])
        model = Centers(model.ids, np.where(mass[:, None] > 0, sums / np.where(mass > 0, mass, 1.0)[:, None], model.rows))
    return _model_frame(cands.sparkSession, model)


# ----------------------------------------------------------------------------- other layouts

def kmeans_fit_columns(columns: DataFrame, init_centers: DataFrame, num_iter: int, method: str = "arrow") -> DataFrame:
    """Same fit from the column layout (dim, block_id, first_row, values), packed block by block."""
    return kmeans_fit_blocks(columns_to_flat(columns), init_centers, num_iter, method)


def kmeans_fit_blocks(blocks: DataFrame, init_centers: DataFrame, num_iter: int, method: str = "arrow") -> DataFrame:
    """Same fit from packed blocks.  Flat blocks go to NumPy as they are (one zero-copy reshape
    per Arrow batch); per-column blocks and the SQL engine unpack to rows first."""
    if method == "arrow" and "flat" in blocks.columns:
        return kmeans_fit_fixed(blocks.select(F.col("flat").alias("features")), init_centers, num_iter,
                                "features", method)
    pts = unpack_blocks(blocks, "features", "row")
    return kmeans_fit_fixed(pts, init_centers, num_iter, "features", method)
