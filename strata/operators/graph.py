"""Graph tables and single-pass graph operators.

A graph is ``edges(src bigint, dst bigint, attr)`` plus ``vertices(id bigint, attr)``; parallel
edges and self loops are kept (directed multigraph).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators import skew
from strata.session import cut_lineage


def edges_canonical(edges: DataFrame) -> DataFrame:
    """Orient every edge so that src <= dst."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *cols)


def graph_from_edges(edges: DataFrame, default=1) -> DataFrame:
    """Vertices = distinct endpoints, each with the default attribute."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return ids.withColumn("attr", F.lit(default))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("in_degree"))


def vertex_dictionary(edges: DataFrame) -> DataFrame:
    """Global id <-> dense local id (0..n-1 in id order), without a single-partition window."""
    from strata.operators.layout import row_index

    ids = graph_from_edges(edges).select("id")
    return row_index(ids, "id", "local_id")


def adjacency(edges: DataFrame, sort: bool = True, max_chunk: int = 1 << 16) -> DataFrame:
    """CSR-style rows: (src, chunk, dsts array<bigint>, attrs array, degree, offset).

    The edges of a source are numbered in (dst, attr) order, or with ``sort=False`` in the order
    they are read; edge ``r`` belongs to chunk ``r div max_chunk``, so every chunk but a source's
    last holds exactly ``max_chunk`` edges.  ``degree`` is the chunk's edge count and ``offset`` the
    place of its first edge in the order of all edges.

    Equal edges travel as one row with a count, so a pair repeated a million times is one row of
    the sort; numbers come from a running sum over range partitions, and a source's first number
    reaches its rows in stretches of ``max_chunk`` numbers.  No step has a group that grows with
    a source's degree."""
    if max_chunk <= 0:
        raise ValueError("max_chunk must be positive")
    attr = (F.col("attr") if "attr" in edges.columns else F.lit(1)).alias("attr")
    e = edges.select("src", "dst", attr)
    if sort:
        runs, order = e.groupBy("src", "dst", "attr").agg(F.count(F.lit(1)).alias("_n")), ["src", "dst", "attr"]
    else:
        runs, order = cut_lineage(e.withColumn("_n", F.lit(1)).withColumn("_at", F.monotonically_increasing_id())), ["src", "_at"]
    numbered = cut_lineage(prefix_sum(runs, order, "_n", "_first"))
    width = F.lit(max_chunk)
    span = numbered.groupBy("src").agg(F.min("_first").alias("_base"), F.max(F.col("_first") + F.col("_n") - 1).alias("_last"))
    # a source's base, once for each stretch of numbers that its edges touch
    bases = span.select("src", "_base", F.explode(F.sequence(F.floor(F.col("_base") / width), F.floor(F.col("_last") / width))).alias("_stretch"))
    placed = numbered.withColumn("_stretch", F.floor(F.col("_first") / width)).join(bases, ["src", "_stretch"])
    rank = F.col("_first") - F.col("_base")
    chunks = F.sequence(F.floor(rank / width), F.floor((rank + F.col("_n") - 1) / width))
    parts = placed.select("src", "dst", "attr", "_n", "_base", rank.alias("_rank"), F.explode(chunks).alias("_c"))
    begin = F.greatest(F.col("_rank"), F.col("_c") * width)
    size = (F.least(F.col("_rank") + F.col("_n"), (F.col("_c") + 1) * width) - begin).cast("int")
    items = F.array_sort(F.collect_list(F.struct(begin.alias("r"), size.alias("n"), "dst", "attr")))
    g = parts.groupBy("src", F.col("_c").cast("int").alias("chunk")).agg(items.alias("_a"), F.first("_base").alias("_base"))
    return g.select("src", "chunk", F.flatten(F.transform("_a", lambda x: F.array_repeat(x["dst"], x["n"]))).alias("dsts"),
                    F.flatten(F.transform("_a", lambda x: F.array_repeat(x["attr"], x["n"]))).alias("attrs"),
                    F.aggregate("_a", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("degree"),
                    (F.col("_base") + F.col("chunk") * width).alias("offset"))


def prefix_sum(df: DataFrame, order_by: list[str], value_col: str, out_col: str) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_by`` order, computed as partition-local
    sums plus per-partition bases (a table with one row per partition); no global window."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # Written once with the partition number: sums and bases must come from the same ordering.
    tagged = cut_lineage(ordered.withColumn("_pid", F.spark_partition_id()))
    w_local = Window.partitionBy("_pid").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_loc", F.coalesce(F.sum(value_col).over(w_local), F.lit(0)))
    totals = tagged.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    base = totals.select("_pid", (F.sum("_tot").over(Window.orderBy("_pid")) - F.col("_tot")).alias("_base"))
    return (local.join(F.broadcast(base), "_pid")
            .withColumn(out_col, (F.col("_base") + F.col("_loc")).cast("long")).drop("_pid", "_loc", "_base"))


def hot_rows(rows: int) -> int:
    """Edges of a vertex, among ``rows`` in all, above which it is hot."""
    return max(skew.HOT_ROWS, math.ceil(rows / skew.HOT_SHARE))


def spread(edges: DataFrame, ends: tuple[str, ...] = ("src", "dst"), threshold: int | None = None) -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """Adds ``<end>_salt`` for each end, 0 but for hot vertices, whose edges are dealt by a hash of the
    other end; and the hot vertices of each end (None: there are none).  See ``skew.salt_hot``."""
    if threshold is None:
        threshold = hot_rows(edges.count())
    hot: dict[str, DataFrame | None] = {}
    for end in ends:
        edges, hot[end] = skew.salt_hot(edges, end, "dst" if end == "src" else "src", f"{end}_salt", threshold)
    return edges, hot


def attach(edges: DataFrame, end: str, state: DataFrame, hot: DataFrame | None, hashed: bool = False) -> DataFrame:
    """Inner join of spread edges with the vertex columns of ``state`` (id, ...) at one end; ``hashed``: see ``skew.join_hot``."""
    return skew.join_hot(edges, end, state.withColumnRenamed("id", end), hot, f"{end}_salt", hashed=hashed)


def triplets(edges: DataFrame, vertices: DataFrame, threshold: int | None = None) -> DataFrame:
    """Edges with both endpoint attributes: (src, dst, attr, src_attr, dst_attr).  Edges with an
    endpoint that is no vertex are left out.  Hot endpoints are spread over several tasks."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    e, hot = spread(edges.select("src", "dst", *cols), threshold=threshold)
    for end in ("src", "dst"):
        e = attach(e, end, vertices.select("id", F.col("attr").alias(f"{end}_attr")), hot[end])
    return e.select("src", "dst", *cols, "src_attr", "dst_attr")


def map_vertices(vertices: DataFrame, expr: Column) -> DataFrame:
    """Replace the vertex attribute by ``expr`` (may use ``id`` and ``attr``)."""
    return vertices.withColumn("attr", expr)


_MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def aggregate_messages(trip: DataFrame, send: Column, merge: str = "sum", when: Column | None = None,
                       to: str = "dst") -> DataFrame:
    """Send ``send`` along each triplet (optionally where ``when``) to ``to`` and merge per
    receiving vertex: (id, msg).  Merging is an aggregate with map-side partial merges."""
    if merge not in _MERGES:
        raise ValueError(f"merge must be one of {sorted(_MERGES)}")
    t = trip if when is None else trip.filter(when)
    msgs = t.select(F.col(to).alias("id"), send.alias("_m"))
    return msgs.groupBy("id").agg(_MERGES[merge]("_m").alias("msg"))


def label_vertices(ranks: DataFrame, names: DataFrame, id_col: str = "id", name_id: str = "id") -> DataFrame:
    """Attach names to ranked vertices (inner join on id)."""
    return ranks.join(names.withColumnRenamed(name_id, id_col), id_col)
