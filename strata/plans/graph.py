"""Iterative graph jobs: PageRank, BFS and a general Pregel loop.

Edges are prepared once: the edges of hot vertices are spread over salts (``operators.graph.spread``),
then hash-partitioned by the very columns that the rounds join on and kept in the cache, so a round
builds a hash table of vertices beside edges that neither move nor are sorted again; messages are
partially merged per task before the shuffle by receiver.

Every round's result is written to the shared checkpoint folder: the next round reads files, so
plans don't grow and a lost executor costs at most a round.  A round writes only the vertices it
changed; the write counts them, which is also how a loop learns that it is done.  Files that a
later round has replaced are deleted.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.graph import _MERGES, attach, graph_from_edges, hot_rows, spread
from strata.session import cut_lineage, cut_lineage_counted, release

INF = float("inf")

#: Edges of a cached partition; from more the number of partitions grows.
PARTITION_ROWS = 2_000_000
#: BFS levels between two rewritings of the visited vertices.
COMPACT_EVERY = 8
#: Changed vertices, as a part of all, from which a Pregel round rewrites the whole state.
REWRITE_PART = 1 / 4


def placed(edges: DataFrame, end: str, hot: DataFrame | None, rows: int, least: int | None = None) -> DataFrame:
    """Spread edges partitioned by ``end`` (and its salt, if a vertex is hot: a join on ``end`` alone would move
    rows that lie by both) and in the cache.  The number of partitions is given, as it must not be changed at run time,
    and grows with ``rows``."""
    n = max(least or 1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PARTITION_ROWS))
    out = edges.repartition(n, *([end] if hot is None else [end, f"{end}_salt"])).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def prepare_edges(edges: DataFrame, partitions: int | None = None, hot_factor: int = 4, end: str = "src") -> tuple[DataFrame, DataFrame | None]:
    """Edges with ``<end>_salt``, ``placed`` by that end in ``partitions`` at least, and the hot vertices of
    that end (None: there are none).  With ``partitions`` a vertex is hot above ``|E| / (hot_factor * partitions)`` edges
    or ``PARTITION_ROWS``, else as in ``spread``; either way the number of hot ones is bounded."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *cols)
    rows = e.count()
    threshold = max(1, min(PARTITION_ROWS, math.ceil(rows / (hot_factor * partitions)))) if partitions else hot_rows(rows)
    salted, hot = spread(e, (end,), threshold)
    return placed(salted, end, hot[end], rows, partitions), hot[end]


def static_pagerank(edges: DataFrame, num_iter: int, reset_prob: float = 0.15, normalize: bool = False,
                    checkpoint_every: int = 5, partitions: int | None = None) -> DataFrame:
    """Fixed-iteration PageRank: (id, rank).

    Every vertex starts at 1.0; each round rank = reset + (1 - reset) * sum(rank(src) / outdeg(src))
    over in-edges (parallel edges count separately; a vertex without in-edges gets ``reset``).
    No redistribution of dangling mass; ``normalize=True`` rescales ranks to sum to the vertex
    count at the end."""
    if num_iter < 0:
        raise ValueError("num_iter must be >= 0")
    salted, hot = prepare_edges(edges.select("src", "dst"), partitions)
    outdeg = salted.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_od"))
    vertices = graph_from_edges(edges.select("src", "dst")).select("id")
    weights = cut_lineage(vertices.join(outdeg, "id", "left").select("id", (F.lit(1.0) / F.col("_od")).alias("_w")))
    ranks = weights.select("id", F.lit(1.0).alias("rank"), "_w")
    written = None
    for it in range(num_iter):
        share = ranks.filter(F.col("_w").isNotNull()).select("id", (F.col("rank") * F.col("_w")).alias("_c"))
        sums = attach(salted, "src", share, hot, hashed=True).groupBy(F.col("dst").alias("id")).agg(F.sum("_c").alias("_s"))
        ranks = weights.join(sums, "id", "left").select(
            "id", (F.lit(reset_prob) + F.lit(1.0 - reset_prob) * F.coalesce("_s", F.lit(0.0))).alias("rank"), "_w")
        if checkpoint_every and (it + 1) % checkpoint_every == 0 and it + 1 < num_iter:
            ranks = cut_lineage(ranks)
            release(written)
            written = ranks
    out = ranks.select("id", "rank")
    if normalize:
        total = out.agg(F.sum("rank").alias("_t"), F.count("*").alias("_n"))
        out = out.crossJoin(F.broadcast(total)).select("id", (F.col("rank") * F.col("_n") / F.col("_t")).alias("rank"))
    out = cut_lineage(out)
    salted.unpersist()
    release(written, weights, hot)
    return out


def bfs(edges: DataFrame, root: int, max_iter: int | None = None, partitions: int | None = None) -> DataFrame:
    """Hop distance from ``root`` following edge direction: (id, dist double).

    Unreachable vertices (and every vertex when the root is absent) get +inf.  A level expands the
    frontier along out-edges and drops what has been reached before; its write counts the next
    frontier, and an empty one ends the loop.  Reached vertices are one (id, dist) table plus the
    levels since it was last rewritten, ``COMPACT_EVERY`` at most, so a level's plan doesn't grow
    with the depth."""
    salted, hot = prepare_edges(edges.select("src", "dst"), partitions)
    vertices = graph_from_edges(edges.select("src", "dst")).select("id")
    frontier, n = cut_lineage_counted(vertices.filter(F.col("id") == F.lit(int(root))).select("id", F.lit(0).alias("dist")))
    reached, recent, stale, level = frontier, [], [], 0
    while n and (max_iter is None or level < max_iter):
        level += 1
        seen = reached
        for df in recent:
            seen = seen.unionByName(df)
        ahead = attach(salted, "src", frontier.select("id"), hot, hashed=True).select(F.col("dst").alias("id")).distinct()
        frontier, n = cut_lineage_counted(ahead.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("dist")))
        release(*stale)
        recent, stale = [*recent, frontier], []
        if len(recent) == COMPACT_EVERY:
            old = [reached, *recent[:-1]]
            reached = cut_lineage(seen.unionByName(frontier))
            release(*old)
            recent, stale = [], [frontier]  # the next level still starts from it
    leaves = [reached, *recent, *stale]
    for df in recent:
        reached = reached.unionByName(df)
    out = cut_lineage(vertices.join(reached, "id", "left").select(
        "id", F.coalesce(F.col("dist").cast("double"), F.lit(INF)).alias("dist")))
    salted.unpersist()
    release(*leaves, hot)
    return out


def pregel(edges: DataFrame, vertices: DataFrame, initial_msg, vprog: Callable[[Column, Column], Column],
           send_msg: Callable[[Column, Column, Column], Column] | None, merge: str | Callable[[Column], Column] = "min",
           max_iter: int = 2 ** 31 - 1, send_to_src: Callable[[Column, Column, Column], Column] | None = None,
           active: str = "either", threshold: int | None = None, accept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Message passing until no message is sent: (id, attr).

    * ``vprog(attr, msg)`` -> new attribute (column expressions; ``attr`` may be a struct);
    * ``send_msg(src_attr, dst_attr, edge_attr)`` -> message to dst, NULL for none;
      ``send_to_src``, with the same arguments, -> message to src;
    * ``merge``: sum, min, max or count, or any aggregate of the message column; it must not
      depend on the order of messages;
    * ``active``: an edge sends in a round if the round before changed its source ("out"), its
      destination ("in"), one of them ("either") or both ("both");
    * ``accept(attr, msg)``: for programs whose messages depend on the sender and the edge alone.  The
      functions get None for the receiver's attribute, an edge sends at the ends that the round before
      changed (whatever ``active`` says), and a vertex receives its merged message where this holds.
      Edges then never travel to their receivers' state.

    Round 0 applies ``vprog`` with ``initial_msg`` to every vertex, after which every edge sends.  A
    vertex changes when it receives a message; the loop ends when none is sent or after
    ``max_iter`` rounds.  Messages to ids that are no vertices, and edges with such an end, do
    nothing.  Vertex ids must be unique.

    The state is a table of all vertices plus the rows changed since it was written.  A round reads
    the edges of changed vertices only, from one side for changed sources and from the other for
    changed destinations, and writes changed rows only; the whole state is rewritten when those
    would exceed a quarter of it."""
    if isinstance(merge, str):
        if merge not in _MERGES:
            raise ValueError(f"merge must be one of {sorted(_MERGES)}")
        merge = _MERGES[merge]
    if active not in ("out", "in", "either", "both"):
        raise ValueError("active must be 'out', 'in', 'either' or 'both'")
    if send_msg is None and send_to_src is None:
        raise ValueError("nothing is ever sent")
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), (F.col("attr") if "attr" in edges.columns else F.lit(1)).alias("eattr"))
    rows = e.count()
    if accept is None:
        ends = ("src", "dst") if active in ("in", "either") else ("src",)
    else:
        ends = tuple(end for end, send in (("src", send_msg), ("dst", send_to_src)) if send is not None)
    e, hot = spread(e, ("src", "dst") if accept is None else ends, hot_rows(rows) if threshold is None else threshold)
    by = {end: placed(e, end, hot[end], rows) for end in ends}

    def vertex(state: DataFrame, end: str) -> DataFrame:
        return state.select("id", F.col("attr").alias(f"{end}_attr"), F.col("round").alias(f"{end}_round"))

    def sides(now: int, state: DataFrame, changed: DataFrame | None) -> list[DataFrame]:
        if changed is None:  # round 0
            return [attach(attach(by["src"], "src", vertex(state, "src"), hot["src"], hashed=True), "dst", vertex(state, "dst"), hot["dst"])]
        out = []
        if active != "in":
            t = attach(attach(by["src"], "src", vertex(changed, "src"), hot["src"], hashed=True), "dst", vertex(state, "dst"), hot["dst"])
            out.append(t if active != "both" else t.filter(F.col("dst_round") == now))
        if active in ("in", "either"):
            t = attach(attach(by["dst"], "dst", vertex(changed, "dst"), hot["dst"], hashed=True), "src", vertex(state, "src"), hot["src"])
            out.append(t if active == "in" else t.filter(F.col("src_round") < now))
        return out

    def messages(now: int, state: DataFrame, changed: DataFrame | None) -> DataFrame:
        if accept is not None:
            parts = []
            for end, to, send in (("src", "dst", send_msg), ("dst", "src", send_to_src)):
                if send is not None:
                    attrs = [F.col(f"{x}_attr") if x == end else None for x in ("src", "dst")]
                    t = attach(by[end], end, vertex(state if changed is None else changed, end), hot[end], hashed=True)
                    parts.append(t.select(F.col(to).alias("id"), send(*attrs, F.col("eattr")).alias("_m")))
            sent = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).filter(F.col("_m").isNotNull()).groupBy("id").agg(merge("_m").alias("msg"))
            return sent.join(state.select("id", "attr"), "id").filter(accept(F.col("attr"), F.col("msg"))).select("id", "msg")
        ends = (F.col("src_attr"), F.col("dst_attr"), F.col("eattr"))
        sent = [F.struct(F.col(to).alias("id"), send(*ends).alias("_m")) for to, send in (("dst", send_msg), ("src", send_to_src)) if send is not None]
        parts = [t.select(F.inline(F.array(*sent))) for t in sides(now, state, changed)]
        all_sent = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return all_sent.filter(F.col("_m").isNotNull()).groupBy("id").agg(merge("_m").alias("msg"))

    start = initial_msg if isinstance(initial_msg, Column) else F.lit(initial_msg)
    base, size = cut_lineage_counted(vertices.select("id", vprog(F.col("attr"), start).alias("attr"), F.lit(0).alias("round")))
    changes, changed, now = None, None, 0
    state = base
    while now < max_iter:
        msgs, n = cut_lineage_counted(messages(now, state, changed))
        if n == 0:
            release(msgs)
            break
        now += 1
        applied = vprog(F.col("attr"), F.col("msg"))
        got = F.col("msg").isNotNull()
        updated = ("id", F.when(got, applied).otherwise(F.col("attr")).alias("attr"), F.when(got, F.lit(now)).otherwise(F.col("round")).alias("round"))
        kept = 0 if changes is None else changes_n
        if kept + n > size * REWRITE_PART:
            old = [base, changes, msgs]
            base = cut_lineage(state.join(msgs, "id", "left").select(*updated))
            changes, state = None, base
            changed = base.filter(F.col("round") == now)
        else:
            old = [changes, msgs]
            fresh = msgs if changes is None else msgs.join(changes, "id", "left_anti")
            new = base.join(fresh, "id").select(*updated)
            if changes is not None:
                new = new.unionByName(changes.join(msgs, "id", "left").select(*updated))
            changes, changes_n = cut_lineage_counted(new)
            state = base.join(changes, "id", "left_anti").unionByName(changes)
            changed = changes.filter(F.col("round") == now)
        release(*old)
    out = cut_lineage(state.select("id", "attr"))
    for df in by.values():
        df.unpersist()
    release(base, changes, *hot.values())
    return out


def bfs_pregel(edges: DataFrame, root: int, max_iter: int = 2 ** 31 - 1) -> DataFrame:
    """BFS written as the Pregel program of the original job: vertex value = min(old, msg);
    send dist + 1 from a reached source, to be received by an unreached destination; merge by min."""
    verts = graph_from_edges(edges.select("src", "dst")).select(
        "id", F.when(F.col("id") == F.lit(int(root)), F.lit(0.0)).otherwise(F.lit(INF)).alias("attr"))
    out = pregel(
        edges.select("src", "dst"), verts, INF,
        vprog=lambda attr, msg: F.least(attr, msg),
        send_msg=lambda s, _d, _e: F.when(s != F.lit(INF), s + 1.0),
        merge="min", max_iter=max_iter, accept=lambda attr, _msg: attr == F.lit(INF))
    return out.select("id", F.col("attr").alias("dist"))


def connected_components(edges: DataFrame, max_iter: int = 2 ** 31 - 1) -> DataFrame:
    """(id, component): the smallest id that can be reached when directions are ignored, as a Pregel
    program that sends labels to either end of an edge, where smaller ones are received."""
    verts = graph_from_edges(edges.select("src", "dst")).select("id", F.col("id").cast("long").alias("attr"))
    out = pregel(edges.select("src", "dst"), verts, 2 ** 63 - 1, vprog=F.least,
                 send_msg=lambda s, _d, _e: s, send_to_src=lambda _s, d, _e: d, max_iter=max_iter, accept=lambda attr, msg: msg < attr)
    return out.select("id", F.col("attr").alias("component"))


def shortest_paths(edges: DataFrame, root: int, max_iter: int = 2 ** 31 - 1) -> DataFrame:
    """(id, dist double): least sum of edge attributes (>= 0) on a directed path from ``root``; +inf
    where there is none."""
    verts = graph_from_edges(edges.select("src", "dst")).select(
        "id", F.when(F.col("id") == F.lit(int(root)), F.lit(0.0)).otherwise(F.lit(INF)).alias("attr"))
    weighted = edges.select("src", "dst", F.col("attr").cast("double").alias("attr"))
    out = pregel(weighted, verts, INF, vprog=F.least, send_msg=lambda s, _d, w: F.when(s != F.lit(INF), s + w), max_iter=max_iter, accept=lambda attr, msg: msg < attr)
    return out.select("id", F.col("attr").alias("dist"))
