"""The general Pregel loop against a plain loop over edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strata.operators import graph as G
from strata.plans import graph as GP


def plain_pregel(edges, attrs, initial, vprog, to_dst, to_src, merge, active="either", max_iter=1000):
    state = {v: vprog(a, initial) for v, a in attrs.items()}
    changed, rounds = None, 0
    while rounds < max_iter:
        msgs = {}
        for s, d, w in edges:
            if s not in state or d not in state:
                continue
            ends = (changed is None or s in changed, changed is None or d in changed)
            if not {"out": ends[0], "in": ends[1], "either": any(ends), "both": all(ends)}[active]:
                continue
            for to, send in ((d, to_dst), (s, to_src)):
                m = send and send(state[s], state[d], w)
                if m is not None:
                    msgs[to] = merge(msgs[to], m) if to in msgs else m
        if not msgs:
            break
        state |= {v: vprog(state[v], m) for v, m in msgs.items()}
        changed, rounds = set(msgs), rounds + 1
    return state


def tables(spark, edges, attrs):
    return (spark.createDataFrame(edges, "src long, dst long, attr long"), spark.createDataFrame(list(attrs.items()), "id long, attr long"))


def test_an_edge_runs_when_its_destination_changed(spark):
    """Vertex 2 keeps asking its sources for as long as it changes."""
    edges, attrs = [(1, 2, 0), (3, 2, 0)], {1: 100, 2: 0, 3: 7}
    rules = dict(vprog=lambda a, m: a + m, initial=0, merge=lambda a, b: a + b, to_src=None, to_dst=lambda s, d, w: s if d < 100 else None)
    want = plain_pregel(edges, attrs, **rules)
    e, v = tables(spark, edges, attrs)
    got = GP.pregel(e, v, 0, lambda a, m: a + m, lambda s, d, w: F.when(d < 100, s), merge="sum")
    assert {r.id: r.attr for r in got.collect()} == want and want[2] == 107
    # two rounds are needed here, and only the destination changes
    rules["to_dst"] = lambda s, d, w: s if d < 110 else None
    want = plain_pregel(edges, attrs, **rules)
    got = GP.pregel(e, v, 0, lambda a, m: a + m, lambda s, d, w: F.when(d < 110, s), merge="sum")
    assert {r.id: r.attr for r in got.collect()} == want and want[2] == 214


@pytest.mark.parametrize("active", ["either", "out", "in", "both"])
@pytest.mark.parametrize("threshold", [None, 3])
def test_two_way_program_like_the_plain_loop(spark, active, threshold):
    rnd = random.Random(7)
    edges = [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 9)) for _ in range(45)] + [(50, i, 1) for i in range(12)] + [(i, 51, 2) for i in range(10)] + [(60, 61, 1), (1, 999, 1)]
    attrs = {i: rnd.randint(0, 40) for s, d, _ in edges for i in (s, d) if i != 999}
    want = plain_pregel(edges, attrs, 5, lambda a, m: max(a, m), lambda s, d, w: s - w if s - w > d else None,
                        lambda s, d, w: d - 2 * w if d - 2 * w > s else None, max, active)
    e, v = tables(spark, edges, attrs)
    got = GP.pregel(e, v, 5, F.greatest, lambda s, d, w: F.when(s - w > d, s - w), "max", send_to_src=lambda s, d, w: F.when(d - 2 * w > s, d - 2 * w),
                    active=active, threshold=threshold)
    assert {r.id: r.attr for r in got.collect()} == want


def test_struct_state_own_merge_and_round_limit(spark):
    """Attributes are structs, messages are merged by an aggregate of the caller's."""
    edges = [(i, i + 1, i % 3) for i in range(12)]
    e, _ = tables(spark, edges, {0: 0})
    v = spark.range(13).select("id", F.struct(F.col("id").alias("top"), F.lit(0).cast("long").alias("hops")).alias("attr"))

    def vprog(a, m):
        return F.when(m["top"] > a["top"], m).otherwise(a)

    def back(s, d, w):
        return F.when(d["top"] > s["top"], F.struct(d["top"].alias("top"), (d["hops"] + 1).alias("hops")))

    first = F.struct(F.lit(-1).cast("long").alias("top"), F.lit(0).cast("long").alias("hops"))
    for rounds in (0, 3, 100):
        got = GP.pregel(e, v, first, vprog, None, merge=lambda m: F.max(m), send_to_src=back, max_iter=rounds).collect()
        assert {r.id: (r.attr.top, r.attr.hops) for r in got} == {i: (min(i + rounds, 12), min(rounds, 12 - i)) for i in range(13)}


def test_components_and_paths(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(0, 9)) for _ in range(50)] + [(70, 70, 1), (81, 80, 0)]
    verts = {x for s, d, _ in edges for x in (s, d)}
    e = spark.createDataFrame(edges, "src long, dst long, attr long")
    label = {v: v for v in verts}
    dist = {v: 0.0 if v == edges[0][0] else math.inf for v in verts}
    for _ in verts:
        for s, d, w in edges:
            label[s] = label[d] = min(label[s], label[d])
            dist[d] = min(dist[d], dist[s] + w)
    assert {r.id: r.component for r in GP.connected_components(e).collect()} == label
    assert {r.id: r.dist for r in GP.shortest_paths(e, edges[0][0]).collect()} == dist
    assert GP.connected_components(e.limit(0)).count() == 0


def test_refused_arguments(spark):
    e, v = tables(spark, [(0, 1, 1)], {0: 0, 1: 1})
    for wrong in (dict(merge="first"), dict(active="all"), dict(send_msg=None)):
        args = dict(initial_msg=0, vprog=F.least, send_msg=lambda s, d, w: s) | wrong
        with pytest.raises(ValueError):
            GP.pregel(e, v, **args)


def test_bfs_rewrites_its_levels(spark):
    edges = [(i, i + 1) for i in range(3 * GP.COMPACT_EVERY + 1)] + [(5, 2), (9, 30), (40, 41)]
    e = spark.createDataFrame(edges, "src long, dst long")
    want = {x: math.inf for ed in edges for x in ed} | {0: 0.0}
    for _ in edges:
        for s, d in edges:
            want[d] = min(want[d], want[s] + 1)
    assert {r.id: r.dist for r in GP.bfs(e, 0).collect()} == want
    assert {r.id: r.dist for r in GP.bfs(e, 0, max_iter=3).collect()} == {v: d if d <= 3 else math.inf for v, d in want.items()}


def test_triplets_of_a_hub(spark):
    edges = [(0, i, i) for i in range(1, 200)] + [(i, 7, 1) for i in range(50)] + [(0, 0, 3), (3, 500, 1)]
    e, v = tables(spark, edges, {i: 10 * i for i in range(200)})
    got = sorted(map(tuple, G.triplets(e, v, threshold=20).collect()))
    assert got == sorted((s, d, w, 10 * s, 10 * d) for s, d, w in edges if d != 500)


@pytest.mark.parametrize("sort", [True, False])
def test_adjacency_chunks_by_position(spark, sort):
    rnd = random.Random(1)
    edges = [(1, 5)] * 700 + [(1, rnd.randint(0, 40)) for _ in range(300)] + [(2, i) for i in range(64)] + [(3, 1)] + [(4, 9)] * 129
    rows = G.adjacency(spark.createDataFrame(edges, "src long, dst long").repartition(5), sort=sort, max_chunk=64).orderBy("src", "chunk").collect()
    assert [(r.src, r.chunk) for r in rows] == [(1, c) for c in range(16)] + [(2, 0), (3, 0), (4, 0), (4, 1), (4, 2)]
    assert all(r.degree == len(r.dsts) == len(r.attrs) for r in rows)
    assert [r.degree for r in rows] == [64] * 15 + [40, 64, 1, 64, 64, 1]
    assert [r.offset for r in rows] == [sum(q.degree for q in rows[:i]) for i in range(len(rows))]
    flat = [(r.src, d) for r in rows for d in r.dsts]
    assert (flat if sort else sorted(flat)) == sorted(edges)


def test_adjacency_of_many_parallel_edges(spark):
    e = spark.range(300_000).select(F.lit(7).cast("long").alias("src"), (F.col("id") % 3).alias("dst"))
    rows = G.adjacency(e, max_chunk=1 << 12).orderBy("chunk").collect()
    assert max(r.degree for r in rows) <= 1 << 12 and len(rows) == -(-300_000 // (1 << 12))
    assert [d for r in rows for d in r.dsts] == [0] * 100_000 + [1] * 100_000 + [2] * 100_000


def test_edges_in_place_are_not_moved_or_sorted_again(spark):
    """A round's join moves vertices only: nothing between it and the cached edges."""
    edges = spark.range(3000).select((F.col("id") % 400).alias("src"), (F.col("id") * 7 % 900).alias("dst"))
    for threshold in (1000, 3):  # nothing hot, hot vertices
        salted, hot = G.spread(edges, ("src",), threshold)
        assert (hot["src"] is None) == (threshold == 1000)
        cached = GP.placed(salted, "src", hot["src"], 3000)
        joined = G.attach(cached, "src", spark.range(400).withColumn("a", F.lit(1)), hot["src"], hashed=True)
        assert joined.count() == 3000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("+- == Initial Plan ==")[0].splitlines()
        join = next(i for i, x in enumerate(lines) if "ShuffledHashJoin" in x)
        cache = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x)
        assert join < cache and not [x for x in lines[join:cache] if "Exchange" in x or "Sort " in x]
        cached.unpersist()


@pytest.mark.parametrize("threshold", [None, 2])
def test_messages_of_the_sender_alone(spark, threshold):
    """With ``accept`` the result is that of messages which look at both ends, hot senders or not."""
    rows = [(i, i + 1) for i in range(0, 20, 2)] + [(0, i) for i in range(30, 36)] + [(i, 40) for i in range(33, 39)] + [(50, 50), (51, 99), (1, 2), (1, 2)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    ids = spark.createDataFrame([(i,) for i in {x for r in rows for x in r} - {99}], "id long").select("id", F.col("id").alias("attr"))
    both = GP.pregel(edges, ids, 2 ** 63 - 1, F.least, lambda s, d, _e: F.when(s < d, s), send_to_src=lambda s, d, _e: F.when(d < s, d), threshold=threshold)
    alone = GP.pregel(edges, ids, 2 ** 63 - 1, F.least, lambda s, _d, _e: s, send_to_src=lambda _s, d, _e: d, threshold=threshold, accept=lambda attr, msg: msg < attr)
    got = {r["id"]: r["attr"] for r in alone.collect()}
    assert got == {r["id"]: r["attr"] for r in both.collect()}
    assert got[40] == got[3] == 0 and got[51] == 51
