"""N-gram Jaccard join with Bayesian candidate pruning.

1. ``sketch``       text -> MinHash values, size and fingerprint of its set of word 5-grams.
2. ``classes``      equal sets are one class (a copy costs one row, whatever the number of copies).
3. ``meetings``     classes that share a band of MinHash values; a bucket whose members all meet in
                    an earlier one is left out; large buckets are cut into blocks that meet in pairs.
4. ``judge``        in each meeting: MinHash values are compared a few at a time, a pair is dropped
                    once the posterior probability of reaching the threshold falls below the
                    tolerance.  Only then are the sets of the classes still in question made and
                    brought along, to verify the rest.  A meeting returns link counts and a
                    spanning forest of its links, so a dense group never becomes a row per pair.
5. ``components``   groups from the forests, by DataFrame joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import mix64, slices, small_batches, staged, whole_text, word_codes, word_hashes

WORDS, THRESHOLD = 5, 0.8
#: 32 bands of 4: a pair at the threshold shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
#: A pair is dropped when the posterior of reaching the threshold is below this.
TOLERANCE, STEP = 1e-6, 16
BLOCK = 512
_K = BANDS * ROWS
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, _K, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, _K, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; a text of fewer words is one n-gram, a
    text without words has none."""
    codes, distinct, sizes = word_codes(texts)
    h = word_hashes(distinct)[codes]
    out, at = [], 0
    for n in sizes.tolist():
        x = h[at:at + n]
        at += n
        s = x[:max(n - words + 1, min(n, 1))].copy()
        for i in range(1, min(words, n)):
            s = s * _P + x[i:i + len(s)]
        out.append(np.unique(mix64(s)))
    return out


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(_K, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(low, (_A[:, None] * x[None, lo:lo + 2048] + _B[:, None]).min(1), out=low)
    return low


def sketch(docs: DataFrame, values: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f1, f2, n, <values>)``: fingerprint and size of the n-gram set, and its MinHash
    values (``sig``, little-endian uint32) or the set itself (``grams``, uint64, sorted)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    small_batches(docs)
    pack = {"sig": minhash, "grams": lambda s: s}[values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                sets = shingles(b.column("text").to_pylist())
                f1 = [int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                f2 = [int(mix64(s ^ _P).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([pack(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "f1", "f2", "n", values])

    return rows.mapInArrow(run, f"doc_id bigint, f1 bigint, f2 bigint, n bigint, {values} binary")


def meetings(cls: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(band, key, lo, hi, cls)``: which classes meet where.  Members of a bucket are numbered and
    cut into blocks; each block meets itself and every other block of the bucket."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("key")))
    member = cls.filter("n > 0").select("cls", F.inline(bands))
    bucket = member.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("s2"))
    first = bucket.filter("m > 1").groupBy("m", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key", "m")
    # Numbers inside a bucket are only needed to deal its members to blocks; a salt does that
    # without bringing the bucket together.  A bucket of m members has ceil(m / block) blocks.
    blocks = F.ceil(F.col("m") / block).cast("int")
    here = member.join(staged(first), ["band", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi")))
    return here.select("band", "key", "own", "cls", F.inline(pairs))


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least m of n equal MinHash values for which P(J >= threshold) is at least the tolerance,
    under a flat prior: the posterior is Beta(m + 1, n - m + 1), its tail a binomial sum."""
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


def in_question(band: int, own: np.ndarray, sig: np.ndarray, sizes: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a meeting the later rows it may be linked to, after incremental pruning; pairs
    that share an earlier band are left to it, and in a meeting of two blocks only pairs across them
    count."""
    two = len(set(own.tolist())) > 1
    by_band = np.ascontiguousarray(sig).view(f"V{4 * ROWS}")
    need = {k: fewest_matches(k, threshold, tolerance) for k in range(STEP, _K + 1, STEP)}
    for i in range(len(sizes)):
        j = np.flatnonzero(own != own[i]) if two else np.arange(i + 1, len(sizes))
        j = j[j > i]
        j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i])]
        if band and len(j):
            j = j[~(by_band[j, :band] == by_band[i, :band]).any(1)]
        same = np.zeros(len(j), np.int64)
        for k in range(STEP, _K + 1, STEP):
            if not len(j):
                break
            same = same + (sig[j, k - STEP:k] == sig[i, k - STEP:k]).sum(1)
            keep = same >= need[k]
            j, same = j[keep], same[keep]
        if len(j):
            yield i, j


def judge(band: int, own: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) among the rows of one meeting: pairs still in question, verified on the sets."""
    found_i, found_j = [np.zeros(0, int)], [np.zeros(0, int)]
    sizes = np.array([len(s) for s in sets])
    for i, j in in_question(band, own, sig, sizes, threshold, tolerance):
        both = np.concatenate([sets[x] for x in j])
        at = np.searchsorted(sets[i], both)
        hit = sets[i][np.minimum(at, len(sets[i]) - 1)] == both
        common = np.add.reduceat(hit, np.r_[0, np.cumsum(sizes[j])[:-1]], dtype=np.int64)
        linked = j[common >= threshold * (sizes[j] + sizes[i] - common) - 1e-9]
        found_i.append(np.full(len(linked), i))
        found_j.append(linked)
    return np.concatenate(found_i), np.concatenate(found_j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root, edges = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            edges.append((a, b))
    return edges


def links(docs: DataFrame, cls: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``(cls, other, n, m)`` from every meeting of the classes ``(cls, copies, f1, f2, n, sig)``: rows
    with ``other`` null give ``n`` linked documents (copies counted, in ``m`` classes) of ``cls`` found
    there, the others are edges of the meeting's forest.  ``docs`` are the texts ``(doc_id, text)``."""
    where = ["band", "key", "lo", "hi"]

    def prune(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, sizes = np.asarray(t.column("own")), np.asarray(t.column("n"))
        alive = np.zeros(len(own), bool)
        if len(own) > 1 and (t.column("lo")[0] == t.column("hi")[0] or len(set(own.tolist())) > 1):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(own), -1)
            for i, j in in_question(t.column("band")[0].as_py(), own, sig, sizes, threshold, tolerance):
                alive[i] = alive[j] = True
        return t.select([*where, "own", "cls"]).filter(pa.array(alive))

    met = meetings(cls.select("cls", "n", "sig"), block).join(cls.select("cls", "n", "sig"), "cls")
    met = staged(met.groupBy(*where).applyInArrow(prune, "band int, key bigint, lo int, hi int, own int, cls bigint"))
    wanted = staged(met.select("cls").distinct())
    grams = sketch(docs.join(wanted, docs["doc_id"] == wanted["cls"], "left_semi"), "grams").withColumnRenamed("doc_id", "cls")
    full = cls.join(grams, ["cls", "f1", "f2", "n"]).dropDuplicates(["cls"]).select("cls", "copies", "sig", "grams")
    met = met.join(full, "cls")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, copies = np.asarray(t.column("cls")), np.asarray(t.column("copies"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        sets = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        own, lo, hi = np.asarray(t.column("own")), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        none = len(ids) < 2 or (lo != hi and len(set(own.tolist())) < 2)
        i, j = (np.zeros(0, int), np.zeros(0, int)) if none else judge(t.column("band")[0].as_py(), own, sig, sets, threshold, tolerance)
        n = np.bincount(np.r_[i, j], weights=copies[np.r_[j, i]], minlength=len(ids)).astype(np.int64)
        m = np.bincount(np.r_[i, j], minlength=len(ids))
        edges = _forest(len(ids), i, j)
        has = np.flatnonzero(m)
        a, b = ids[[e[0] for e in edges]].tolist() if edges else [], ids[[e[1] for e in edges]].tolist() if edges else []
        return pa.table({"cls": pa.array(ids[has].tolist() + a, pa.int64()), "other": pa.array([None] * len(has) + b, pa.int64()),
                         "n": pa.array(n[has].tolist() + [0] * len(a), pa.int64()), "m": pa.array(m[has].tolist() + [0] * len(a), pa.int64())})

    return met.groupBy(*where).applyInArrow(run, "cls bigint, other bigint, n bigint, m bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(id, group)`` of the vertices of edges ``(a, b)``: the smallest id of the component.

    Each round links every vertex, and the smallest it knows, to the smallest of its neighbours
    (large-star and small-star); it ends when no edge changes, after about log n rounds."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).select("col.*")
        edges = staged(small.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            roots = edges.select(F.col("b").alias("id")).distinct()
            return edges.toDF("id", "group").union(roots.select("id", F.col("id").alias("group")))
        mark = now


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, copy_id, n_links)``, one row per document.

    ``n_links`` counts the other documents whose word 5-gram set has a Jaccard similarity of at
    least ``threshold`` with this one's, copies among them; ``class_id`` is the smallest id of the
    linked group, ``copy_id`` that of the documents with the same set.  Texts without words
    (null, empty) are linked to nothing.  Rows without an id take no part; of rows that repeat an
    id one counts; other columns are ignored, whatever their names."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    drawn = staged(sketch(texts, "sig"))
    slim = drawn.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("s")).select("doc_id", "s.*")
    by_set = ["f1", "f2", "n"]
    heads = staged(slim.filter("n > 0").groupBy(*by_set).agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("copies")))
    cls = staged(heads.join(drawn.withColumnRenamed("doc_id", "cls"), ["cls", *by_set]).dropDuplicates(["cls"]).select("cls", "copies", *by_set, "sig"))
    found = staged(links(texts, cls, threshold, tolerance, block))
    count = found.filter("other is null").groupBy("cls").agg(F.sum("n").alias("others"))
    group = components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    known = heads.join(count, "cls", "left").join(group.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.select(*by_set, F.col("cls").alias("copy_id"), F.coalesce("group", "cls").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return slim.join(known, by_set, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that are the first of their group; rows without an id stay."""
    out = staged(joined.filter("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(out, F.col(id_col) == F.col("_gone"), "left_anti")
