"""Benchmark decontamination by greedy string tiling.

Documents and test items are token sequences.  Shared runs of ``SEED`` tokens join them; for a pair
whose seeds could cover enough of the item, running Karp-Rabin matching marks the longest common
stretches that don't overlap, again and again, down to the seed length.  A document is
contaminated by an item if its tiles cover enough of the item, in whatever order they stand.

The items travel to the documents in blocks of bounded size (one pass over the documents each), so
the documents are never shuffled and no number of items is too large.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import mix64, slices, small_batches, staged, unused, whole_text, word_codes

#: Tokens of the shortest tile; share of an item's tokens that contaminates, and the least tokens.
SEED, COVERAGE, LEAST = 4, 0.5, 8
#: Characters of test items that one pass carries.
BLOCK_CHARS = 16_000_000
_P = np.uint64(0x9E3779B97F4A7C15)


def tiles(item: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling ``(item start, text start, length)``; 0 is a token that matches nothing.

    A pass looks for common stretches of at least ``s`` unmarked tokens by the Karp-Rabin hash of
    ``s`` tokens; it marks them from the longest down, cutting those that were partly marked
    meanwhile; then ``s`` is halved, down to ``least``."""
    free_i, free_t = [x != 0 for x in item], [x != 0 for x in text]
    out: list[tuple[int, int, int]] = []
    base, mod = 1_000_003, (1 << 61) - 1

    def runs(tokens: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
        top, h, run = pow(base, s - 1, mod), 0, 0
        for k, x in enumerate(tokens):
            if not free[k]:
                h = run = 0
                continue
            if run >= s:
                h = (h - tokens[k - s] * top) % mod
            h, run = (h * base + x) % mod, run + 1
            if run >= s:
                yield k - s + 1, h

    s = max(least, min(len(item), len(text)))
    while True:
        at = defaultdict(list)
        for k, h in runs(item, free_i, s):
            at[h].append(k)
        heap = []
        for t, h in runs(text, free_t, s):
            for i in at.get(h, ()):
                if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                    continue  # part of the stretch that starts one token earlier
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= s:
                    heapq.heappush(heap, (-n, i, t))
        while heap:
            n, i, t = heapq.heappop(heap)
            n, parts, start = -n, [], None
            for k in range(n + 1):
                live = k < n and free_i[i + k] and free_t[t + k]
                if live and start is None:
                    start = k
                elif not live and start is not None:
                    parts.append((start, k - start))
                    start = None
            if parts == [(0, n)]:
                out.append((i, t, n))
                free_i[i:i + n] = free_t[t:t + n] = [False] * n
            else:
                for k, size in parts:
                    if size >= s:
                        heapq.heappush(heap, (-size, i + k, t + k))
        if s == least:
            return sorted(out)
        s = max(least, s // 2)


class Items:
    """A block of test items with its vocabulary and seeds."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED, coverage: float = COVERAGE, least: int = LEAST):
        self.seed, self.number = seed, {}
        self.ids = [i for i, _ in items]
        codes, words, sizes = word_codes([t for _, t in items])
        numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
        flat = numbers[codes] if len(codes) else codes
        ends = np.cumsum(sizes)
        self.tokens = [flat[e - n:e].tolist() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        self.needed = [max(-int(-coverage * n // 1), min(least, n), 1) for n in sizes.tolist()]
        rows = [self.keys(np.array(t, np.int64)) for t in self.tokens]
        key = np.concatenate([k for _, k in rows] or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(rows)), [len(k) for _, k in rows])
        place = np.concatenate([p for p, _ in rows] or [np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]

    def keys(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of ``seed`` known tokens."""
        n = len(numbers) - self.seed + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = numbers != 0
        h, full = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.seed):
            h = h * _P + numbers[k:k + n].astype(np.uint64)
            full &= known[k:k + n]
        at = np.flatnonzero(full)
        return at, mix64(h[at])

    def covered(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, covered tokens, tiles)`` of the items that contaminate one document."""
        at, key = self.keys(numbers)
        if not len(at) or not len(self.key):
            return []
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        if not (hi > lo).any():
            return []
        hit = np.repeat(np.arange(len(at)), hi - lo)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        out = []
        for i in np.unique(self.item[entry]).tolist():
            mine = self.item[entry] == i
            spots = np.unique((self.place[entry[mine]][:, None] + np.arange(self.seed)).ravel())
            if len(spots) < self.needed[i]:  # tiles cover seeded tokens only
                continue
            where = np.unique((at[hit[mine]][:, None] + np.arange(self.seed)).ravel())
            gap = np.r_[True, np.diff(where) > 1]  # stretches without a seed can't hold a tile
            text = np.insert(numbers[where], np.flatnonzero(gap), 0).tolist()
            found = tiles(self.tokens[i], text, self.seed)
            got = sum(n for *_, n in found)
            if got >= self.needed[i]:
                out.append((i, got, len(found)))
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """All test items in blocks of about ``block_chars`` characters, by hash."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), whole_text(text_col).alias("t")).filter("t <> ''").distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    for b in range(n):
        yield sorted((-1 if r["i"] is None else r["i"], r["t"]) for r in rows.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b).collect())


def _numbers(texts: list[str], items: Items) -> Iterator[np.ndarray]:
    codes, words, sizes = word_codes(texts)
    table = np.array([items.number.get(w, 0) for w in words], np.int64)
    flat = table[codes] if len(codes) else codes
    at = 0
    for n in sizes.tolist():
        yield flat[at:at + n]
        at += n


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """``(doc_id, item_id, n_tokens, covered, n_tiles)``: every contaminated document with each item
    that does it.

    Tokens stand between white space and lose case and marks.  Items without text, or of fewer
    tokens than a seed, contaminate nothing; null and empty documents are clean; repeated rows give
    repeated results; an empty table on either side gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id bigint, n_tokens bigint, covered bigint, n_tiles bigint"
    small_batches(docs)
    parts = []
    for block in blocks(benchmark):
        items = Items(block, **limits)

        def run(batches, items=items):
            for whole in batches:
                for b in slices(whole, "text", 1 << 20):
                    got = [(k, i, c, n) for k, x in enumerate(_numbers(b.column("text").to_pylist(), items)) for i, c, n in items.covered(x)]
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(pa.array([g[0] for g in got])), pa.array([items.ids[g[1]] for g in got], pa.int64()),
                             pa.array([len(items.tokens[g[1]]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                            names=["doc_id", "item_id", "n_tokens", "covered", "n_tiles"])

        parts.append(rows.mapInArrow(run, schema))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The documents that no item contaminates, with all their columns; rows are judged where they
    are read, so nothing is shuffled."""
    small_batches(docs)
    names, source = docs.columns, unused(docs)
    out = docs
    for n, block in enumerate(blocks(benchmark)):
        items = Items(block, **limits)

        def run(batches, items=items):
            for whole in batches:
                for b in slices(whole, source, 1 << 20):
                    keep = [not items.covered(x) for x in _numbers(b.column(source).to_pylist(), items)]
                    kept = b.filter(pa.array(keep))
                    yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(len(names))], names=names)

        out = (staged(out) if n else out).withColumn(source, whole_text(text_col)).mapInArrow(run, docs.schema)
    return out
