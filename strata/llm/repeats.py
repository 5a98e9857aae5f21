"""Removal of repeated 100-byte strings by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a 100-byte string that also starts earlier in the corpus.  The corpus is
never sorted as a whole:

1. ``copies``     texts that equal an earlier one are settled as a whole.
2. ``anchors``    each 100-byte window names one 32-byte string in it (the least by hash); equal
                  windows name the same one at the same place, so only windows whose anchor occurs
                  again can repeat.
3. ``contexts``   the stretches around repeated anchors go to suffix buckets by anchor hash.
4. ``classes``    a bucket sorts its suffixes: by their first 32 bytes, one block of them at a time,
                  and long ties by the ranks of a difference-cover sample, which is sorted first.
                  Memory is bounded by the bucket, and a frequent anchor is dealt to many buckets.
5. ``spans``      of equal windows all but the earliest are marked; marks are merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import mix64, ranges, slices, small_batches, staged, whole_text

WINDOW, ANCHOR = 100, 32
#: A perfect difference set: any two positions have exactly one common shift into the cover.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Windows sorted at a time; occurrences of an anchor that one bucket takes.
BLOCK, OCCURRENCES = 1 << 18, 100_000
#: Anchors that a task gathers before it sends them.
ENTRIES = 1 << 19
_KEY = "k bigint, dh int"
_SPAN = WINDOW - ANCHOR + 1


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of all ANCHOR-byte strings, by doubling."""
    h, width = mix64(buf.astype(np.uint64) + np.uint64(1)), 1
    while width < ANCHOR:
        h = h[:len(h) - width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    return mix64(h)


def anchors(buf: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (``doc``: text number of each byte): hash and place of every anchor, and
    the first and last start of the windows that name it."""
    if len(buf) < WINDOW:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    h = _gram_hashes(buf)
    low = np.uint64((1 << max(20, len(buf).bit_length())) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is the least
    width = 1
    while 2 * width <= _SPAN:
        m = np.minimum(m[:len(m) - width], m[width:])
        width *= 2
    m = np.minimum(m[:len(m) - (_SPAN - width)], m[_SPAN - width:])
    place = (m & low).astype(np.int64)
    whole = doc[:len(place)] == doc[WINDOW - 1:]
    start = np.flatnonzero(whole)
    place = place[start]
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(start) != 1)] if len(place) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    return h[place[first]], place[first], start[first], start[last] if len(place) else start


def _concat(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    return b"".join(raw), np.repeat(np.arange(len(raw)), sizes), np.cumsum(sizes) - sizes


def repeated_anchors(texts: DataFrame, buckets: int, occurrences: int = OCCURRENCES) -> DataFrame:
    """``(k, dh, place, salts)`` of anchors whose string occurs again.  What repeats within a batch is
    known at once; of each anchor string of a batch one entry, with its count, goes to the bucket
    of its hash, so a bucket gets one entry for each batch however frequent the string is.  A batch is
    what a task reads until it has ``ENTRIES`` anchors; it makes one row for each bucket."""

    kind = np.dtype([("h", "<u8"), ("k", "<i8"), ("dh", "<i4"), ("p", "<i4"), ("n", "<i4"), ("known", "<i4")])

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        packed = np.concatenate(held)
        h = packed["h"]
        _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        one = np.zeros(len(h), bool)
        one[first] = True
        packed["n"], packed["known"] = np.where(one, count[back], 0), count[back] > 1
        # other occurrences are settled; they only pass through, by document
        to = np.where(one, h % np.uint64(buckets), mix64(packed["k"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0])
        parts = np.split(packed[order], cut[1:])
        return pa.RecordBatch.from_arrays([pa.array(to[order][cut], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["bucket", "entries"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for b in slices(whole, "text", 1 << 18):
                raw, doc, base = _concat(b.column("text").to_pylist())
                h, place, _, _ = anchors(np.frombuffer(raw, np.uint8), doc)
                if not len(h):
                    continue
                row, some = doc[place], np.zeros(len(h), kind)
                some["h"], some["k"], some["dh"], some["p"] = h, np.asarray(b.column("k"))[row], np.asarray(b.column("dh"))[row], place - base[row]
                held.append(some)
                n += len(h)
                if n >= ENTRIES:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def count(t: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(t.column("entries").to_pylist()), kind)
        sent = e["n"] > 0
        strings, back = np.unique(e["h"], return_inverse=True)
        total = np.bincount(back, weights=e["n"], minlength=len(strings))
        keep = (e["known"] > 0) | (sent & (total[back] > 1))
        salts = np.where(sent, -(-total[back] // occurrences), 0).astype(np.int64)
        e, salts = e[keep], salts[keep]
        return pa.table({"k": e["k"], "dh": e["dh"], "place": e["p"], "h": e["h"].astype(np.int64), "salts": salts})

    return texts.mapInArrow(emit, "bucket bigint, entries binary").groupBy("bucket").applyInArrow(count, f"{_KEY}, place int, h bigint, salts bigint")


def _words(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as big-endian numbers."""
    w = np.r_[buf, np.zeros(WINDOW + 3 * PERIOD + 64, np.uint8)].astype(np.uint64)
    for shift in (1, 2, 4):
        w = (w[:-shift] << np.uint64(8 * shift)) | w[shift:]
    return w


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by several keys, the first the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at the cover's positions by their first four periods (at least), -1
    elsewhere.  A sample's successor a period on is a sample too, so depth doubles by ranking pairs."""
    size = n + WINDOW + 2 * PERIOD
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    at = np.flatnonzero(inside[np.arange(min(size, len(words) - 24)) % PERIOD])
    rank = np.full(size + 4 * PERIOD, -1, np.int64)
    rank[at] = _ranked([words[at + 8 * i] for i in range(3)] + [words[np.minimum(at + 23, len(words) - 1)]])
    for step in (PERIOD, 2 * PERIOD):
        rank[at] = _ranked([rank[at], rank[at + step]])
    return rank


_SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


def _sorted_block(words: np.ndarray, rank: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``at`` in suffix order: by 32 bytes, then by quicksort of the ties on cover ranks - a suffix is
    compared with its pivot at their common shift, all ties of the block side by side."""
    keys = [words[at + 8 * i] for i in range(4)]
    order = np.lexsort(keys[::-1])
    at = at[order]
    new = np.ones(len(at), bool)
    if len(at) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    open_ = np.ones(len(at), bool)
    while True:
        size = np.bincount(group)
        live = np.flatnonzero(open_ & (size[group] > 1))
        if not len(live):
            return at
        g, x = group[live], at[live]
        first = np.flatnonzero(np.r_[True, np.diff(g) != 0])
        count = np.diff(np.r_[first, len(g)])
        pivot = np.repeat(x[first + (rng.random(len(first)) * count).astype(np.int64)], count)
        shift = _SHIFT[x % PERIOD, pivot % PERIOD]
        side = np.sign(rank[x + shift] - rank[pivot + shift])
        o = np.lexsort([side, g])
        at[live], side = x[o], side[o]
        open_[live[side == 0]] = False
        fresh = np.zeros(len(at), np.int64)
        fresh[live[1:]] = (side[1:] != side[:-1]) & (g[1:] == g[:-1])
        # a group keeps its place: numbers after a split move up
        bump = np.cumsum(fresh)
        group = group + bump


def classes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class numbers of the WINDOW-byte strings at ``at``: equal strings, equal numbers."""
    words = _words(buf)
    rank = cover_ranks(words, len(buf))
    rng = np.random.default_rng(1)
    out = np.empty(len(at), np.int64)
    lead = words[at]
    edges = np.unique(np.quantile(lead, np.linspace(0, 1, len(at) // BLOCK + 2)[1:-1], method="nearest")) if len(at) > BLOCK else np.zeros(0, np.uint64)
    bucket = np.searchsorted(edges, lead, "right")
    done = 0
    for b in range(len(edges) + 1):
        mine = np.flatnonzero(bucket == b)
        if not len(mine):
            continue
        x = _sorted_block(words, rank, at[mine], rng)
        new = np.ones(len(x), bool)
        if len(x) > 1:
            new[1:] = np.any([words[x[1:] + i] != words[x[:-1] + i] for i in (*range(0, WINDOW - 8, 8), WINDOW - 8)], axis=0)
        number = np.cumsum(new) + done
        done = int(number[-1])
        back = np.argsort(at[mine], kind="stable")
        out[mine[back]] = number[np.argsort(x, kind="stable")]
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def contexts(found: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, k, dh, lo, n, salts, ctx)``: for rows ``(k, dh, text, spots)`` the stretch of all
    windows that name a repeated anchor.  Within a batch equal stretches travel once; the others are
    settled (``ctx`` null, bytes [lo, lo + n) go), those of a text that meet as one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                raw, doc, base = _concat(b.column("text").to_pylist())
                h, place, lo, hi = anchors(np.frombuffer(raw, np.uint8), doc)
                h = h.astype(np.int64)
                spots = b.column("spots")
                spot_row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(spots.offsets)))
                flat = spots.flatten()
                hot = base[spot_row] + np.asarray(flat.field("place"))
                salt_of = dict(zip(hot.tolist(), np.asarray(flat.field("salts")).tolist(), strict=True))
                use = np.flatnonzero(np.isin(place, hot))
                if not len(use):
                    continue
                k, dh = np.asarray(b.column("k")), np.asarray(b.column("dh"))
                row = doc[place[use]]
                order = np.lexsort([lo[use], dh[row], k[row]])
                seen: dict[bytes, int] = {}
                cols: list[list] = [[] for _ in range(7)]
                settled: list[list[int]] = []
                for u, r in zip(use[order].tolist(), row[order].tolist(), strict=True):
                    a, z = int(lo[u]), int(hi[u]) + WINDOW
                    ctx = raw[a:z]
                    own = (int(k[r]), int(dh[r]), a - int(base[r]))
                    salts = salt_of[int(place[u])]
                    if (prev := seen.get(ctx)) is not None and prev != own:
                        if settled and settled[-1][:2] == [own[0], own[1]] and own[2] <= settled[-1][3]:
                            settled[-1][3] = max(settled[-1][3], own[2] + z - a)
                        else:
                            settled.append([*own, own[2] + z - a])
                        continue
                    seen[ctx] = own
                    cols[0].append(int(h[u] % buckets) + (buckets * (1 + hash(own) % salts) if salts > 1 else 0))
                    for c, v in zip(cols[1:], (*own, z - a, salts, ctx), strict=True):
                        c.append(v)
                for r0, r1, lo0, end in settled:  # they may go anywhere
                    for c, v in zip(cols, (hash((r0, r1, lo0)) % buckets, r0, r1, lo0, end - lo0, 1, None), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                     pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.binary())], names=["bucket", "k", "dh", "lo", "n", "salts", "ctx"])

    return found.mapInArrow(emit, f"bucket bigint, {_KEY}, lo bigint, n bigint, salts bigint, ctx binary")


def marks(ctx: DataFrame) -> DataFrame:
    """``(k, dh, lo, hi, w1, w2)``: byte ranges to remove.  Of an anchor dealt to several buckets each
    bucket's earliest windows come with the hash of their bytes, to be compared across buckets."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        k, dh, lo, n, salts = (np.asarray(t.column(c)) for c in ("k", "dh", "lo", "n", "salts"))
        open_ = np.flatnonzero(np.asarray(t.column("ctx").is_valid()))
        settled = np.flatnonzero(~np.asarray(t.column("ctx").is_valid()))
        parts = [(k[settled], dh[settled], lo[settled], lo[settled] + n[settled])]
        shown: list[tuple] = []
        if len(open_):
            open_ = open_[np.lexsort([lo[open_], dh[open_], k[open_]])]
            strings = t.column("ctx").take(pa.array(open_)).to_pylist()
            first: dict[bytes, int] = {}
            lead = np.array([first.setdefault(s, i) for i, s in enumerate(strings)])
            a, b = open_, open_[lead]
            later = (k[a] != k[b]) | (dh[a] != dh[b]) | (lo[a] != lo[b])
            parts.append((k[a[later]], dh[a[later]], lo[a[later]], lo[a[later]] + n[a[later]]))
            one = np.array(sorted(first.values()))
            own = open_[one]
            buf = np.frombuffer(b"".join(strings[i] for i in one.tolist()), np.uint8)
            start = np.cumsum(n[own]) - n[own]
            wins = n[own] - WINDOW + 1
            at = ranges(start, wins)
            who = np.repeat(np.arange(len(own)), wins)
            place = lo[own][who] + at - start[who]
            cls = classes(buf, at)
            order = np.lexsort([place, dh[own][who], k[own][who], cls])
            head = np.r_[True, np.diff(cls[order]) != 0]
            lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            gone = np.zeros(len(at), bool)
            w = who[order]
            gone[order] = (place[order] != place[lead]) | (k[own][w] != k[own][who[lead]]) | (dh[own][w] != dh[own][who[lead]])
            a, z = _runs(gone)
            cut = np.flatnonzero(np.diff(who)) + 1  # runs end with their stretch
            if len(a):
                edge = np.unique(np.r_[a, cut])
                edge = edge[gone[edge]]
                stop = np.minimum(z[np.searchsorted(z, edge, "right")], np.r_[cut, len(at)][np.searchsorted(cut, edge, "right")])
                o = own[who[edge]]
                parts.append((k[o], dh[o], place[edge], place[stop - 1] + WINDOW))
            split = np.flatnonzero(head[np.argsort(order)] & (salts[own][who] > 1))
            for x in split.tolist():
                d = hashlib.blake2b(buf[at[x]:at[x] + WINDOW].tobytes(), digest_size=16).digest()
                o = own[who[x]]
                shown.append((k[o], dh[o], place[x], place[x] + WINDOW, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        cols = [np.concatenate([p[i] for p in parts] + [np.array([s[i] for s in shown], np.int64)]) for i in range(4)]
        none = sum(len(p[0]) for p in parts)
        return pa.table({"k": pa.array(cols[0], pa.int64()), "dh": pa.array(cols[1], pa.int32()), "lo": pa.array(cols[2], pa.int64()), "hi": pa.array(cols[3], pa.int64()),
                         "w1": pa.array([None] * none + [s[4] for s in shown], pa.int64()), "w2": pa.array([None] * none + [s[5] for s in shown], pa.int64())})

    return ctx.groupBy("bucket").applyInArrow(run, f"{_KEY}, lo bigint, hi bigint, w1 bigint, w2 bigint")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", occurrences: int = OCCURRENCES) -> tuple[DataFrame, DataFrame]:
    """The texts ``(doc_id, k, dh, text)`` and the byte ranges to remove ``(k, dh, spans)``."""
    spark = docs.sparkSession
    small_batches(docs)
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = whole_text(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.hash(text).alias("dh"), text.alias("text"))
    same = base.filter(F.octet_length("text") >= WINDOW).select("k", "dh", F.md5("text").alias("m"), F.octet_length("text").alias("n")).distinct()
    first = same.groupBy("m", "n").agg(F.min(F.struct("k", "dh")).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    copies = staged(same.join(first, ["m", "n"]).filter((F.col("k") != F.col("f.k")) | (F.col("dh") != F.col("f.dh"))).select("k", "dh", F.col("n").cast("long").alias("n")))
    singles = base.join(copies.select("k", "dh"), ["k", "dh"], "left_anti").select("k", "dh", "text")
    again = staged(repeated_anchors(singles, buckets, occurrences))
    often = staged(again.filter("salts > 1").select("h", "salts").distinct())  # one row for each very frequent string
    again = again.drop("salts").join(often, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    spots = staged(again.groupBy("k", "dh").agg(F.collect_list(F.struct("place", "salts")).alias("spots")))
    found = contexts(base.join(spots, ["k", "dh"]).select("k", "dh", "text", "spots"), buckets)
    got = staged(marks(found))
    # Marks without a hash stand alone; of windows with one (few) the earliest stays.
    turn = F.row_number().over(Window.partitionBy("w1", "w2").orderBy("k", "dh", "lo"))
    later = got.filter(F.col("w1").isNotNull()).withColumn("turn", turn).filter("turn > 1")
    got = got.filter(F.col("w1").isNull()).select("k", "dh", "lo", "hi").union(later.select("k", "dh", "lo", "hi"))
    got = got.union(copies.select("k", "dh", F.lit(0).cast("long"), "n"))
    return base, got.groupBy("k", "dh").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, occurrences: int = OCCURRENCES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept])`` for every row.

    A byte is removed if a 100-byte string that covers it also starts earlier: in a smaller id, or
    earlier in the same text.  Null text is empty; a null id is smaller than any; rows that share an
    id and text are one document and get equal results, other rows that share an id are ordered
    by a hash of their text; an empty table gives no rows.  ``kept`` holds the remaining bytes."""
    base, spans = repeated_spans(docs, id_col, text_col, occurrences)
    both = base.join(spans, ["k", "dh"], "left").select("doc_id", "text", "spans")
    dtype = both.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, cut in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                gone = spans_n = 0
                if cut:
                    parts, at = [], 0
                    end = -1
                    for lo, hi in sorted((c["lo"], c["hi"]) for c in cut):
                        if lo > end:
                            spans_n += 1
                            parts.append(raw[at:lo])
                        end = max(end, hi)
                        at = max(at, hi)
                    parts.append(raw[at:])
                    kept = b"".join(parts)
                    gone = len(raw) - len(kept)
                else:
                    kept = raw
                out.append((len(raw), gone, spans_n, hashlib.sha256(kept).hexdigest(), kept))
            cols = [b.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            n = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays(cols[:n], names=names[:n])

    return both.mapInArrow(run, f"doc_id {dtype}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else ""))
