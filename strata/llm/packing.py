"""Best-fit packing of token sequences by large-item matching.

Packing looks only at lengths, and a length is an integer of 1..capacity, so the plan is made from
the histogram of lengths (at most ``capacity`` rows, whatever the corpus) and then handed out to
the rows by their rank within a length:

1. ``tokenize_pieces``  documents -> pieces (Arrow batches; ids, or only their checksum).
2. ``plan_packing``     histogram -> placements: runs of equally filled sequences.
3. ``place``            rank within each length, then one lookup in the placement table.

The plan: items above a third of the capacity are matched first, at most two in a sequence - each
item above a half takes the largest item that still fits beside it, the rest pair among themselves;
items up to a third then go, largest first, to the fullest sequence that still has room.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import gathered, ranges, slices, small_batches, staged, whole_text

CAPACITY = 2048
END_ID = 0
#: Words kept in a worker's cache of token ids (a bound on memory, never on results), some 200 bytes each.
CACHE_WORDS = 200_000
#: Bytes of text that share their look-ups (a longer text stays whole), words that are encoded and ids that
#: are gathered at once.
SLICE_BYTES, ENCODED, GATHER_IDS = 4 << 20, 1 << 13, 1 << 18


#: A word of plain Latin letters and marks after it: the vocabulary's pre-tokenizer reads the
#: letters, in lower case, and the marks as two separate pieces.
_PLAIN = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-&(-/:-@\[-^`{-~]*)$"


def _strings(words: pa.StringArray) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class WordCache:
    """Token ids of words.  The vocabulary's pre-tokenizer never joins across blanks, so a text's
    ids are those of its blank-separated words one after the other.  Beyond ``limit`` words those
    stay that were met again since the last time, the most frequent half of ``limit`` at most.  Letters of
    words, without case and marks, are kept apart and more compactly, and beyond twice ``limit``
    likewise the most frequent ``limit`` stay."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.clear()
        #: Words of lower-case letters, without a Python object each, and their ids one after the other.
        self.letters, self.letters_met = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.letters_ids, self.letters_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)  # slices that a word was met in again
        self.used = 0

    def shrink(self) -> None:
        """Forgets the words that were met once and those beyond the most frequent."""
        words, met = list(self.at), self.met[:len(self.at)]
        keep = np.flatnonzero(met)
        keep = np.sort(keep[np.argsort(-met[keep], kind="stable")[:self.limit // 2]])
        (start, size), met = self._rows(keep), met[keep] // 2
        ids = self.ids[ranges(start, size)]
        self.clear()
        self._store([words[i] for i in keep.tolist()], ids, size)
        self.met[:len(met)] = met

    def _store(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while n + len(words) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
            self.met = np.resize(self.met, 2 * len(self.met))
        self.met[n:n + len(words)] = 0
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[n + 1:n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.at.update(zip(words, range(n, n + len(words)), strict=True))

    def _rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[at], self.starts[at + 1] - self.starts[at]

    def _rows_of_letters(self, words: pa.StringArray) -> np.ndarray:
        """Rows of distinct words of lower-case letters among ``letters``.  New ones are encoded as
        texts of many and told apart by their end tokens."""
        if len(self.letters) > 2 * self.limit:
            keep = np.flatnonzero(self.letters_met)
            keep = np.sort(keep[np.argsort(-self.letters_met[keep], kind="stable")[:self.limit]])
            start, size = self.letters_starts[keep], np.diff(self.letters_starts)[keep]
            self.letters, self.letters_met = self.letters.take(pa.array(keep)), self.letters_met[keep] // 2
            self.letters_ids, self.letters_starts = self.letters_ids[ranges(start, size)], np.r_[0, np.cumsum(size)]
        at = pc.index_in(words, value_set=self.letters)
        new, rows = words.filter(at.is_null()), at.fill_null(-1).to_numpy().astype(np.int64)
        self.letters_met[rows[rows >= 0]] += 1
        if len(new):
            texts = (" ".join(_strings(new.slice(i, ENCODED))) for i in range(0, len(new), ENCODED))
            ids = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.uint32) for t in texts])
            sizes = np.diff(np.r_[-1, np.flatnonzero(self.ends[ids])])
            if len(sizes) != len(new):
                ids, sizes = self._singly(_strings(new))
            rows[rows < 0] = len(self.letters) + np.arange(len(new))
            self.letters = pa.concat_arrays([self.letters, new])
            self.letters_met = np.r_[self.letters_met, np.zeros(len(new), np.int32)]
            self.letters_ids = np.r_[self.letters_ids, ids]
            self.letters_starts = np.r_[self.letters_starts, self.letters_starts[-1] + np.cumsum(sizes)]
        return rows

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def add(self, words: list[str]) -> None:
        """``words`` are distinct and not known yet.  Plain ones are put together from their letters in
        lower case and their marks, all others are encoded singly."""
        found = pc.extract_regex(pa.array(words, pa.string()), _PLAIN)
        is_plain = found.is_valid()
        found = found.filter(is_plain)
        letters, marks = pc.utf8_lower(found.field("letters")).dictionary_encode(), found.field("marks").dictionary_encode()
        ends = _strings(marks.dictionary)
        other = [words[i] for i in np.flatnonzero(~np.asarray(is_plain)).tolist()]
        other = list(dict.fromkeys([*other, *(e for e in ends if e and e not in self.at)]))  # marks may stand alone, too
        if other:
            self._store(other, *self._singly(other))
        if len(found):
            rows = self._rows_of_letters(letters.dictionary)[letters.indices]
            start, size = self.letters_starts[rows], self.letters_starts[rows + 1] - self.letters_starts[rows]
            after = np.array([self.at[e] if e else -1 for e in ends], np.int64)[marks.indices]
            start_after, size_after = self._rows(np.maximum(after, 0))
            size_after[after < 0] = 0
            both = size + size_after
            begin = np.cumsum(both) - both
            ids = np.empty(int(both.sum()), np.uint32)
            ids[ranges(begin, size)] = self.letters_ids[ranges(start, size)]
            ids[ranges(begin + size, size_after)] = self.ids[ranges(start_after, size_after)]
            self._store([words[i] for i in np.flatnonzero(is_plain).tolist()], ids, both)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), each followed by END_ID, and the offset of each text's first id.
        Words are split and told apart in Arrow; only distinct ones are looked up."""
        if len(self.at) > self.limit:
            self.shrink()
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        first = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        distinct, codes = _strings(words.dictionary), words.indices.to_numpy()
        at = np.fromiter(map(self.at.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        self.met[at[at >= 0]] += 1
        if len(new := np.flatnonzero(at < 0)):
            missing = [distinct[i] for i in new.tolist()]
            self.add(missing)
            at[new] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(missing))
        start, size = self._rows(at)
        sizes, first = size[codes], first - first[0]
        lengths = np.diff(np.r_[0, np.cumsum(sizes)][first])
        offsets = np.r_[0, np.cumsum(lengths + 1)]
        out = np.full(int(offsets[-1]), END_ID, np.uint32)
        runs = np.flatnonzero(np.diff(offsets[:-1] // GATHER_IDS, prepend=-1)).tolist()
        for a, b in zip(runs, [*runs[1:], len(lengths)], strict=True):
            some = slice(int(first[a]), int(first[b]))
            out[ranges(offsets[a:b], lengths[a:b])] = self.ids[ranges(start[codes[some]], sizes[some])]
        return out, offsets


@functools.lru_cache(maxsize=1)
def _cache(path: str) -> WordCache:
    """One for each worker process, kept from task to task."""
    return WordCache(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, unless ``with_ids`` is
    off, ``ids`` (the tokens).  A null or empty text has the end token alone."""
    pieces = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    small_batches(docs)
    dtype = pieces.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {dtype}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        for whole in gathered(batches, SLICE_BYTES):
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, offsets = cache.encode(batch.column("text"))
                lengths = np.diff(offsets)
                n_pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), n_pieces)
                piece = ranges(np.zeros(len(lengths), np.int64), n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, lengths[row] - start)
                lo = offsets[row] + start
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:a + n]) for a, n in zip(lo.tolist(), length.tolist(), strict=True)]
                cols = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    return pieces.mapInArrow(cut, fields)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Placements ``(length, first_rank, n, per_bin, first_bin, offset)``: items of ``length`` with
    ranks first_rank..first_rank+n-1 go ``per_bin`` to a sequence, from ``first_bin`` on, at
    ``offset``.  The work is bounded by the number of distinct lengths, not of items."""
    left = {s: n for s, n in sorted(counts.items()) if n > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (room, first_bin, bins), sorted by room
    bins = 0

    def put(size: int, n: int, per: int, first: int, offset: int) -> None:
        out.append((size, rank[size], n, per, first, offset))
        rank[size] += n
        left[size] -= n

    def opened(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            bisect.insort(gaps, (room, first, n))

    third, half = capacity / 3, capacity / 2
    middle = [s for s in left if third < s <= half]
    for big in [s for s in reversed(left) if s > half]:
        while left[big] > 0:
            k = bisect.bisect_right(middle, capacity - big)
            mate = next((s for s in reversed(middle[:k]) if left[s] > 0), 0)
            n = min(left[big], left[mate]) if mate else left[big]
            put(big, n, 1, bins, 0)
            if mate:
                put(mate, n, 1, bins, big)
            opened(capacity - big - mate, bins, n)
            bins += n
    for size in reversed(middle):  # the rest pair with the largest left, equals first: any two fit
        while left[size] > 0:
            if left[size] >= 2:
                n = left[size] // 2
                put(size, 2 * n, 2, bins, 0)
                opened(capacity - 2 * size, bins, n)
                bins += n
                continue
            mate = next((s for s in reversed(middle) if s < size and left[s] > 0), 0)
            put(size, 1, 1, bins, 0)
            if mate:
                put(mate, 1, 1, bins, size)
            opened(capacity - size - mate, bins, 1)
            bins += 1
    for size in [s for s in reversed(left) if s <= third]:
        while left[size] > 0:
            at = bisect.bisect_left(gaps, (size, -1, -1))
            if at == len(gaps):
                fresh = -(-left[size] // (capacity // size))
                opened(capacity, bins, fresh)
                bins += fresh
                continue
            room, first, n_bins = gaps.pop(at)
            per = room // size
            full = min(n_bins, left[size] // per)
            if full:
                put(size, full * per, per, first, capacity - room)
                opened(room - per * size, first, full)
            rest = min(left[size], per - 1) if full < n_bins else 0
            if rest:
                put(size, rest, rest, first + full, capacity - room)
                opened(room - rest * size, first + full, 1)
                full += 1
            opened(room, first + full, n_bins - full)
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows with a ``length`` of 1..capacity.

    Ranks within a length come from two narrow steps, so a length that holds a third of all rows is
    spread over many tasks: rows are numbered inside (length, salt), and the salts' counts are
    summed up in a table of lengths x salts."""
    spark = pieces.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    rows = staged(rows)  # tokens are made once; counts and ranks read the same written rows
    per_salt = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    base = staged(per_salt.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
                  .select("length", "_salt", F.coalesce("_base", F.lit(0)).alias("_base"), "_n"))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = plan_packing(counts, capacity)
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_in", inside).join(base.drop("_n"), ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    runs = spark.createDataFrame(plan, "length bigint, _first bigint, _cnt bigint, _per bigint, _bin bigint, _off bigint")
    j = F.col("_rank") - F.col("_first")
    # The plan has a few rows per distinct length (bounded by ``capacity``), so it may be broadcast.
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & F.col("_rank").between(F.col("_first"), F.col("_first") + F.col("_cnt") - 1)).drop(runs["length"])
    return (placed.withColumn("sequence_id", F.col("_bin") + F.floor(j / F.col("_per")))
            .withColumn("offset", F.col("_off") + (j % F.col("_per")) * F.col("length"))
            .drop("_salt", "_in", "_base", "_rank", "_first", "_cnt", "_per", "_bin", "_off"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = True,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id,
    offset``; pieces of a sequence follow each other without gaps from 0.  A document longer than
    ``capacity`` is cut, the last piece may be shorter.  Null and empty texts give the end token
    alone; repeated rows are packed as often as they occur; an empty table gives no rows; other
    columns are ignored, whatever their names."""
    return place(tokenize_pieces(docs, tokenizer, capacity, with_ids, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token arrays to train on: ``sequence_id, ids, n_docs`` (a sequence has at most
    ``capacity`` tokens, so each group is small)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.size("p").alias("n_pieces"))
