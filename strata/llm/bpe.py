"""BPE encoding and decoding by batched numpy merge rounds.

A slice of texts is cut at white space and dictionary-encoded in Arrow, so each distinct chunk is
read once.  Its pieces (normalised, pre-tokenised) become byte symbols; the symbols of all distinct
pieces stand one after the other in one flat array.  A round finds the rank of every neighbouring
pair by binary search over the sorted pair keys, takes the lowest rank of each piece and merges
that pair wherever it stands in the piece; only pairs beside a merge are looked up anew.  Pieces
without a known pair leave the array.  Token ids are then gathered back: piece, chunk, text.

Merging all places of the lowest pair in one round equals merging them one at a time if no pair
that holds the merged token has a lower rank; for other vocabularies (``safe`` is false) only the
leftmost place of a piece is merged.  Pieces of more than ``LONG`` symbols (a few, such as ruled
lines) are merged one by one with a heap, so a round never walks a huge piece thousands of times.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ranges, slices, whole_text

#: A rank above all others: no such pair.
NONE = np.iinfo(np.int32).max
LONG = 1024
#: Characters below this point are their own composed form, whatever stands beside them.
COMPOSED_BELOW = 0x300


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable
    and no blank, else the next letter from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary file -> ids of texts and texts of ids.

    Reads byte-level BPE files whose pre-tokenizer keeps the matches of one pattern, none of them
    with white space; anything else raises."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        kinds = [s["type"] for s in steps]
        if model["type"] != "BPE" or kinds != ["Split", "ByteLevel"] or steps[1]["use_regex"] or spec["decoder"] or not steps[0]["invert"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not a vocabulary that this operator reads")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options are not supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"] + "|\n")
        self.odd = regex.compile("|".join([f"[^\\x00-\\u{COMPOSED_BELOW - 1:04x}]", *map(regex.escape, self.added)]))
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inner = np.array([vocab[c] for c in self.letters], np.int32)
        self.last = np.array([vocab[c + end] for c in self.letters], np.int32)
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        names = [""] * self.size
        for name, i in (vocab | self.added).items():
            names[i] = name
        self.names = pa.array(names, pa.string())
        pairs = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], rank[order]
        self.merged = np.zeros(len(model["merges"]) + 1, np.int32)
        self.merged[rank] = [vocab[a + b] for a, b in pairs]
        first_use = np.full(self.size, NONE, np.int64)
        np.minimum.at(first_use, key // self.size, rank)
        np.minimum.at(first_use, key % self.size, rank)
        self.safe = first_use[self.merged] > np.arange(len(self.merged))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of pieces one after the other and their numbers -> the same after all merges."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done = []
        if (long := sizes > LONG).any():
            at = np.cumsum(sizes) - sizes
            for w in np.flatnonzero(long):
                ids = self.merge_long(sym[at[w]:at[w] + sizes[w]].tolist())
                done.append((np.array(ids, np.int32), np.full(len(ids), w)))
            sym, word = sym[~long[word]], word[~long[word]]
        rank = np.full(len(sym), NONE, np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self.pair_ranks(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(sym)]))
            ended = least == NONE
            if ended.any():
                done.append((sym[ended], word[ended]))
                sym, word, rank, least = (x[~ended] for x in (sym, word, rank, least))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            place = np.arange(len(at))
            in_run = place - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], place, 0))
            at = at[in_run % 2 == 0]  # of pairs that overlap (aaa) the first, third, ... merge
            if not (safe := self.safe[rank[at]]).all():
                at = at[safe | np.r_[True, word[at[1:]] != word[at[:-1]]]]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            beside = np.r_[at, at[at > 0] - 1]
            rank[beside] = NONE
            beside = beside[beside + 1 < len(sym)]
            beside = beside[word[beside] == word[beside + 1]]
            rank[beside] = self.pair_ranks(sym[beside], sym[beside + 1])
        if not done:
            return sym, np.zeros(len(sizes), np.int64)
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    @functools.cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def merge_long(self, sym: list[int]) -> list[int]:
        """One piece: the lowest pair, leftmost first, from a heap over a linked list."""
        n, rank_of, size = len(sym), self.rank_of, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank_of.get(sym[i] * size + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (s := rank_of.get(sym[x] * size + sym[y])) is not None:
                    heapq.heappush(heap, (s, x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    def split(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all chunks, and how many each has.  An added token is a piece after a line feed."""
        joined, odd = "\n".join(chunks), []
        if hits := [m.start() for m in self.odd.finditer(joined)]:
            starts = np.cumsum(np.r_[0, np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1])
            odd = np.unique(np.searchsorted(starts, hits, "right") - 1).tolist()
            plain = list(chunks)
            for i in odd:
                plain[i] = ""
            joined = "\n".join(plain)
        found = self.pieces.findall(joined.lower())
        if not odd:
            ends = np.array([p == "\n" for p in found], bool)
        else:
            parts: list[list[str]] = [[]]
            for p in found:
                parts.append([]) if p == "\n" else parts[-1].append(p)
            for i in odd:
                parts[i] = self.split_odd(chunks[i])
            found = []
            for p in parts:
                found += p
                found.append("\n")
            found.pop()
            ends = np.array([p == "\n" for p in found], bool)
        cuts = np.r_[-1, np.flatnonzero(ends), len(found)]
        return [p for p in found if p != "\n"], np.diff(cuts) - 1

    def split_odd(self, chunk: str) -> list[str]:
        out = []
        for part in self.find_added.split(chunk) if self.find_added else [chunk]:
            if part in self.added:
                out.append("\n" + part)
            elif part:
                out += [bytes(self.byte_of[c] for c in p).decode() for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without ASCII white space, one after the other, and how many each has."""
        pieces, per_chunk = self.split(chunks)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        added = {i: self.added[p[1:]] for i, p in enumerate(distinct) if p[0] == "\n"}
        data = pa.array(["x" if i in added else p for i, p in enumerate(distinct)], pa.string())
        offset = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1).astype(np.int64)
        raw = np.frombuffer(data.buffers()[2], np.uint8, offset[-1])
        sym = self.inner[raw]
        sym[offset[1:] - 1] = self.last[raw[offset[1:] - 1]]
        for i, token in added.items():
            sym[offset[i]] = token
        ids, sizes = self.merge(sym, np.diff(offset))
        starts = np.cumsum(sizes) - sizes
        chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
        return ids[ranges(starts[codes], sizes[codes])], np.bincount(chunk_of, sizes[codes], len(chunks)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one after the other, and the offset of each text's first."""
        lists = pc.ascii_split_whitespace(texts)
        first = lists.offsets.to_numpy().astype(np.int64)
        chunks = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        codes = chunks.indices.to_numpy()
        ids, sizes = self.encode_chunks(chunks.dictionary.to_pylist())
        starts = np.cumsum(sizes) - sizes
        ends = np.r_[0, np.cumsum(sizes[codes])]
        return ids[ranges(starts[codes], sizes[codes])], ends[first - first[0]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The token texts of each run of ids, joined by a blank, as the vocabulary names no decoder."""
        if len(ids) and not (0 <= ids.min() and ids.max() < self.size):
            raise ValueError("ids outside the vocabulary")
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.names.cast(pa.large_string()).take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> Bpe:
    """One for each worker process, kept from task to task."""
    return Bpe(path)


#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>``: the whole text as token ids, without special tokens around it.

    A null or empty text has no ids; strings of added tokens inside a text are those tokens;
    repeated rows come back as often as they occur, an empty table gives no rows, other columns
    are ignored whatever their names.  A text is never cut, so memory is that of the longest text
    and of ``SLICE_BYTES`` besides."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, offsets = bpe.encode(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, fields)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the decoded text of each row's ids, special tokens kept.  Null and empty
    ids give the empty text; ids outside the vocabulary (or null ones) raise."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).cast("array<int>").alias("ids"))
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(tokenizer)
        for whole in batches:
            for batch in _row_slices(whole, "ids"):
                lists = batch.column("ids")
                first = lists.offsets.to_numpy().astype(np.int64)
                values = lists.values.slice(first[0], first[-1] - first[0])
                if values.null_count:
                    raise ValueError("ids must not be null")
                text = bpe.decode(values.to_numpy(), first - first[0]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], names=["doc_id", "text"])

    return rows.mapInArrow(run, fields)


def _row_slices(batch: pa.RecordBatch, column: str, values: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists hold about ``values`` values together (one row at least)."""
    if batch.num_rows == 0:
        return
    first = batch.column(column).offsets.to_numpy().astype(np.int64)
    edges = np.flatnonzero(np.diff((first[1:] - first[0]) // values)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, digests instead of contents: ``doc_id, n_tokens,
    ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256``.  Rows as in
    ``encode``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _vocabulary(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, offsets = bpe.encode(batch.column("text"))
                raw = memoryview(ids.astype("<u4")).cast("B")
                ids_sha = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                said = bpe.decode(ids, offsets)
                at, data = np.frombuffer(said.buffers()[1], np.int64, len(said) + 1).tolist(), memoryview(said.buffers()[2] or b"")
                text_sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, fields)
