"""Token counts and feature hashes of a batch of texts, in Arrow and numpy.

A batch's tokens are dictionary-encoded once, so a distinct word is hashed once however often it
occurs, and counting is a sort of integers.  ``tokens`` in ``functions.text`` defines what a token
is; here the same trim and the same separators are applied to whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose tokens are held at once; one text is never cut.
SLICE_BYTES = 4 << 20

_TRIMMED = "".join(map(chr, range(0x21)))

# MurmurHash3_x86_32 constants and the seed of the hashing term-frequency transform.
SEED = 42
_C1, _C2, _M, _N = 0xCC9E2D51, 0x1B873593, 5, 0xE6546B64
_F1, _F2 = 0x85EBCA6B, 0xC2B2AE35


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about SLICE_BYTES together (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def token_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct tokens of each text: row, code, count (ordered by row), and the words of the codes."""
    lists = pc.ascii_split_whitespace(pc.utf8_trim(pc.fill_null(texts, ""), characters=_TRIMMED))
    first = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(first[0], first[-1] - first[0])
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    full = np.asarray(pc.binary_length(flat)) > 0
    words = flat.filter(pa.array(full)).dictionary_encode()
    width = max(len(words.dictionary), 1)
    key, count = np.unique(row[full] * width + words.indices.to_numpy(), return_counts=True)
    return key // width, key % width, count, words.dictionary


def _mix(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = h ^ _scramble(k)
    return (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(_M) + np.uint32(_N)


def _scramble(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(_C1)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(_C2)


def murmur3(words: pa.Array, standard: bool = False) -> np.ndarray:
    """Signed hash of each word's UTF-8 bytes.  The one to three bytes after the last whole block are
    blocks of their own, each with its sign; in the ``standard`` function they are one short block."""
    words = words.cast(pa.large_string()).cast(pa.large_binary())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    h = np.full(len(size), SEED, np.uint32)
    for b in range(int(size.max(initial=0)) // 4):
        live = np.flatnonzero(size >= 4 * (b + 1))
        k = data[at[live, None] + (4 * b + np.arange(4))].astype(np.uint32)
        h[live] = _mix(h[live], k[:, 0] | k[:, 1] << np.uint32(8) | k[:, 2] << np.uint32(16) | k[:, 3] << np.uint32(24))
    rest = np.zeros(len(size), np.uint32)
    for t in range(3):
        live = np.flatnonzero(size % 4 > t)
        byte = data[at[live] + size[live] // 4 * 4 + t]
        if standard:
            rest[live] |= byte.astype(np.uint32) << np.uint32(8 * t)
        else:
            h[live] = _mix(h[live], byte.view(np.int8).astype(np.int32).view(np.uint32))
    h ^= _scramble(rest)
    h ^= size.astype(np.uint32)
    h = (h ^ h >> np.uint32(16)) * np.uint32(_F1)
    h = (h ^ h >> np.uint32(13)) * np.uint32(_F2)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def murmur3_standard(words: pa.Array) -> np.ndarray:
    return murmur3(words, standard=True)


def native(words: pa.Array) -> np.ndarray:
    """Signed JVM string hash of each word, over its UTF-16 units."""
    units = [np.frombuffer(w.encode("utf-16-le"), np.uint16) for w in words.to_pylist()]
    size = np.array([len(u) for u in units], np.int64)
    at, data = np.cumsum(size) - size, np.concatenate([*units, np.zeros(0, np.uint16)]).astype(np.uint32)
    h = np.zeros(len(size), np.uint32)
    for p in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > p)
        h[live] = h[live] * np.uint32(31) + data[at[live] + p]
    return h.view(np.int32)


HASHES = {"murmur3": murmur3, "native": native, "standard": murmur3_standard}


def hashed_counts(texts: pa.Array, num_features: int, algo: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices of each text with their counts: offsets of the texts, index (ascending inside a
    text), count.  Words of one index are added up."""
    row, code, count, words = token_counts(texts)
    index = np.mod(HASHES[algo](words).astype(np.int64), num_features)
    key, place = np.unique(row * num_features + index[code], return_inverse=True)
    n = np.bincount(place, weights=count, minlength=len(key))
    return np.searchsorted(key // num_features, np.arange(len(texts) + 1)), key % num_features, n
