"""Token places of a batch of texts and the tokens at given places, in Arrow and numpy.

Texts are read as one run of UTF-8 bytes; a place is counted in characters, which are the bytes that
continue none.  ``tokens`` in ``functions.text`` defines what a token is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: The separators inside a text; at its ends all bytes up to 0x20 are none of a token.
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_TRIMMED = _BYTES <= 0x20


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other (null: none), and where each text begins and ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def _is_char(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def places(texts: pa.Array) -> pa.ListArray:
    """[start0, end0, start1, end1, ...] of each text's tokens, in characters."""
    data, at = _utf8(texts)
    apart = _SPACE[data]
    controls = np.flatnonzero(_TRIMMED[data] & ~apart)
    if len(controls):
        solid = np.flatnonzero(~_TRIMMED[data])
        row = np.searchsorted(at, controls, "right") - 1
        before, upto = np.searchsorted(solid, [at[row], at[row + 1]])
        here = np.searchsorted(solid, controls)
        apart[controls[(here == before) | (here == upto)]] = True
    inside = ~apart
    first, last = inside.copy(), inside.copy()
    first[1:] &= apart[:-1]
    last[:-1] &= apart[1:]
    some = np.diff(at) > 0
    for ends, mark in ((at[:-1][some], first), (at[1:][some] - 1, last)):  # a token ends with its text
        mark[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, start, "right") - 1
    before = np.r_[0, np.cumsum(_is_char(data))]
    pairs = np.empty(2 * len(start), np.int32)
    pairs[::2], pairs[1::2] = before[start] - before[at[row]], before[end] - before[at[row]]
    return pa.ListArray.from_arrays(pa.array(2 * np.searchsorted(row, np.arange(len(at))), pa.int32()), pa.array(pairs))


def tokens_at(pairs: pa.ListArray, texts: pa.Array) -> pa.ListArray:
    """The strings between each start and end.  Null if the text or one of the two is null; an end behind the text
    means the text's end, a start below -1 counts from there."""
    data, at = _utf8(texts)
    size = np.asarray(pc.fill_null(pc.list_value_length(pairs), 0)).astype(np.int64)
    n = np.where(size > 0, np.maximum(size // 2, 1), 0)  # one place alone: a null
    out = np.r_[0, np.cumsum(n)]
    row = np.repeat(np.arange(len(size)), n)
    spot = pairs.offsets.to_numpy().astype(np.int64)[row] + 2 * (np.arange(len(row)) - out[row])
    flat = pairs.values
    value = np.r_[np.asarray(pc.fill_null(flat, 0)).astype(np.int64), 0]
    missing = np.r_[np.asarray(flat.is_null()), True]
    close = np.where(size[row] > 1, spot + 1, len(flat))
    null = missing[spot] | missing[close] | np.asarray(texts.is_null())[row]
    start, length = np.where(null, 0, value[spot]), np.where(null, 0, value[close] - value[spot])
    if np.any(start == -1) or np.any(length < 0):
        raise ValueError("a token can't start at -1 or end before its start")
    chars = np.r_[np.flatnonzero(_is_char(data)), len(data)]
    base = np.searchsorted(chars, at)
    width = np.diff(base)[row]
    begin = np.where(start < 0, width + start + 1, start)
    stop = np.where(begin < 0, 0, np.minimum(begin + length, width))
    begin = np.minimum(np.maximum(begin, 0), width)
    a, b = chars[base[row] + begin], chars[base[row] + np.maximum(stop, begin)]
    ends = np.cumsum(b - a)
    gathered = data[np.repeat(a - (ends - (b - a)), b - a) + np.arange(ends[-1] if len(ends) else 0)]
    words = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(gathered)]).cast(pa.string())
    words = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), words)
    return pa.ListArray.from_arrays(pa.array(out, pa.int32()), words)
