"""Maximal periodic runs of words by enumerating maximal pairs.

Two equal stretches of ``l`` words, ``p`` apart, that differ before and after are a maximal pair.
Its words from the first start to the second end have period ``p``; they are a run exactly if the
stretches touch or overlap (``p <= l``), and then their start and end need no further extension.
Pairs of one start and end belong to one run, whose smallest period is their smallest distance.

A slice of texts is one word array with a separator of its own before and after each text, so no
match leaves a text:

1. Positions whose next six words occur nowhere else in the text are left aside (a run of 12 words
   or more has ``l >= 6``), then the texts that have any others are suffix-sorted by prefix
   doubling, only tied positions in each round, and neighbours get their LCP.
2. Positions whose nearest equal six words are farther than their LCP can be in no run and go too.
   The rest fall into stretches out of each other's reach.
3. The LCP-interval tree of what is left is walked from the bottom with a stack.  An interval
   holds, for each stretch, its positions in sorted lists by left word.  When two children meet at
   depth ``l``, each position of the smaller finds partners in the lists of other left words of
   the larger at most ``l`` away: the maximal pairs that are runs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import mix64, ranges, slices, whole_text

#: Words of the shortest run, and of the shortest equal stretch in one.
MIN_LENGTH = 12
RUN_FIELDS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(first: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, given dense ranks of their first words.  No two suffixes may be equal
    up to the end (separators see to it).  Each round sorts only positions that are still tied."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = order[~(head & np.r_[head[1:], True])]
    step = 1
    while len(tied):
        group, then = rank[tied], rank[np.minimum(tied + step, n - 1)]
        order = np.lexsort((then, group))
        tied, group, then = tied[order], group[order], then[order]
        place = np.arange(len(tied))
        new_group = np.r_[True, group[1:] != group[:-1]]
        head = new_group | np.r_[True, then[1:] != then[:-1]]
        begin = np.maximum.accumulate(np.where(new_group, place, 0))
        rank[tied] = group + np.maximum.accumulate(np.where(head, place, 0)) - begin
        tied = tied[~(head & np.r_[head[1:], True])]
        step *= 2
    return rank


def neighbour_lcps(words: np.ndarray, order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """LCP of each suffix in ``order`` with the one before it; ``same`` says where their first six
    words agree, elsewhere the LCP is given as 0.  Text order carries the length from one position
    to the next."""
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(same)
    by_text = at[np.argsort(order[at])]
    left, w = order.tolist(), words.tolist()
    length, last = 0, -2
    for k in by_text.tolist():
        i, j = left[k], left[k - 1]
        length = max(length - (i - last), 0)
        last = i
        while w[i + length] == w[j + length]:
            length += 1
        lcp[k] = length
    return lcp


Lists = dict[int, dict[int, list[int]]]  # stretch -> left word -> sorted positions


class _Pairs:
    """Walks one slice's LCP-interval tree and keeps the smallest distance of each start and end."""

    def __init__(self, left: list[int], stretch: list[int], min_length: int):
        self.left, self.stretch, self.min_length = left, stretch, min_length
        self.found: dict[tuple[int, int], int] = {}

    def leaf(self, x: int) -> tuple[int, Lists]:
        return 1, {self.stretch[x]: {self.left[x]: [x]}}

    def meet(self, a: tuple[int, Lists], b: tuple[int, Lists], depth: int) -> tuple[int, Lists]:
        """Pairs between two children of an interval of this depth; returns them as one."""
        (n, large), (m, small) = (a, b) if a[0] >= b[0] else (b, a)
        found, least = self.found, self.min_length - depth
        for stretch, classes in small.items():
            others = large.get(stretch)
            if others is None:
                large[stretch] = classes
                continue
            for word, places in classes.items():
                for x in places:
                    for other, ys in others.items():
                        if other == word:
                            continue
                        for y in ys[bisect_left(ys, x - depth):bisect_right(ys, x + depth)]:
                            p = x - y if x > y else y - x
                            if p >= least:
                                key = (min(x, y), max(x, y) + depth)
                                if found.get(key, p) >= p:
                                    found[key] = p
            for word, places in classes.items():
                mine = others.get(word)
                if mine is None:
                    others[word] = places
                elif len(places) == 1:
                    insort(mine, places[0])
                else:
                    others[word] = sorted(mine + places) if len(places) > len(mine) // 8 else _insert(mine, places)
        return n + m, large

    def walk(self, order: list[int], lcp: list[int], least: int) -> None:
        """``order``: positions in suffix order, ``lcp``: with the one before.  Intervals of a depth
        below ``least`` are not built."""
        stack: list[tuple[int, tuple[int, Lists]]] = []
        child = None
        for x, depth in zip([*order, None], [*lcp, 0], strict=True):
            while stack and stack[-1][0] > depth:
                top, held = stack.pop()
                child = self.meet(held, child, top)
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    stack[-1] = (depth, self.meet(stack[-1][1], child, depth))
                else:
                    stack.append((depth, child))
            if x is not None:
                child = self.leaf(x)


def _insert(into: list[int], places: list[int]) -> list[int]:
    for p in places:
        insort(into, p)
    return into


def find_runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of texts given as word codes one after the other and words a text: arrays ``text,
    start, length, period``, ordered by text, start and period."""
    least = -(-min_length // 2)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    # one separator before each text and one at the end; codes of separators are below 0, all different
    n, total = len(sizes), int(sizes.sum()) + len(sizes) + 1
    text_at = np.cumsum(sizes + 1) - sizes
    text_of = np.repeat(np.arange(n + 1), np.r_[sizes + 1, 1])
    body = np.ones(total, bool)
    body[text_at - 1] = body[-1] = False
    code = np.empty(total, np.int64)
    code[body] = words
    code[~body] = -1 - np.arange(n + 1)
    if total <= least:
        return empty

    def repeated(code, text_of):
        """Positions whose next ``least`` words may occur twice in the text (by a 64-bit hash)."""
        gram = np.zeros(len(code) - least + 1, np.uint64)
        for k in range(least):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + mix64(code[k:k + len(gram)].view(np.uint64))
        gram = mix64(gram) ^ mix64(text_of[:len(gram)].view(np.uint64) + np.uint64(1))
        order = np.argsort(gram)
        ordered = gram[order]
        twin = np.r_[False, ordered[1:] == ordered[:-1]]
        return order[twin | np.r_[twin[1:], False]]

    some = np.unique(text_of[repeated(code, text_of)])
    if not len(some):
        return empty
    keep = np.isin(text_of, some)  # the separator before a text counts as the text's
    keep[-1] = True
    code, text_of, body = code[keep], text_of[keep], body[keep]
    pair = (text_of << 32) + np.where(body, code, -1) + 1
    rank = suffix_ranks(np.unique(pair, return_inverse=True)[1])
    flagged = np.sort(repeated(code, text_of))
    order = flagged[np.argsort(rank[flagged])]
    same = np.r_[False, (code[order[1:, None] + np.arange(least)] == code[order[:-1, None] + np.arange(least)]).all(axis=1)] & np.r_[False, text_of[order[1:]] == text_of[order[:-1]]]
    lcp = neighbour_lcps(code, order, same)
    reach = np.maximum(lcp, np.r_[lcp[1:], 0])
    # the nearest position with the same words, on either side
    by_group = np.lexsort((order, np.cumsum(~same)))
    group, at = np.cumsum(~same)[by_group], order[by_group]
    gap = np.where(group[1:] == group[:-1], np.diff(at), len(code))
    near = np.minimum(np.r_[gap, len(code)], np.r_[len(code), gap])
    alive = np.empty(len(order), bool)
    alive[by_group] = near <= reach[by_group]
    if not alive.any():
        return empty
    # LCP between neighbours that are left: the least since the last of them
    kept = np.flatnonzero(alive)
    low = np.minimum.reduceat(lcp[:kept[-1] + 1], np.r_[0, kept[:-1] + 1])
    low[0] = 0
    order, reach = order[kept], reach[kept]
    by_text = np.argsort(order)
    far = np.maximum.accumulate((order + reach)[by_text])
    stretch = np.empty(len(order), np.int64)
    stretch[by_text] = np.cumsum(np.r_[True, order[by_text][1:] > far[:-1]])
    # positions are renumbered densely only for the lookups of left word and stretch
    spot = np.full(len(code), -1, np.int64)
    spot[order] = stretch
    pairs = _Pairs(code[np.arange(len(code)) - 1].tolist(), spot.tolist(), min_length)
    pairs.walk(order.tolist(), low.tolist(), least)
    if not pairs.found:
        return empty
    first, end = np.array(list(pairs.found), np.int64).T
    period = np.array(list(pairs.found.values()), np.int64)
    text = text_of[first]
    begin = np.searchsorted(text_of, text) + 1
    start, length = first - begin, end - first
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, dictionary-encoded, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    first = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(first[0], first[-1] - first[0])
    full = np.asarray(pc.binary_length(flat)) > 0
    sizes = np.diff(np.r_[0, np.cumsum(full)][first - first[0]])
    return flat.filter(pa.array(full)).dictionary_encode(), sizes


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the maximal runs of each text, by start and period, and
    the text's words joined by one blank without those that a run holds after its first period.

    A run is a stretch of consecutive words with smallest period ``q`` and at least ``min_length``
    and ``2 q`` words that no neighbouring word extends.  A null or empty text has no words, no
    runs and an empty collapsed text; repeated rows come back as often as they occur; an empty
    table gives no rows; other columns are ignored whatever their names.  A text is one row of one
    task and is never cut; memory is that of a slice or of the longest text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs {RUN_FIELDS}, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                coded, sizes = split_words(batch.column("text"))
                words = coded.indices.to_numpy()
                text, start, length, period = find_runs(words, sizes, min_length)
                of = np.bincount(text, minlength=len(sizes))
                found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
                drop = np.zeros(len(words) + 1, np.int64)
                base = (np.cumsum(sizes) - sizes)[text] + start
                np.add.at(drop, base + period, 1)
                np.add.at(drop, base + length, -1)
                stays = np.cumsum(drop[:-1]) == 0
                left = np.r_[0, np.cumsum(stays)][np.r_[0, np.cumsum(sizes)]]
                kept = coded.dictionary.take(pa.array(words[stays]))
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(of)], pa.int32()), found)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, collapsed],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, fields)
