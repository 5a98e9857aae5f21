"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word: a hashed word embedding and the mean of its hashed character 3-gram embeddings.
A text is scored over all overlapping windows of words; its score is that of its worst window,
calibrated.  Training takes a bounded sample of labelled rows; as a label says nothing about where
in a text the words stand, windows are chosen first by word and 3-gram odds and then by the
network itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import gathered, mix64, ranges, slices, small_batches, whole_text

WINDOW = 24
#: Windows of a text that start in the same run of this many words teach once, by their best.
TEACH = 12
WORD_ROWS, CHAR_ROWS = 32768, 16384
EMBED, HIDDEN = 10, 8
#: Bounds of the fitted sample: rows of each label, and characters of a row that may be in it.
PER_LABEL, SAMPLE_CHARS = 1500, 20_000
#: Parts of a label that are ranked on their own first.
SALTS = 64
#: Share of words hidden from the network at each training step.
HIDE = 0.15
LEAST_TEXTS = 3
#: Windows that go through the network at once (their arrays fit a core's cache), and bytes of rows that are
#: scored at once: the more, the fewer times a frequent word is hashed and projected.
TOGETHER, SCORED_BYTES = 1024, 8 << 20
_MARKS = re.compile(r"\W+")


@dataclass
class Words:
    """Distinct words as rows: hashed word numbers, and 3-gram numbers with each word's first."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        joined = "".join(f"\x02{w}\x03" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        start = np.cumsum(size) - size
        total = np.zeros(len(words), np.uint64)
        if len(words):
            step = mix64(points + (np.arange(len(points)) - np.repeat(start, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            total = mix64(np.add.reduceat(step, start))
        at = ranges(start, size - 2)  # a word of n characters has n 3-grams with its two end marks
        gram = mix64((points[at] << np.uint64(42)) ^ (points[at + 1] << np.uint64(21)) ^ points[at + 2])
        return Words((total % np.uint64(WORD_ROWS)).astype(np.int64), (gram % np.uint64(CHAR_ROWS)).astype(np.int64), np.cumsum(size - 2) - (size - 2))

    def mean_grams(self, table: np.ndarray) -> np.ndarray:
        n = np.diff(np.r_[self.first, len(self.gram)])
        return np.add.reduceat(table.take(self.gram, 0), self.first, axis=0) / n[:, None]


def tokens(texts: list[str] | pa.Array) -> tuple[np.ndarray, Words, np.ndarray]:
    """Word codes of all texts one after the other, the distinct words, words for each text.  Words
    stand between white space and lose case and marks; an Arrow array (no nulls) is split in Arrow."""
    codes, words, sizes = _split(texts)
    return codes, Words.of(words), sizes


def _split(texts: list[str] | pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Like ``tokens``, the words as text: equal ones if they differ in case and marks alone."""
    if isinstance(texts, list):
        lists = [t.split() for t in texts]
        flat = [w for ws in lists for w in ws]
        codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
        return codes, [_clean(w) for w in distinct], np.fromiter(map(len, lists), np.int64, len(lists))
    lists = pc.utf8_split_whitespace(texts)
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    some = np.asarray(pc.binary_length(flat)) > 0  # white space at the ends leaves empty words
    sizes = np.diff(np.r_[0, np.cumsum(some)][np.r_[0, ends]])
    words = (flat if some.all() else flat.filter(pa.array(some))).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), _strings(_cleaned(words.dictionary)), sizes


def _strings(words: pa.StringArray) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _clean(word: str) -> str:
    return word.lower() if word.isalnum() else _MARKS.sub("", word.lower()) or word


def _cleaned(words: pa.StringArray) -> pa.StringArray:
    """``_clean`` of all words; those in ASCII stay in Arrow, whose marks and cases are Python's there."""
    clean, is_ascii = pc.ascii_lower(words), pc.string_is_ascii(words)
    marked = pc.and_(is_ascii, pc.invert(pc.ascii_is_alnum(clean)))
    was = clean.filter(marked)
    bare = pc.replace_substring_regex(was, r"\W+", "")
    clean = pc.replace_with_mask(clean, marked, pc.if_else(pc.equal(bare, ""), was, bare))
    other = pc.invert(is_ascii)
    return pc.replace_with_mask(clean, other, pa.array([_clean(w) for w in _strings(words.filter(other))], pa.string()))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window: one starts at each word that a whole window follows,
    and a shorter text is one window."""
    count = np.maximum(1, sizes - WINDOW + 1) * (sizes > 0)
    text = np.repeat(np.arange(len(sizes)), count)
    base = np.cumsum(sizes) - sizes
    return text, ranges(base, count), np.minimum(WINDOW, sizes[text])


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    some, first = np.unique(rows[order], return_index=True)
    return some, np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3) -> Net:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        p = {"word": rng.normal(0, 0.1, (WORD_ROWS, e)), "char": rng.normal(0, 0.3, (CHAR_ROWS, e)),
             "pool": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
        for d in ("f", "b"):  # gates: update, reset, new
            p |= {f"w{d}": rng.normal(0, 0.3, (2 * e, 3 * h)), f"u{d}": rng.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
        return Net({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["word"][words.word], words.mean_grams(self.p["char"])], axis=1)

    def logits(self, words: Words, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of windows in order of their starts.  Words are projected once for each distinct word; whole
        windows that start side by side share their rows, and positions between texts are left out."""
        if not len(start):
            return np.zeros(0, np.float32)
        s, x = HIDDEN, self.inputs(words).astype(np.float32)
        proj = {d: np.vstack([(x @ self.p[f"w{d}"] + self.p[f"c{d}"]) * _SCALE, np.zeros((1, 3 * s), np.float32)]) for d in "fb"}
        mix = np.array([np.vstack([self.p[f"u{d}"].T / 2, *(self.p[k][None, i:i + s] for k in ("pool", "out"))]) for d, i in (("f", 0), ("b", s))], np.float32, order="C")
        out = np.empty(len(start), np.float32)
        whole, short = np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)
        lo = 0
        while lo < len(whole):
            first = start[whole[lo]]
            these = whole[lo:lo + int(np.searchsorted(start[whole[lo:lo + TOGETHER]], first + TOGETHER))]
            n = int(start[these[-1]] - first) + 1
            at = codes[first:first + n + WINDOW - 1]
            g = np.empty((3 * s, 2, len(at)), np.float32)
            g[:, 0], g[:, 1] = proj["f"].take(at, 0).T, proj["b"].take(at[::-1], 0).T  # backwards, the last window is the first
            heads = _gru_heads([g[:, :, t:t + n] for t in range(WINDOW)], mix)
            out[these] = _pooled(heads[:, :, 0] + heads[::-1, :, 1, ::-1])[start[these] - first]
            lo += len(these)
        for lo in range(0, len(short), 1024):
            these = short[lo:lo + 1024]
            t = np.arange(int(size[these].max()))[:, None]
            on = t < size[these]
            at = np.where(on, codes[np.minimum(start[these] + t, len(codes) - 1)], len(x))
            g = np.stack([proj["f"][at], proj["b"][at[::-1]]], axis=1).transpose(0, 3, 1, 2)
            heads = _gru_heads(g, mix, np.stack([on, on[::-1]], axis=1)[:, None])
            both = heads[:, :, 0] + heads[::-1, :, 1]
            both[:, 0] = np.where(on, both[:, 0], -1e9)
            out[these] = _pooled(both)
        return out + self.p["bias"]

    def step(self, words: Words, at: np.ndarray, on: np.ndarray, y: np.ndarray, shown: np.ndarray) -> dict:
        """Gradient of the mean log loss of a batch of windows ``at`` (rows of word numbers); words
        that aren't ``shown`` enter as zeros.  Embeddings: (rows touched, their gradients)."""
        p, h = self.p, HIDDEN
        x_all = self.inputs(words)
        x = x_all[at] * shown[:, :, None]
        tapes, hs = {}, {}
        for d, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
            tapes[d] = _gru_forward(x[:, turn] @ p[f"w{d}"] + p[f"c{d}"], p[f"u{d}"], on[:, turn])
            hs[d] = tapes[d][0][:, turn]
        both = np.concatenate([hs["f"], hs["b"]], axis=2)
        a = np.where(on, both @ p["pool"], -1e9)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        ctx = (a[:, :, None] * both).sum(1)
        dl = (_sigmoid(ctx @ p["out"] + p["bias"]) - y) / len(y)
        dctx = dl[:, None] * p["out"]
        da = (both * dctx[:, None]).sum(2)
        ds = a * (da - (a * da).sum(1, keepdims=True))
        dboth = a[:, :, None] * dctx[:, None] + ds[:, :, None] * p["pool"]
        g = {"out": ctx.T @ dl, "bias": np.array([dl.sum()], np.float32), "pool": np.einsum("bt,bth->h", ds, both)}
        dx = np.zeros_like(x)
        for d, turn, dh in (("f", slice(None), dboth[:, :, :h]), ("b", slice(None, None, -1), dboth[:, :, h:])):
            dproj, g[f"u{d}"] = _gru_backward(tapes[d], p[f"u{d}"], dh[:, turn], on[:, turn])
            dproj = dproj[:, turn]
            g[f"c{d}"] = dproj.sum((0, 1))
            g[f"w{d}"] = np.einsum("bti,btj->ij", x, dproj)
            dx += dproj @ p[f"w{d}"].T
        dword = np.zeros_like(x_all)
        rows, sums = _by_row(at[shown], dx[shown])
        dword[rows] = sums
        n = np.diff(np.r_[words.first, len(words.gram)])
        g["word"] = _by_row(words.word, dword[:, :EMBED])
        g["char"] = _by_row(words.gram, np.repeat(dword[:, EMBED:] / n[:, None], n, axis=0))
        return g


#: Scales of the gates' arguments: a sigmoid is (1 + tanh(x / 2)) / 2.
_SCALE = np.repeat(np.array([0.5, 0.5, 1], np.float32), HIDDEN)


def _pooled(heads: np.ndarray) -> np.ndarray:
    a = np.exp(heads[:, 0] - heads[:, 0].max(0))
    return (a * heads[:, 1]).sum(0) / a.sum(0)


def _on_lines(n: int, *rows: int) -> list[np.ndarray]:
    """Arrays of rows x 2 x n, each of which begins a cache line (NumPy's own lie across them, which splits
    wide loads) and not at the same place of a page as the one before."""
    sizes = [-(-2 * k * n // 16) * 16 + 64 for k in rows]
    room = np.empty(sum(sizes) + 16, np.float32)
    ends = np.cumsum(sizes) + -room.ctypes.data % 64 // 4
    return [room[e - size:e - size + 2 * k * n].reshape(k, 2, n) for e, size, k in zip(ends.tolist(), sizes, rows, strict=True)]


def _gru_heads(xs, mix, on=None) -> np.ndarray:
    """Products (steps x 2 x directions x windows) of the last rows of ``mix`` with the states of the
    network, both directions at once, whose inputs are ``xs`` (by step: gates x directions x windows, in
    single precision throughout); a window that isn't ``on`` keeps its state.  Directions lie inside
    the gates, so that all but the inputs are whole runs of memory."""
    s, n = HIDDEN, xs[0].shape[2]
    h, nh, new, zq, r = _on_lines(n, s, s, s, 2 * s, mix.shape[1])
    h[:] = r[:] = 0
    z, q, gates, last, heads = zq[:s], zq[s:], r[:2 * s], r[2 * s:3 * s], r[3 * s:]
    products = r.transpose(1, 0, 2)
    out = np.empty((len(xs), mix.shape[1] - 3 * s, 2, n), np.float32)
    for t, x in enumerate(xs):
        np.add(x[:2 * s], gates, out=zq)
        np.tanh(zq, out=zq)
        zq += 1  # twice the gates
        np.multiply(last, q, out=new)
        new += x[2 * s:]
        np.tanh(new, out=new)
        np.subtract(h, new, out=nh)
        nh *= z
        nh *= np.float32(0.5)
        nh += new
        h, nh = (nh, h) if on is None else (np.where(on[t], nh, h), nh)
        np.matmul(mix, h.transpose(1, 0, 2), out=products)
        out[t] = heads
    return out


def _gru_forward(proj, u, on):
    n, steps, _ = proj.shape
    s, h = HIDDEN, np.zeros((n, HIDDEN), np.float32)
    out, tape = np.empty((n, steps, s), np.float32), []
    for t in range(steps):
        r = h @ u
        z, q = _sigmoid(proj[:, t, :s] + r[:, :s]), _sigmoid(proj[:, t, s:2 * s] + r[:, s:2 * s])
        new = np.tanh(proj[:, t, 2 * s:] + q * r[:, 2 * s:])
        tape.append((h, z, q, new, r[:, 2 * s:]))
        h = np.where(on[:, t, None], new + z * (h - new), h)
        out[:, t] = h
    return out, tape


def _gru_backward(saved, u, dout, on):
    out, tape = saved
    n, steps, s = out.shape
    dproj, du, carry = np.zeros((n, steps, 3 * s), np.float32), np.zeros_like(u), np.zeros((n, s), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, q, new, rn = tape[t]
        live = on[:, t, None]
        d = dout[:, t] + carry
        dn = np.where(live, d * (1 - z), 0) * (1 - new * new)
        dz = np.where(live, d * (h - new), 0) * z * (1 - z)
        dq = dn * rn * q * (1 - q)
        dproj[:, t] = np.concatenate([dz, dq, dn], axis=1)
        dr = np.concatenate([dz, dq, dn * q], axis=1)
        du += h.T @ dr
        carry = np.where(live, d * z, d) + dr @ u.T
    return dproj, du


@dataclass
class Model:
    net: Net
    slope: float
    shift: float

    def score(self, texts: list[str] | pa.Array) -> np.ndarray:
        """0 to 1 for each text, from its worst window; texts without a word score as low as any."""
        codes, words, sizes = _split(texts)
        text, start, size = windows(sizes)
        worst = np.full(len(texts), -30.0)
        if len(text):
            same, words = pd.factorize(np.array(words, dtype=object))  # without case and marks many are equal
            codes, words = same[codes], Words.of(words)
            first = np.flatnonzero(np.r_[True, np.diff(text) > 0])
            worst[text[first]] = np.maximum(-30, np.maximum.reduceat(self.net.logits(words, codes, start, size), first))
        return _sigmoid(self.slope * (worst - self.shift))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bounded ``(text, toxic)`` rows: for each label the first ids by hash.  Only ids are ranked, first
    within ``SALTS`` parts of a label and then those left, so no text is shuffled and no task ranks all
    rows of a label; an id labelled both ways counts as toxic."""
    one = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    first = one.withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)))
    for part in (["toxic", "_salt"], ["toxic"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.xxhash64("_id"), "_id"))
        first = first.withColumn("_r", rank).filter(F.col("_r") <= per_label)
    picked = first.select("_id", "toxic")
    return docs.join(F.broadcast(picked), docs[id_col] == F.col("_id")).filter(F.length(text_col).between(1, max_chars)).select(F.col(text_col).alias("text"), "toxic")


def train(texts: list[str], y: np.ndarray, epochs: int = 7, batch: int = 96, rate: float = 0.01, seed: int = 11) -> Model:
    """Three phases.  First windows are taken by odds: of a toxic text the two whose words and
    3-grams speak most for the label, of others the worst and a random one; then by the network
    own scores.  At last the threshold is set on a fifth of the sample's texts
    that taught nothing else."""
    rng = np.random.default_rng(seed)
    codes, words, sizes = tokens(texts)
    text, start, size = windows(sizes)
    run = (start - (np.cumsum(sizes) - sizes)[text]) // TEACH
    net = Net.fresh()
    if len(set(y[sizes > 0].tolist())) < 2:
        return Model(net, 1.0, 30.0)
    held = np.arange(len(texts)) % 5 == 4  # teaches the threshold only
    if len(set(y[(sizes > 0) & ~held].tolist())) < 2 or len(set(y[held & (sizes > 0)].tolist())) < 2:
        held[:] = False
    in_text = np.divmod(np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(words.word) + codes), len(words.word))
    taught = np.where(held, -1, y)
    n_pos, n_neg = max(1, (taught == 1).sum()), max(1, (taught == 0).sum())

    def odds(rows, of_text, bins):
        pos = np.bincount(rows, weights=taught[of_text] == 1, minlength=bins)
        neg = np.bincount(rows, weights=taught[of_text] == 0, minlength=bins)
        return np.maximum(0, np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))) * (pos >= 3)

    grams = np.diff(np.r_[words.first, len(words.gram)])
    by_gram = np.divmod(np.unique(np.repeat(in_text[0], grams[in_text[1]]) * CHAR_ROWS + words.gram[ranges(words.first[in_text[1]], grams[in_text[1]])]), CHAR_ROWS)
    word_odds = odds(in_text[1], in_text[0], len(words.word))
    gram_odds = odds(by_gram[1], by_gram[0], CHAR_ROWS)
    strength = word_odds ** 2 + np.maximum.reduceat(gram_odds[words.gram], words.first) ** 2
    total = np.r_[0, np.cumsum(strength[codes])]
    guess = total[start + size] - total[start]
    # Rows of the tables that fewer than LEAST_TEXTS texts would teach stay zero: they'd only be learned by heart.
    taught_in = ~held[in_text[0]], ~held[by_gram[0]]
    often = np.bincount(in_text[1][taught_in[0]], minlength=len(words.word)) >= LEAST_TEXTS
    rows = {"word": np.zeros(WORD_ROWS, bool), "char": np.bincount(by_gram[1][taught_in[1]], minlength=CHAR_ROWS) >= LEAST_TEXTS}
    rows["word"][words.word[often]] = True
    for k, on in rows.items():
        net.p[k][~on] = 0
    net.p["word"][:, 0] = np.bincount(words.word, weights=word_odds, minlength=WORD_ROWS) / np.maximum(1, np.bincount(words.word, minlength=WORD_ROWS)) / 4
    net.p["char"][:, 0] = gram_odds / 4  # the odds are where the embeddings start
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    done = 0
    for phase in range(3):
        if phase:
            guess = net.logits(words, codes, start, size)
        order = np.lexsort([-guess, run, text])
        order = order[np.r_[True, (np.diff(text[order]) != 0) | (np.diff(run[order]) != 0)]]
        order = order[np.lexsort([-guess[order], text[order]])]
        nth = np.arange(len(order)) - np.searchsorted(text[order], text[order], "left")
        positive = order[(taught[text[order]] == 1) & (nth < 2) & (guess[order] > (0 if not phase else -1))]
        spare = rng.permutation(np.flatnonzero(taught[text] == 0))
        negative = np.r_[order[(taught[text[order]] == 0) & (nth < 1)], spare[:len(positive)]]
        chosen = np.r_[positive, negative]
        target = np.r_[np.ones(len(positive)), np.zeros(len(negative))].astype(np.float32)
        for _ in range(max(epochs, -(-200 * batch // max(1, len(chosen))))):
            mix = rng.permutation(len(chosen))
            for lo in range(0, len(mix), batch):
                w = chosen[mix[lo:lo + batch]]
                t = np.arange(int(size[w].max()))
                on = t < size[w][:, None]
                at = codes[np.minimum(start[w][:, None] + t, len(codes) - 1)]
                local, back = np.unique(at, return_inverse=True)
                n = grams[local]
                part = Words(words.word[local], words.gram[ranges(words.first[local], n)], np.cumsum(n) - n)
                shown = on & (rng.random(on.shape) >= HIDE)
                done += 1
                for k, g in net.step(part, back.reshape(at.shape), on, target[mix[lo:lo + batch]], shown).items():
                    at_rows, g = (g[0][rows[k][g[0]]], g[1][rows[k][g[0]]]) if k in rows else (slice(None), g)
                    m, v = moments[k]
                    m[at_rows] += 0.1 * (g - m[at_rows])
                    v[at_rows] += 0.01 * (g * g - v[at_rows])
                    net.p[k][at_rows] -= rate * (m[at_rows] / (1 - 0.9 ** done)) / (np.sqrt(v[at_rows] / (1 - 0.99 ** done)) + 1e-6)
    worst = np.full(len(texts), -30.0)
    np.maximum.at(worst, text, net.logits(words, codes, start, size))
    judge = held if held.any() else np.ones(len(texts), bool)
    worst, y = worst[judge], y[judge]
    cut = np.unique(worst)
    cut = (cut[1:] + cut[:-1]) / 2 if len(cut) > 1 else cut
    cut = cut[np.linspace(0, len(cut) - 1, min(len(cut), 800)).astype(int)]
    loss = [(worst[y == 1] < c).mean() + 3 * (worst[y == 0] >= c).mean() for c in cut]  # clean texts weigh more
    best = np.flatnonzero(np.array(loss) <= min(loss) + 1e-12)
    return Model(net, 1.0, float(0.3 * cut[best[0]] + 0.7 * cut[best[-1]]))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Trains on ``sample(docs, labels)``.  Without rows of both labels every text scores low."""
    rows = sorted({(r["text"], int(r["toxic"])) for r in sample(docs, labels, per_label).collect()}, key=lambda r: hashlib.md5(r[0].encode("utf-8", "surrogatepass")).digest())
    return train([t for t, _ in rows], np.array([y for _, y in rows], dtype=int))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` to every row from all overlapping windows of its
    whole text.  Null and empty texts score as texts without words; columns of these names are
    replaced; equal texts get equal scores."""
    small_batches(docs)
    docs = docs.drop("score", "predicted")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in gathered(batches, SCORED_BYTES):
            for b in slices(whole, "_text", SCORED_BYTES):
                s = model.score(b.column("_text"))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                                 names=[*names, "score", "predicted"])

    return docs.withColumn("_text", whole_text(text_col)).mapInArrow(run, docs.schema.add("score", "double").add("predicted", "integer"))
