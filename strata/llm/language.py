"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character 1- to 3-grams of its lower-cased letters;
each language has a few spherical k-means centroids; the prediction is the language of the closest
centroid by cosine, and a text farther from it than held-out texts of that language with as many
n-grams (short ones are farther) is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import mix64, slices, small_batches, unused, whole_text

DIMS = 4096
CENTROIDS = 3
#: Bounds of the fitted sample: labelled rows for each language, and rows in all.
PER_LANGUAGE, SAMPLE_ROWS = 400, 8000
#: Parts of a language's hashes that are ranked apart.
PARTS = 64
#: A text is rejected if its cosine is below this share of a low quantile of the cosines that held-out
#: texts of the language with about as many distinct n-grams have.
REJECT_SHARE, REJECT_QUANTILE = 0.8, 0.02
#: Held-out folds, held-out cosines a quantile is taken of, and where: log2 of the distinct n-grams.
FOLDS, NEAREST, SIZES = 5, 100, np.arange(1, 13)
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (rows x dims) and whether each text has a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\x00".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[:len(points)]
    letter = (points < len(_LETTER)) & _LETTER[np.minimum(points, len(_LETTER) - 1)]
    has = np.zeros(len(low), bool)
    has[row[letter]] = True
    code = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()  # of each run of other characters the first stays, as a blank
    keep[1:] |= letter[:-1]
    code, row = code[keep], row[keep]
    counts = np.zeros(len(low) * dims, np.float32)
    gram = np.zeros(len(code), np.uint64)
    for n in range(3):
        gram = gram[:len(code) - n] * np.uint64(0x110000) + code[n:]
        same = row[n:] == row[:len(row) - n]
        at = row[n:][same] * dims + (mix64(gram[same] + np.uint64(n)) % np.uint64(dims)).astype(np.int64)
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(low), dims), has


@dataclass
class Model:
    languages: list[str]
    of_centroid: np.ndarray   # index of the language of each centroid
    centroids: np.ndarray     # unit rows
    idf: np.ndarray
    reject_below: np.ndarray  # by language and SIZES

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1), cosines, rejected."""
        counts, has = grams(texts, self.centroids.shape[1])
        cos = _unit(np.log1p(counts) * self.idf) @ self.centroids.T
        best = np.full((len(texts), len(self.languages)), -1.0, np.float32)
        for i, k in enumerate(self.of_centroid):
            best[:, k] = np.maximum(best[:, k], cos[:, i])
        top = best.argmax(1)
        near = best[np.arange(len(top)), top].astype(np.float64)
        share = np.exp(20.0 * (best - near[:, None])).sum(1)
        score = np.where(has, np.clip(near, 0, 1) ** 0.25 / share, 0.0)
        return ([self.languages[k] if h else UNKNOWN for k, h in zip(top, has, strict=True)], score, np.where(has, near, 0.0),
                ~has | (near < self._cut(top, (counts > 0).sum(1))))

    def _cut(self, language: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        size = np.clip(np.log2(np.maximum(distinct, 1)), SIZES[0], SIZES[-1]) - SIZES[0]
        low = np.minimum(size.astype(int), len(SIZES) - 2)
        return self.reject_below[language, low] * (1 - size + low) + self.reject_below[language, low + 1] * (size - low)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the row nearest to the mean and then the farthest rows."""
    centers = _unit(x.mean(0, keepdims=True))
    for _ in range(1, min(k, len(x))):
        centers = np.vstack([centers, x[(x @ centers.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        centers = _unit(np.vstack([x[own == i].sum(0) if (own == i).any() else centers[i] for i in range(len(centers))]))
    return centers.astype(np.float32)


def _idf(x: np.ndarray) -> np.ndarray:
    return (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)


def _reject_below(x: np.ndarray, starts: np.ndarray, y: np.ndarray, languages: int, centroids: int) -> np.ndarray:
    """Thresholds by language and ``SIZES``.  Rows of ``x`` (log counts) and ``starts`` (of the beginnings
    of the same texts, zero if without a letter) meet centroids that were fitted without their fold."""
    fold = np.zeros(len(y), int)
    for k in range(languages):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    cos, size = np.full((2, len(y)), np.nan), np.zeros((2, len(y)))
    for f in range(FOLDS):
        idf = _idf(x[fold != f])
        for k in range(languages):
            own, rest = np.flatnonzero((y == k) & (fold == f)), (y == k) & (fold != f)
            if not len(own) or not rest.any():
                continue
            centers = _clusters(_unit(x[rest] * idf), centroids)
            for i, rows in enumerate((x[own], starts[own].astype(np.float32))):
                distinct = (rows > 0).sum(1)
                cos[i, own] = np.where(distinct > 0, (_unit(rows * idf) @ centers.T).max(1), np.nan)
                size[i, own] = np.log2(np.maximum(distinct, 1))
    out = np.zeros((languages, len(SIZES)))
    for k in range(languages):
        c, s = cos[:, y == k].ravel(), size[:, y == k].ravel()
        c, s = c[~np.isnan(c)], s[~np.isnan(c)]
        for i, at in enumerate(SIZES):
            if len(c):  # a language with one text has no threshold
                out[k, i] = REJECT_SHARE * np.quantile(c[np.argsort(np.abs(s - at), kind="stable")[:NEAREST]], REJECT_QUANTILE)
    return out


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample ``(text, lang)`` of rows ``(text, lang)``, spread over the languages, by the
    hash of the text.  Only hashes are ranked, in parts of a language first, so no task meets all of
    one; the chosen texts are fetched afterwards."""
    keyed = labelled.filter("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    part = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))
    parts = keyed.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(PARTS))).withColumn("r", part).filter(F.col("r") <= per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = parts.drop("part").withColumn("r", rank).filter(F.col("r") <= per_language).orderBy("r", "h").limit(rows)
    return keyed.join(F.broadcast(picked.drop("r")), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(labelled: DataFrame, dims: int = DIMS, centroids: int = CENTROIDS) -> Model:
    """Fits on ``sample(labelled)``; n-grams are counted by the executors.  Rows without text or
    language, and texts without a letter, teach nothing; with no rows every text is rejected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", 1 << 19, 256):
                texts = b.column("text").to_pylist()
                x, has = grams(texts, dims)
                starts, _ = grams([t[:4 << zlib.crc32(t.encode("utf-8", "surrogatepass")) % 8] for t in texts], dims)
                packed = [pa.array([r.astype(np.float16).tobytes() for r in np.log1p(c)], pa.binary()) for c in (x, starts)]
                yield pa.RecordBatch.from_arrays([b.column("lang"), *packed, pa.array(has)], names=["lang", "x", "start", "has"])

    got = sample(labelled).mapInArrow(count, "lang string, x binary, start binary, has boolean").filter("has").toArrow()
    langs = got.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], got.column("x")[i].as_py()))  # the same model whatever the order of rows
    names = sorted(set(langs))
    if not names:
        return Model([UNKNOWN], np.zeros(1, int), np.zeros((1, dims), np.float32), np.ones(dims, np.float32), np.ones((1, len(SIZES))))
    x = np.stack([np.frombuffer(got.column("x")[i].as_py(), np.float16) for i in order]).astype(np.float32)
    y = np.array([names.index(langs[i]) for i in order])
    starts = np.stack([np.frombuffer(got.column("start")[i].as_py(), np.float16) for i in order])
    reject_below = _reject_below(x, starts, y, len(names), centroids)
    idf = _idf(x)
    x = _unit(x * idf)
    parts = [_clusters(x[y == k], centroids) for k in range(len(names))]
    return Model(names, np.repeat(np.arange(len(names)), [len(p) for p in parts]), np.vstack(parts), idf, reject_below)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred, score, cosine, rejected`` to every row from its whole text.  Null, empty
    and letterless texts are ``und`` with score 0 and rejected; columns of these names are
    replaced; equal texts get equal results."""
    small_batches(docs)
    docs = docs.drop("lang_pred", "score", "cosine", "rejected")
    names, source = docs.columns, unused(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, source, 1 << 19, 256):
                pred, score, cos, out = model.predict(b.column(source).to_pylist())
                cols = [b.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pred), pa.array(score, pa.float64()), pa.array(cos, pa.float64()), pa.array(out)],
                                                 names=[*names, "lang_pred", "score", "cosine", "rejected"])

    schema = docs.schema.add("lang_pred", "string").add("score", "double").add("cosine", "double").add("rejected", "boolean")
    return docs.withColumn(source, whole_text(text_col)).mapInArrow(run, schema)
