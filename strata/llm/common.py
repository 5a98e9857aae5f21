"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import cut_lineage

#: 64-bit odd multipliers of the splitmix64 finaliser (fixed values).
_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Written to the session's shared checkpoint folder and read back: a durable leaf whose real
    size Spark knows when it plans the next join."""
    return cut_lineage(df)


#: Rows of an Arrow batch that go to a worker at once; texts may be long, so far fewer than the default.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of the session's Python workers, unless the session has set its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))


def unused(df: DataFrame, base: str = "_text") -> str:
    """A column name that ``df`` doesn't have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def whole_text(col: str | Column = "text") -> Column:
    """The text as it is, null as the empty string."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_fold(col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (0 for a null id)."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds, F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser over an uint64 array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_M1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_M2)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20, max_rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of at most ``max_rows`` rows whose ``column`` text sums to about
    ``max_bytes`` (one row at least), so the arrays made for a run stay bounded."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) // max_bytes) * (batch.num_rows + 1) + np.arange(batch.num_rows) // max_rows
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
    _release()


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Joins batches that follow each other up to ``max_bytes``; a larger one stays alone."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > max_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def _release() -> None:
    """Gives memory that a batch no longer needs back to the system; workers live long."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


_LIBC = ctypes.CDLL(None)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each (s, n)."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


_MARKS = re.compile(r"\W+")


def word_codes(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of all words one after the other, the distinct words, words for each text.  Words
    stand between white space and lose case and marks; one of marks only stays as it is."""
    lists = [t.split() for t in texts]
    flat = [w for ws in lists for w in ws]
    codes, distinct = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    clean = [w.lower() if w.isalnum() else _MARKS.sub("", w.lower()) or w for w in distinct]
    return codes, clean, np.fromiter(map(len, lists), np.int64, len(lists))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word's code points, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    points = np.frombuffer("".join(f"{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    place = (np.arange(len(points)) - np.repeat(start, size)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(points + place * np.uint64(0x9E3779B97F4A7C15)), start))
