"""Whole-document input, UTF-8 repair, and the cluster-model format.

Where folders are mounted, documents are listed and read by tasks, as plain files: Spark's reader keeps
the status of every file in the driver's memory, which some million files of a few KB each exceed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strata.session import cut_lineage

# Metadata written with a saved cluster model.
CLUSTER_MODEL_CLASS = "org.apache.spark.mllib.clustering.KMeansModel"
CLUSTER_MODEL_VERSION = "1.0"


#: Folder of rows without an id, as Spark names it.
NO_ID = "__HIVE_DEFAULT_PARTITION__"

#: Bytes of text, and names, that a task hands on at once; one text is never cut.
HELD_BYTES, HELD_NAMES = 4 << 20, 10_000
#: A task lists at most about so many folders, and reads so many files or bytes; more make more tasks.
TASK_NAMES, TASK_BYTES = 50_000, 128 << 20

#: What a URI's path holds only as %XX: ASCII but for these, blanks and control characters.
_QUOTED = re.compile(r"[^A-Za-z0-9_.!~'()*:@&=+$,;/\x80-\U0010ffff-]|[\x80-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def write_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """One file per id, ``<path>/<id_col>=<id>/*.txt``: its texts (no nulls), each with a line feed.

    ``path`` must be new, and shared by the driver and all executors.  On a mounted folder the tasks
    write plain files under their final name at the end, so a task may run again; Spark's own
    writer forks a process for the mode of each of a file's parts there, and its driver moves all
    folders one by one.  Other file systems take Spark's writer."""
    rows = docs.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull())
    # a number of partitions, as small texts of many ids must not be put together in a few tasks
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        rows.write.partitionBy(id_col).text(path)
        return
    top = path if not at.scheme else unquote(at.path)
    os.makedirs(top)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{os.path.dirname(out.name)}/part-0.txt")

        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True):
                if out is None or name != now:
                    close()
                    folder = f"{top}/{id_col}={quote(name, safe='') if name else NO_ID}"
                    os.makedirs(folder, exist_ok=True)
                    out, now, n = open(f"{folder}/.{uuid.uuid4().hex}", "wb"), name, n + 1  # noqa: SIM115
                out.write(text)
                out.write(b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    named = rows.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("text"))
    named.sortWithinPartitions("name").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def read_documents(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """One row per file: (path, text).  Files are read whole by the executors.  ``nested``: the
    ``.txt`` files of all folders below ``path``, which tasks list.

    A nested folder that is mounted (by the driver and all executors) is listed level by level into the
    checkpoint folder; the driver knows numbers only.  Patterns and other file systems take Spark's reader."""
    if nested and (top := _mounted_folder(spark, path)):
        files, number, size = _list_files(spark, top)
        got = _dealt(files, number, size).mapInArrow(_read_files, "path string not null, text binary")
        return got.select("path", F.col("text").cast("string"))
    df = spark.read.text(path, wholetext=True, **({"recursiveFileLookup": True, "pathGlobFilter": "*.txt"} if nested else {}))
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The plain folder that ``path`` is, if it is one and no pattern."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    plain = uri.getScheme() == "file" and not re.search(r"[][{}*?\\]", uri.getPath()) and os.path.isdir(uri.getPath())
    return uri.getPath() if plain else None


def _dealt(names: DataFrame, number: int, size: int = 0) -> DataFrame:
    """``names`` dealt evenly over as many tasks as their number and bytes ask for."""
    usual = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(max(1, min(number, usual), number // TASK_NAMES, size // TASK_BYTES), "path")


def _list_files(spark: SparkSession, top: str) -> tuple[DataFrame, int, int]:
    """The ``.txt`` files below ``top``, their number and bytes.  A level of folders is one job."""
    files, number, size = spark.createDataFrame([], "path string"), 0, 0
    level, folders = spark.createDataFrame([(top,)], "path string"), 1
    while folders:
        seen = Observation()
        found = _dealt(level, folders).mapInArrow(_list_folders, "path string, size bigint")
        found = cut_lineage(found.observe(seen, F.count("size").alias("files"), F.sum("size").alias("bytes"),
                                          F.count_if(F.col("size").isNull()).alias("folders")))
        folders, number, size = seen.get["folders"], number + seen.get["files"], size + (seen.get["bytes"] or 0)
        files = files.unionByName(found.filter("size is not null").select("path"))
        level = found.filter("size is null").select("path")
    return files, number, size


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in the folders, and is visible to Spark: files that end in .txt and aren't empty, folders (no size)."""
    paths: list[str] = []
    sizes: list[int | None] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())})

    for b in batches:
        for folder in b.column("path").to_pylist():
            with os.scandir(folder) as entries:
                for e in entries:
                    size, is_folder = None, e.is_dir()
                    if not _visible(e.name, is_folder):
                        continue
                    if not is_folder:
                        try:
                            size = e.stat().st_size if e.name.endswith(".txt") else 0
                        except FileNotFoundError:  # a link to nothing
                            continue
                        if not size:
                            continue
                    paths.append(e.path)
                    sizes.append(size)
                    if len(paths) == HELD_NAMES:
                        yield batch()
                        paths, sizes = [], []
    yield batch()


def _visible(name: str, is_folder: bool) -> bool:
    """Not one of the names that Spark leaves out, nor one that is no text."""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    if hidden and not (is_folder and name.startswith(("_common_metadata", "_metadata"))):
        return False
    return name.isascii() or name.encode(errors="ignore").decode() == name


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path, as a URI, and bytes of each file."""
    for b in batches:
        paths: list[str] = []
        texts: list[bytes] = []
        held = 0
        for path in b.column("path").to_pylist():
            with open(path, "rb") as f:
                text = f.read()
            _check_sums(path, text)
            if texts and held + len(text) > HELD_BYTES:
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.binary())})
                paths, texts, held = [], [], 0
            paths.append("file://" + _QUOTED.sub(lambda m: quote(m[0], safe=""), path))
            texts.append(text)
            held += len(text)
        if texts:
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.binary())})


def _check_sums(path: str, data: bytes) -> None:
    """Raises if ``data`` isn't what the sums that Hadoop's writers leave beside a file say."""
    folder, name = os.path.split(path)
    try:
        with open(f"{folder}/.{name}.crc", "rb") as f:
            sums = f.read()
    except FileNotFoundError:
        return
    each = int.from_bytes(sums[4:8], "big")
    if sums[:4] != b"crc\0" or not each:
        return
    for i, at in enumerate(range(0, len(data), each)):
        if zlib.crc32(data[at:at + each]) != int.from_bytes(sums[8 + 4 * i:12 + 4 * i], "big"):
            raise OSError(f"checksum error: {path} at {at}")


def read_documents_repaired(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_documents`` but malformed UTF-8 byte sequences become U+FFFD."""
    raw = spark.read.format("binaryFile").load(path)
    return repair_utf8(raw.select(F.col("path"), F.col("content")), "content", "text").drop("content")


def repair_utf8(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Binary or string column -> valid UTF-8 string, malformed bytes replaced by U+FFFD."""
    c = F.col(col)
    as_str = c.cast("string") if dict(df.dtypes)[col] == "binary" else c
    return df.withColumn(out_col or col, F.make_valid_utf8(as_str))


def save_clusters(centers: DataFrame, path: str, id_col: str = "center_id", col: str = "center") -> None:
    """Metadata JSON {class, version, k} + parquet rows (id int, point array<double>)."""
    spark = centers.sparkSession
    data = centers.select(F.col(id_col).cast("int").alias("id"), F.col(col).cast("array<double>").alias("point"))
    k = data.count()
    meta = json.dumps({"class": CLUSTER_MODEL_CLASS, "version": CLUSTER_MODEL_VERSION, "k": int(k)})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    data.write.mode("overwrite").parquet(f"{path}/data")


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Load and validate a saved model: class, version, schema and k = row count; sorted by id."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    if meta.get("class") != CLUSTER_MODEL_CLASS or meta.get("version") != CLUSTER_MODEL_VERSION:
        raise ValueError(f"unsupported model metadata {meta}")
    data = spark.read.parquet(f"{path}/data")
    expected = {"id": "int", "point": "array<double>"}
    if dict(data.dtypes) != expected:
        raise ValueError(f"unexpected model schema {data.dtypes}")
    n = data.count()
    if n != int(meta["k"]):
        raise ValueError(f"model says k={meta['k']} but has {n} centers")
    return data.orderBy("id").select(F.col("id").alias("center_id"), F.col("point").alias("center"))
