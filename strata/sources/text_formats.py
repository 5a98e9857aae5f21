"""Line-oriented formats: edge lists, points, LIBSVM, vector text and JSON, labeled points.

Every reader is ``spark.read.text`` followed by a parser written as DataFrame expressions
(``parse_*``), so parsing runs in the executors' JVM and can also be applied to any
DataFrame of lines.  Writers are the inverse expressions followed by ``write.text``.
Malformed input raises inside the job (``raise_error`` / ANSI casts) instead of being
silently dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import vectors as V
from strata.functions._util import let

VECTOR_STRUCT = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


# ----------------------------------------------------------------------------- edge lists

def parse_edge_lines(lines: DataFrame, canonical: bool = False, line_col: str = "value") -> DataFrame:
    """Lines -> (src bigint, dst bigint, attr int = 1).

    Skips empty lines and lines starting with '#' or a letter; splits on whitespace; extra
    fields are ignored; a line with fewer than two fields raises.  Leading blanks are trimmed
    before splitting."""
    line = F.col(line_col)
    keep = (F.length(line) > 0) & ~line.rlike(r"^[#\p{L}]")
    body = lines.filter(keep).select(F.split(F.trim(line), r"\s+").alias("_f"), line.alias("_l"))
    fields = F.when(F.size("_f") >= 2, F.col("_f")).otherwise(
        F.raise_error(F.concat(F.lit("an edge needs two vertex ids: "), F.col("_l"))).cast("array<string>"))
    parsed = body.select(fields.alias("_f")).select(
        F.get("_f", 0).cast("long").alias("src"), F.get("_f", 1).cast("long").alias("dst"))
    if canonical:
        parsed = parsed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return parsed.withColumn("attr", F.lit(1))


def read_edge_list(spark: SparkSession, path: str, canonical: bool = False, partitions: int = -1) -> DataFrame:
    lines = spark.read.text(path)
    if partitions > 0:
        lines = lines.coalesce(partitions)
    return parse_edge_lines(lines, canonical)


def format_edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))


# ----------------------------------------------------------------------------- points

def parse_point_lines(lines: DataFrame, sep: str = r"\s+", line_col: str = "value", keep=()) -> DataFrame:
    """One point per line; ``sep`` is a regex; every field becomes a double.  ``keep`` columns
    pass through."""
    return lines.select(*keep, F.transform(F.split(F.col(line_col), sep), lambda t: t.cast("double")).alias("features"))


def read_points(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    return parse_point_lines(spark.read.text(path), sep)


def format_point_lines(points: DataFrame, col: str = "features", sep: str = " ", keep=()) -> DataFrame:
    return points.select(*keep, F.array_join(F.transform(col, lambda x: x.cast("string")), sep).alias("value"))


#: Points of a row block of a column file.
COLUMN_BLOCK = 4096


def parse_column_lines(lines: DataFrame, dim_col: str = "dim", line_col: str = "value", keep=(), block_rows: int = COLUMN_BLOCK) -> DataFrame:
    """Column file: line ``dim`` holds that dimension of every point -> (row, features).

    ``keep`` columns identify one file among many (e.g. a row block) and pass through.  A line is
    cut by position into blocks of ``block_rows`` values inside its own row; the blocks of one
    position meet, one of each dimension, and are turned into points there, so no row or group
    grows with the number of points.  Dimensions of different lengths raise."""
    keep = list(keep)

    def cut(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / block_rows).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(values, b * block_rows + 1, F.lit(block_rows)))

    words = F.filter(F.split(F.col(line_col), r"\s+"), lambda w: w != "")
    blocks = lines.select(*keep, F.col(dim_col).alias("_d"), words.alias("_words"))
    blocks = blocks.select(*keep, "_d", F.size("_words").alias("_n"), F.posexplode(let(F.col("_words"), cut)).alias("_b", "_w"))
    column = F.struct("_d", "_n", F.transform("_w", lambda t: t.cast("double")).alias("_x"))
    g = blocks.groupBy(*keep, "_b").agg(F.array_sort(F.collect_list(column)).alias("_p"))

    def points(p: Column) -> Column:
        # every line is in its file's first block, so one that is shorter or longer shows there
        n = F.element_at(p, 1)["_n"]
        even = F.forall(p, lambda c: c["_n"] == n)
        rows = F.transform(F.sequence(F.lit(0), F.size(F.element_at(p, 1)["_x"]) - 1), lambda k: F.transform(p, lambda c: F.get(c["_x"], k)))
        return F.when(~even, F.raise_error(F.lit("the lines of a column file must have equally many values")).cast("array<array<double>>")).when(n > 0, rows)

    ex = g.select(*keep, "_b", F.posexplode(let(F.col("_p"), points)).alias("_k", "features"))
    return ex.select(*keep, (F.col("_b") * F.lit(block_rows).cast("long") + F.col("_k")).alias("row"), "features")


def read_points_by_column(spark: SparkSession, path: str, block_rows: int = COLUMN_BLOCK) -> DataFrame:
    """File with one line per dimension; line order gives the dimension."""
    from strata.operators.layout import row_index

    lines = spark.read.text(path).withColumn("_mid", F.monotonically_increasing_id())
    numbered = lines.join(row_index(lines.select("_mid"), "_mid", "dim"), "_mid")  # only the numbers are written
    return parse_column_lines(numbered, block_rows=block_rows)


# ----------------------------------------------------------------------------- LIBSVM

def _ascending(idx: Column) -> Column:
    return F.forall(F.sequence(F.lit(1), F.greatest(F.size(idx) - 1, F.lit(1))),
                    lambda k: (F.size(idx) < 2) | (F.get(idx, k) > F.get(idx, k - 1)))


def parse_libsvm_lines(lines: DataFrame, num_features: int = -1, line_col: str = "value", keep=()) -> DataFrame:
    """``label i:v ...`` (1-based ascending indices) -> (label double, features sparse struct).

    Lines are trimmed; empty lines and lines starting with '#' are skipped.  Non-ascending
    indices raise.  ``num_features`` <= 0 infers max(last index) + 1 over the data (a one-row
    aggregate joined back, nothing collected)."""
    keep = list(keep)
    line = F.trim(F.col(line_col))
    body = lines.select(*keep, line.alias("_l")).filter((F.length("_l") > 0) & ~F.col("_l").startswith("#"))
    items = F.split("_l", " ")
    parsed = body.select(
        *keep, "_l",
        F.get(items, 0).cast("double").alias("label"),
        F.filter(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), lambda t: t != F.lit("")).alias("_kv"))
    parsed = parsed.select(
        *keep, "_l", "label",
        F.transform("_kv", lambda t: F.get(F.split(t, ":"), 0).cast("int") - 1).alias("_i"),
        F.transform("_kv", lambda t: F.get(F.split(t, ":"), 1).cast("double")).alias("_v"))

    ok = let(F.col("_i"), lambda idx: _ascending(idx) & (F.coalesce(F.get(idx, 0), F.lit(0)) >= 0))
    checked = parsed.select(
        *keep, "label", F.when(ok, F.col("_i")).otherwise(F.raise_error(F.concat(
            F.lit("feature numbers must start at 1 and rise: "), F.col("_l"))).cast("array<int>")).alias("_i"),
        "_v")
    if num_features and num_features > 0:
        size = F.lit(int(num_features))
        return checked.select(*keep, "label", V.sparse(size, "_i", "_v").alias("features"))
    m = checked.agg(F.max(F.coalesce(F.element_at("_i", -1), F.lit(-1)) + 1).alias("_nf"))
    return checked.crossJoin(F.broadcast(m)).select(*keep, "label", V.sparse(F.col("_nf"), "_i", "_v").alias("features"))


def read_libsvm(spark: SparkSession, path: str, num_features: int = -1) -> DataFrame:
    return parse_libsvm_lines(spark.read.text(path), num_features)


def infer_num_features(points: DataFrame, col: str = "features") -> DataFrame:
    """max last active index + 1 (one row: num_features)."""
    return points.agg(F.max(F.coalesce(F.element_at(F.col(col).getField("indices"), -1), F.lit(-1)) + 1)
                      .alias("num_features"))


def format_libsvm_lines(df: DataFrame, label_col: str = "label", col: str = "features", keep=()) -> DataFrame:
    """Active entries (explicit zeros kept), 1-based: ``label i:v ...``."""
    f = F.col(col)
    pairs = F.transform(F.arrays_zip(f.getField("indices").alias("i"), f.getField("values").alias("v")),
                        lambda p: F.concat((p["i"] + 1).cast("string"), F.lit(":"), p["v"].cast("string")))
    return df.select(*keep, F.concat_ws(" ", F.col(label_col).cast("double").cast("string"), F.array_join(pairs, " "))
                     .alias("value"))


def write_libsvm(df: DataFrame, path: str, label_col: str = "label", col: str = "features") -> None:
    format_libsvm_lines(df, label_col, col).write.mode("overwrite").text(path)


# ----------------------------------------------------------------------------- vector text / JSON

def _num_list(s: Column, cast: str) -> Column:
    return F.when(F.trim(s) == "", F.array().cast(f"array<{cast}>")).otherwise(
        F.transform(F.split(s, ","), lambda t: F.trim(t).cast(cast)))


def _checked_vector(v: Column, source: Column) -> Column:
    """The vector struct, or an error naming its source: a dense vector needs its values, a sparse
    one as many values as indices, the indices ascending within ``[0, size)``."""
    def fits(x):
        idx, vals = x["indices"], x["values"]
        last = F.coalesce(F.try_element_at(idx, F.lit(-1)), F.lit(-1))
        sparse = (F.size(idx) == F.size(vals)) & _ascending(idx) & (F.coalesce(F.get(idx, 0), F.lit(0)) >= 0) & (last < x["size"])
        return F.forall(vals, lambda y: y.isNotNull()) & F.when(x["type"] == 1, F.lit(True)).otherwise(sparse)

    return let(v, lambda x: F.when(F.coalesce(fits(x), F.lit(False)), x).otherwise(
        F.raise_error(F.concat(F.lit("cannot parse vector: "), F.coalesce(source, F.lit("null")))).cast(VECTOR_STRUCT)))


def parse_vector_text(s) -> Column:
    """``[v,...]`` (dense) or ``(size,[i,...],[v,...])`` (sparse) -> VectorUDT-shaped struct.
    Anything else raises: open brackets, unequal lengths, indices out of range or order, null."""
    s = F.trim(F.col(s) if isinstance(s, str) else s)
    dense = F.regexp_extract(s, r"^\[(.*)\]$", 1)
    sp_size = F.regexp_extract(s, r"^\(\s*(\d+)\s*,", 1)
    sp_idx = F.regexp_extract(s, r"^\(\s*\d+\s*,\s*\[([^\]]*)\]", 1)
    sp_val = F.regexp_extract(s, r"\]\s*,\s*\[([^\]]*)\]\s*\)$", 1)
    is_dense = s.rlike(r"^\[[^\[\]()]*\]$")
    is_sparse = s.rlike(r"^\(\s*\d+\s*,\s*\[[^\[\]()]*\]\s*,\s*\[[^\[\]()]*\]\s*\)$")
    dense_v = F.struct(F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"),
                       F.lit(None).cast("array<int>").alias("indices"),
                       _num_list(dense, "double").alias("values"))
    sparse_v = F.struct(F.lit(0).cast("tinyint").alias("type"), sp_size.cast("int").alias("size"),
                        _num_list(sp_idx, "int").alias("indices"), _num_list(sp_val, "double").alias("values"))
    return _checked_vector(F.when(is_dense, dense_v).when(is_sparse, sparse_v), s)


def format_vector_text(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    vals = F.array_join(F.transform(v["values"], lambda x: x.cast("string")), ",")
    idx = F.array_join(F.transform(v["indices"], lambda x: x.cast("string")), ",")
    return F.when(v["type"] == 1, F.concat(F.lit("["), vals, F.lit("]"))).otherwise(
        F.concat(F.lit("("), v["size"].cast("string"), F.lit(",["), idx, F.lit("],["), vals, F.lit("])")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_vector_text("value").alias("features"))


def write_vectors(df: DataFrame, path: str, col: str = "features") -> None:
    df.select(format_vector_text(col).alias("value")).write.mode("overwrite").text(path)


_JSON_SCHEMA = "type int, size int, indices array<int>, values array<double>"


def parse_vector_json(s) -> Column:
    """``{"type":0,"size":n,"indices":[...],"values":[...]}`` or ``{"type":1,"values":[...]}``.
    Raises where ``parse_vector_text`` would."""
    s = F.col(s) if isinstance(s, str) else s
    j = F.from_json(s, _JSON_SCHEMA)
    ok = j["type"].isin(0, 1)
    v = F.struct(j["type"].cast("tinyint").alias("type"),
                 F.when(j["type"] == 0, j["size"]).alias("size"),
                 F.when(j["type"] == 0, j["indices"]).alias("indices"),
                 j["values"].alias("values"))
    return _checked_vector(F.when(ok, v), s)


def format_vector_json(v) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    dense = F.to_json(F.struct(F.lit(1).alias("type"), v["values"].alias("values")))
    sparse = F.to_json(F.struct(F.lit(0).alias("type"), v["size"].alias("size"), v["indices"].alias("indices"),
                                v["values"].alias("values")))
    return F.when(v["type"] == 1, dense).otherwise(sparse)


def read_vectors_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_vector_json("value").alias("features"))


def write_vectors_json(df: DataFrame, path: str, col: str = "features") -> None:
    df.select(format_vector_json(col).alias("value")).write.mode("overwrite").text(path)


def dense_vector(arr) -> Column:
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.struct(F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"),
                    F.lit(None).cast("array<int>").alias("indices"), arr.cast("array<double>").alias("values"))


def sparse_vector(sp) -> Column:
    sp = F.col(sp) if isinstance(sp, str) else sp
    return F.struct(F.lit(0).cast("tinyint").alias("type"), sp["size"].alias("size"),
                    sp["indices"].alias("indices"), sp["values"].alias("values"))


# ----------------------------------------------------------------------------- labeled points

def parse_labeled_point(s) -> Column:
    """``(label,vector)`` with a dense or sparse vector text, or the older ``label,v v v`` -> struct
    (label, features).  Anything else raises."""
    s = F.trim(F.col(s) if isinstance(s, str) else s)
    paired = s.startswith("(")
    label = F.when(paired, F.regexp_extract(s, r"^\(\s*([^,]+)\s*,", 1)).otherwise(F.trim(F.regexp_extract(s, r"^([^,]+),", 1)))
    older = F.concat(F.lit("["), F.regexp_replace(F.trim(F.regexp_extract(s, r"^[^,]+,([^,]*)$", 1)), r"\s+", ","), F.lit("]"))
    vec = F.when(paired, F.regexp_extract(s, r"^\(\s*[^,]+\s*,\s*(.*)\)$", 1)).when(s.rlike(r"^[^,]+,[^,]*$"), older).otherwise(s)
    return F.struct(label.cast("double").alias("label"), parse_vector_text(vec).alias("features"))


def format_labeled_point(label, v) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.concat(F.lit("("), label.cast("double").cast("string"), F.lit(","), format_vector_text(v), F.lit(")"))


def read_labeled_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(parse_labeled_point("value").alias("_p")).select("_p.*")
