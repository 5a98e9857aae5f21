"""Session helpers: a local session for tests/bench and reliable lineage cutting.

Library functions never build their own session; they take DataFrames. The only
session-level concern inside the library is where iterative jobs write checkpoints:
the cluster names a shared folder in ``spark.checkpoint.dir`` and we use it.  A private folder
is made only on a local master (tests, the bench) that names none; a cluster that names none raises.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """Session for tests and the bench: local mode, no UI, AQE on, UTC."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder: the cluster's ``spark.checkpoint.dir``; a fresh one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            configured = None
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and return a plan that reads it.

    The result is a plain file scan: durable (a lost executor does not lose it, unlike local
    checkpoints), and a fresh leaf, so iterative plans neither grow nor carry statistics of
    their origin plans (which ``Dataset.checkpoint`` re-derives on every round)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/strata-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the number of rows, observed by the write itself."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, int(seen.get["n"])


def release(*frames: DataFrame | None) -> None:
    """Delete what ``cut_lineage`` wrote for these frames.  Only for steps of a loop that later,
    already written steps have replaced; no plan may still read them."""
    for df in frames:
        if df is not None and (path := getattr(df, "_strata_path", None)):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
