"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: list[str] = []


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Shuffle partitions start high and are coalesced at run time, so one setting
    serves both a laptop and a large cluster; skewed join partitions are split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session that names none gets a temporary folder; on a cluster a
    machine-local folder would vanish with its executor, so that is an error.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="gleaner-"))
    return _local_dirs[0]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, one per call."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans start at the files: they do not recompute ``df``, survive the loss
    of executors, and see its true size when they choose a join strategy.
    """
    spark = df.sparkSession
    target = path or run_dir(spark, label)
    df.write.options(**options).mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
