"""Landed pages: a task sidecar and the raw body of one fetch, joined by run key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys, markup, text
from gleaner.sources.records import TASK_SCHEMA, decode_records, good_records

_FILES = "path string, modificationTime timestamp, length long, content binary"


def landed(tasks: DataFrame, fetched_at: str = "fetched_at", body: str = "body") -> DataFrame:
    """Tasks with a fetched body to landing rows: run key, write time and charset added."""
    at = F.col(fetched_at)
    # What declares a charset is ASCII in every charset a page may declare in it.
    latin = f"decode({body}, 'ISO-8859-1')"
    return tasks.select(
        *[c for c in tasks.columns if c not in (fetched_at, body)],
        keys.seqno(F.col("material_id"), at).alias("seqno"),
        keys.write_time(at).alias("write_time"),
        F.to_date(at).alias("write_day"),
        markup.charset_of(markup.prepare_sql(latin)).alias("charset"),
        F.col(body).alias("body"),
    )


def write_landing(rows: DataFrame, path: str) -> None:
    """Append landing rows, partitioned by day and type.

    Rebalancing evens out the files: a crowded (day, type) is split, thin ones merge.
    """
    rows.hint("rebalance", "write_day", "type").write.mode("append").partitionBy(
        "write_day", "type"
    ).parquet(path)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decoded(rows: DataFrame, body: str = "body", charset: str = "charset") -> DataFrame:
    """Bodies to ``html`` text in one pass; NULL where bytes do not fit the charset.

    A row without a charset is read as UTF-8. Charsets that Spark knows are decoded in the
    JVM; Python is given the bodies in any other one, and NULL for the rest.
    """
    label = F.coalesce(F.col(charset), F.lit("utf-8"))
    native = text.is_native_charset(label)
    kept = [c for c in rows.columns if c != body]
    other = text.decode_other(F.when(~native, F.col(body)), label)
    return rows.select(
        *kept, F.when(native, text.decode_native(F.col(body), label)).otherwise(other).alias("html")
    )


def read_sidecars(
    spark: SparkSession, path: str, stream: bool = False, archive_to: str | None = None
) -> DataFrame:
    """Task sidecars (``*.ini``, JSON on the first line) of a landing folder.

    As a stream each file is read once; with ``archive_to`` a finished file is moved
    there by a later batch. Files are never deleted.
    """
    reader = spark.readStream if stream else spark.read
    reader = reader.format("text").option("pathGlobFilter", "*.ini").option("wholetext", "true")
    if stream and archive_to:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_to)
    first = F.substring_index("value", "\n", 1)
    return decode_records(reader.load(path).select(first.alias("value")), TASK_SCHEMA)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Raw bodies of a folder: the file name is the run key."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.substring_index("path", "/", -1).alias("seqno"), F.col("content").alias("body")
    )


def join_bodies(sidecars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Tasks with their body; run keys are unique on both sides."""
    return sidecars.join(bodies, "seqno")


def orphans(sidecars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Tasks whose body is missing."""
    return sidecars.join(bodies.select("seqno"), "seqno", "left_anti")


def _run_instant() -> Column:
    """The fetch instant at the end of a run key."""
    return F.to_timestamp(F.right("seqno", F.lit(14)), "yyyyMMddHHmmss").alias("at")


def pair_stream(
    spark: SparkSession, work: str, bodies: str, delay: str = "1 hour", archive_to: str | None = None
) -> DataFrame:
    """Tasks of a landing folder with the path of their body, as a stream.

    Sidecars and bodies are two streams joined by run key; either may come first. A task
    whose body has not come when the watermark of both, ``delay`` behind their newest run,
    passes its fetch instant comes out with a NULL path: an orphan. State holds keys and paths
    of the last ``delay``, no bodies. Blank or broken sidecars give no task.
    """
    tasks = good_records(read_sidecars(spark, work, stream=True, archive_to=archive_to))
    tasks = tasks.select("*", _run_instant()).withWatermark("at", delay)
    files = spark.readStream.format("binaryFile").schema(_FILES).load(bodies)
    found = files.select(F.substring_index("path", "/", -1).alias("seqno"), "path")
    found = found.select("*", _run_instant()).withWatermark("at", delay)
    return tasks.join(found, ["seqno", "at"], "left_outer")


def with_bodies(pairs: DataFrame, bodies: str) -> DataFrame:
    """Paired tasks with ``body`` in place of the path; orphans have none."""
    files = pairs.sparkSession.read.format("binaryFile").load(bodies)
    return pairs.join(files.select("path", F.col("content").alias("body")), "path", "left").drop("path")
