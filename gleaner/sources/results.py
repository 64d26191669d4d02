"""Result sinks: partitioned JSON rows, phase output, documents."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys, markup, text, urls
from gleaner.functions.sqltext import fresh, let
from gleaner.operators.extract import Selector


def page_results(prepared: DataFrame, selectors: Sequence[Selector], base: str = "url") -> DataFrame:
    """One row per page with ``value``, the array of its items over all selectors.

    The array is built inside the row, so a page's items are never shuffled together.
    """

    def items(selector: Selector) -> str:
        found = markup.matches_sql("markup", markup.parse_steps(selector.xpath))
        if selector.item_limit >= 0:
            found = f"slice({found}, 1, {selector.item_limit})"

        def item(element: str, index: str) -> str:
            href = let(
                markup.attribute_sql(f"{element}.open", "href"),
                lambda h: f"if({h} IS NULL, NULL, {urls.abs_url_sql(base, h)})",
            )
            return (
                f"named_struct('no', {index} + 1, 'value', {element}.text, "
                f"'hashcode', md5({element}.text), 'href', {href})"
            )

        element, index = fresh(), fresh()
        return f"transform({found}, ({element}, {index}) -> {item(element, index)})"

    value = F.expr(f"flatten(array({', '.join(map(items, selectors))}))")
    kept = [c for c in prepared.columns if c != "markup"]
    return prepared.select(*kept, value.alias("value"))


def result_rows(
    results: DataFrame, inserted_at: Column, period: str | Column = keys.DEFAULT_PERIOD
) -> DataFrame:
    """Result rows of the pages that gave data; the instant is given, so reruns agree."""
    return results.filter(F.size("value") > 0).select(
        "material_id",
        "seqno",
        F.to_date(inserted_at).alias("insert_day"),
        keys.envelope(F.col("charset"), F.col("url"), F.col("value")).alias("contents"),
        inserted_at.alias("insert_time"),
        (period if isinstance(period, Column) else F.lit(period)).alias("period"),
        "pid",
    )


def generic_rows(
    results: DataFrame, inserted_at: Column, period: str | Column = keys.DEFAULT_PERIOD
) -> DataFrame:
    """Result rows whose contents are ``data`` as it stands; blank data gives no row."""
    return results.filter(~text.is_blank(F.col("data"))).select(
        "material_id",
        "seqno",
        F.to_date(inserted_at).alias("insert_day"),
        F.col("data").alias("contents"),
        inserted_at.alias("insert_time"),
        (period if isinstance(period, Column) else F.lit(period)).alias("period"),
        "pid",
    )


def write_lines(documents: DataFrame, path: str) -> None:
    """One line per row of (phase, value), a folder per phase."""
    documents.write.mode("append").partitionBy("phase").text(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Append result rows by (period, pid); a crowded pid is split into several files."""
    rows.hint("rebalance", "period", "pid").write.mode("append").partitionBy(
        "period", "pid"
    ).parquet(path)


_STORED = (
    "material_id long, seqno string, insert_day date, contents string, insert_time timestamp, "
    "period string, pid string"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored result rows; none if nothing was written."""
    return spark.read.schema(_STORED).parquet(path)


# A batch is committed by its entry in the ledger, the last thing it writes.
_LEDGER = "period string, pid string, rows long, attempt string, batch string"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def write_once(rows: DataFrame, path: str, batch: str) -> bool:
    """Append result rows as one batch, once: False, and nothing written, if it is there already.

    Rows go to a folder of this attempt; the ledger entry with the rows per (period, pid) makes
    them visible. A writer that dies in between leaves files that no reader sees, and the
    repeated batch writes its own.
    """
    spark = rows.sparkSession
    if not _ledger(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    target = f"{path}/data/attempt={attempt}"
    write_results(rows, target)
    written = spark.read.schema(_STORED).parquet(target) if not rows.isEmpty() else rows
    entry = written.groupBy("period", "pid").agg(F.count("*").alias("rows"))
    entry = entry.withColumn("attempt", F.lit(attempt)).withColumn("batch", F.lit(batch)).coalesce(1)
    entry.write.mode("append").partitionBy("batch").parquet(f"{path}/ledger")
    return True


def committed_batches(spark: SparkSession, path: str) -> DataFrame:
    """``batch, period, pid, rows`` of what readers see."""
    return _ledger(spark, path).select("batch", "period", "pid", "rows")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of committed batches; the folders of other attempts are not read."""
    attempts = _ledger(spark, path).select("attempt").distinct()
    stored = spark.read.schema(f"{_STORED}, attempt string").parquet(f"{path}/data")
    return stored.join(attempts, "attempt", "left_semi").drop("attempt")


def write_phases(calls: DataFrame, path: str) -> None:
    """JSON lines per phase, UTF-8 kept as it is."""
    calls.write.mode("append").partitionBy("phase").json(path)
