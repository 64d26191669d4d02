"""Newline-JSON records: good ones typed, bad ones set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

TASK_SCHEMA = (
    "pid string, materialId long, uuid string, type int, url string, domain string, "
    "writeTime string, seqno string, charset string, definition string"
)


def read_lines(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Text lines of a folder, in batch or as a file stream."""
    reader = spark.readStream if stream else spark.read
    return reader.options(**options).text(path)


def decode_records(lines: DataFrame, schema: str | StructType, column: str = "value") -> DataFrame:
    """Parse JSON lines into ``record``; ``corrupt`` keeps the text of a line that does not parse.

    Blank lines are skipped. The same rows come from a batch or a stream.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    full = StructType([*schema.fields]).add("_corrupt", StringType())
    raw = F.col(column)
    parsed = F.from_json(raw, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    kept = lines.filter(raw.isNotNull() & (F.trim(raw) != ""))
    rows = kept.withColumn("_parsed", parsed)
    fields = [F.col("_parsed")[f.name].alias(f.name) for f in schema.fields]
    return rows.select(
        *[c for c in lines.columns],
        F.struct(*fields).alias("record"),
        F.col("_parsed._corrupt").alias("corrupt"),
    )


def good_records(decoded: DataFrame) -> DataFrame:
    return decoded.filter("corrupt is null").select("record.*")


def quarantine(decoded: DataFrame) -> DataFrame:
    """Lines that did not parse, as text."""
    return decoded.filter("corrupt is not null").select("corrupt")
