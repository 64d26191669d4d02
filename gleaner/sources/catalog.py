"""Material and catalog tables, from files or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Fixed value: status of a material that is to be collected.
ACTIVE = 2


def range_predicates(ranges: list[tuple[int, int]], id_col: str = "materialId") -> list[str]:
    """One WHERE clause per half-open range; each becomes one partition of a JDBC scan.

    Ranges must not overlap: a row would be read twice.
    """
    ordered = sorted(ranges)
    for (_, high), (low, _) in zip(ordered, ordered[1:], strict=False):
        if low < high:
            raise ValueError(f"ranges overlap at {low}")
    return [f"{id_col} >= {int(low)} AND {id_col} < {int(high)}" for low, high in ranges]


def read_materials_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    ranges: list[tuple[int, int]],
    properties: dict[str, str] | None = None,
    status: int = ACTIVE,
    pid: str | None = None,
) -> DataFrame:
    """Active materials of a list of ranges, one connection and one task per range.

    One table holds one partition: ``pid`` names it. Ids come as ``material_id``.
    """
    options = {"fetchsize": "10000", **(properties or {})}
    rows = spark.read.jdbc(url, table, predicates=range_predicates(ranges), properties=options)
    rows = rows.filter(f"status = {int(status)}").withColumnRenamed("materialId", "material_id")
    return rows.withColumn("pid", F.lit(pid))


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None
) -> DataFrame:
    """A whole catalog table."""
    return spark.read.jdbc(url, table, properties=properties or {})


def read_materials(spark: SparkSession, path: str, pid: str | None = None) -> DataFrame:
    """Materials stored as files partitioned by ``pid``, a string; one pid reads its folder only."""
    schema = spark.read.parquet(path).schema
    typed = StructType([StructField("pid", StringType()) if f.name == "pid" else f for f in schema])
    rows = spark.read.schema(typed).parquet(path)
    return rows if pid is None else rows.filter(rows.pid == pid)


def write_materials(materials: DataFrame, path: str) -> None:
    """Materials in folders by ``pid``, sorted by id in each file, so that a scan of ids skips row groups."""
    spread = materials.repartitionByRange("pid", "material_id").sortWithinPartitions("pid", "material_id")
    spread.write.mode("overwrite").partitionBy("pid").parquet(path)
