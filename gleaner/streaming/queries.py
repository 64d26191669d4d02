"""Starting streams: engine-kept state, results in files that a restart does not repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB, with its changes in the checkpoint folder; keyed state needs it."""
    spark.conf.set(_PROVIDER, _ROCKS)


def list_in_few_tasks(spark: SparkSession) -> None:
    """New files of a batch looked up by as many tasks as keep all cores busy.

    A file stream names each file, and Spark would start a task for every one, up to 10,000.
    """
    spark.conf.set(_LISTING, str(4 * spark.sparkContext.defaultParallelism))


def append_rows(stream: DataFrame, base: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that appends its rows to ``base``; state and progress lie beside them.

    The sink's log lists the files of finished batches, so that a batch that runs again after
    a loss is read once.
    """
    keep_state_on_disk(stream.sparkSession)
    list_in_few_tasks(stream.sparkSession)
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/output")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def update_rows(stream: DataFrame, base: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that writes the rows each batch changed, in a folder per batch."""
    keep_state_on_disk(stream.sparkSession)
    list_in_few_tasks(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/output/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_output(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/output")
