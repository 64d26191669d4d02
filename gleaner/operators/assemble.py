"""Putting multi-page results together: grouping, completeness, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# List positions per chunk of a document.
CHUNK_SIZE = 1_000


def call_results(items: DataFrame) -> DataFrame:
    """Items to one row per (phase, srcurl): the data array of a call and its visits.

    Each call on a page gives the same array, so an array of arrays is ``data``
    repeated ``visits`` times. A row holds the items of one page, whatever its in-degree.
    """
    return items.groupBy("phase", F.col("url").alias("srcurl")).agg(
        F.max("visits").alias("visits"),
        F.sort_array(
            F.collect_list(
                F.struct("selector_no", "no", "value", "hashcode", "subvalues", "href")
            )
        ).alias("data"),
    )


def phase_documents(calls: DataFrame) -> DataFrame:
    """One JSON line per (phase, srcurl): the nested dump, in pieces that load in parallel."""
    return calls.select(
        "phase",
        F.to_json(
            F.struct("srcurl", "phase", "visits", "data"), {"ignoreNullFields": "true"}
        ).alias("value"),
    )


def opening_tasks(tasks: DataFrame) -> DataFrame:
    """The tasks that open a document: list pages, that is type 1 on level 1."""
    level = F.coalesce(F.get_json_object("definition", "$.level").cast("int"), F.lit(1))
    return tasks.filter((F.col("type") == 1) & (level == 1))


def expected_children(parents: DataFrame) -> DataFrame:
    """Children per run: the distinct hrefs of its level-1 items; 0 for a run without links."""
    return parents.groupBy("seqno").agg(F.count_distinct("href").alias("expected"))


def arrived_children(children: DataFrame) -> DataFrame:
    """Distinct children per run that have content."""
    return children.groupBy("seqno").agg(F.count_distinct("url").alias("arrived"))


def completeness(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Expected and arrived children of every run and whether it is complete.

    Both sides are counts, one row per run, so the join carries no content.
    """
    arrived = F.coalesce("arrived", F.lit(0))
    return (
        expected_children(parents)
        .join(arrived_children(children), "seqno", "left")
        .select("seqno", "expected", arrived.alias("arrived"))
        .withColumn("complete", F.col("arrived") == F.col("expected"))
    )


def last_per_url(children: DataFrame) -> DataFrame:
    """One content row per (run, url): the one with the highest number wins."""
    return (
        children.groupBy("seqno", "url")
        .agg(F.max(F.struct("no", "value", "hashcode")).alias("last"))
        .select("seqno", "url", "last.no", "last.value", "last.hashcode")
    )


def document_rows(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Rows of complete documents: list items (``kind`` 0) and child contents (``kind`` 1).

    ``place`` is an item's number; a content has the place of the first item that links to it.
    """
    ready = completeness(parents, children).filter("complete").select("seqno")
    listed = parents.select(
        "seqno", F.lit(0).alias("kind"), "url", "no", "value", "hashcode", "href", F.col("no").alias("place")
    )
    linked = (
        parents.filter("href is not null")
        .groupBy("seqno", F.col("href").alias("url"))
        .agg(F.min("no").alias("place"))
    )
    contents = (
        last_per_url(children)
        .join(linked, ["seqno", "url"], "left")
        .select(
            "seqno", F.lit(1).alias("kind"), "url", "no", "value", "hashcode",
            F.lit(None).cast("string").alias("href"), F.coalesce("place", F.lit(1)).alias("place"),
        )
    )
    return listed.unionByName(contents).join(ready, "seqno")


def documents(rows: DataFrame, chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Document rows to documents: a list of items and a map url -> content, in chunks.

    Every document has this form: chunk ``chunk_no`` (from 0) of ``chunks`` holds the items
    at its ``chunk_size`` list positions, in order, and the contents first linked from them.
    A row is bounded by the chunk size, whatever the run.
    """
    item = F.struct("no", "url", "value", "hashcode", "href")
    entry = F.struct(F.col("url").alias("key"), F.struct("value", "no", "hashcode").alias("value"))
    chunks = (
        rows.withColumn("chunk_no", F.floor((F.col("place") - 1) / chunk_size).cast("int"))
        .groupBy("seqno", "chunk_no")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == 0, item))).alias("tablelist"),
            F.map_from_entries(F.collect_list(F.when(F.col("kind") == 1, entry))).alias("contents"),
        )
    )
    sizes = rows.groupBy("seqno").agg(
        (F.floor((F.max("place") - 1) / chunk_size).cast("int") + 1).alias("chunks")
    )
    return chunks.join(sizes, "seqno")


def document_calls(documents: DataFrame) -> DataFrame:
    """Documents as result values: one row per chunk with its JSON, items before contents."""
    body = F.to_json(F.struct("chunk_no", "chunks", "tablelist", "contents"))
    return documents.select("seqno", "chunk_no", body.alias("data"))
