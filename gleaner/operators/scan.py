"""Scans by id range: filters, pages of a scan, range plans, range joins and splits.

Ids are whole numbers. Wherever neighbours matter, rows are first range-partitioned
into ordered buckets of about the same size, whatever the ids look like and however
many belong to one partition; single rows then link a bucket with the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.keys import fragment_width
from gleaner.session import cut_lineage

ROWS_PER_BUCKET = 1_000_000


def scan_range(
    materials: DataFrame,
    start: int,
    end: int,
    status: object = 2,
    id_col: str = "material_id",
    status_col: str = "status",
) -> DataFrame:
    """Rows of one status with ``start <= id < end``; both tests reach the file scan."""
    ident = F.col(id_col)
    return materials.filter((F.col(status_col) == status) & (ident >= start) & (ident < end))


def _ordered_buckets(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows with a ``_bucket`` number that follows ``order``, about ``size`` rows in each.

    The result is written: bucket bounds come from a sample and must not change between
    the plans that read them.
    """
    count = max(1, -(-rows.count() // size))
    ranged = rows.repartitionByRange(count, *order)
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()), "buckets")


def number_pages(
    rows: DataFrame, page_size: int, id_col: str, bucket_rows: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Page number (from 0) of every row in a scan ordered by its unique id.

    The rank inside an ordered bucket plus the number of rows in earlier buckets: the
    only thing that passes through one task is a count per bucket.
    """
    bucketed = _ordered_buckets(rows, [id_col], bucket_rows)
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col))
    ranked = bucketed.withColumn("_rank", within).join(before, "_bucket")
    page = F.floor((F.col("_before") + F.col("_rank") - 1) / page_size)
    return ranked.withColumn("page_no", page).drop("_bucket", "_before", "_rank")


def page_after(rows: DataFrame, page_size: int, id_col: str, after: int | None = None) -> DataFrame:
    """The next page of a scan, by the last id seen; each task keeps one page at most."""
    rest = rows if after is None else rows.filter(F.col(id_col) > after)
    return rest.orderBy(id_col).limit(page_size)


def partition_ranges(partitions: DataFrame, clamp: bool = False) -> DataFrame:
    """``split_num`` half-open ranges of equal width per partition.

    The last range may pass ``max_seq``; with ``clamp`` it ends right after it.
    """
    width = fragment_width(F.col("min_seq"), F.col("max_seq"), F.col("split_num"))
    start = F.col("min_seq") + F.col("range_no") * F.col("width")
    end = start + F.col("width")
    if clamp:
        past = F.col("max_seq") + 1
        start, end = F.least(start, past), F.least(end, past)
    return (
        partitions.filter("split_num > 0")
        .select(
            "pid",
            "min_seq",
            "max_seq",
            width.alias("width"),
            F.explode(F.sequence(F.lit(0), F.col("split_num") - 1)).alias("range_no"),
        )
        .select("pid", "range_no", start.alias("start_seq"), end.alias("end_seq"))
    )


def first_partition(partitions: DataFrame) -> DataFrame:
    """One row per pid, the least one where a catalog repeats a pid."""
    rest = [c for c in partitions.columns if c != "pid"]
    return (
        partitions.groupBy("pid")
        .agg(F.min(F.struct(*rest)).alias("p"))
        .select("pid", *[F.col("p")[c].alias(c) for c in rest])
    )


def scan_assignments(scans: DataFrame, partitions: DataFrame, scanner_id: str | None = None):
    """Scan rows with their partition, for one scanner or for all."""
    mine = scans if scanner_id is None else scans.filter(F.col("scanner_id") == scanner_id)
    return mine.join(first_partition(partitions), "pid")


def scan_assigned(
    materials: DataFrame, scans: DataFrame, scanner_id: str, status: object = 2, status_col: str = "status"
) -> DataFrame:
    """Active materials in the ranges that a scanner is assigned, with ``start_seq`` and ``end_seq``.

    ``materials`` lie in folders by ``pid``, sorted by ``material_id`` in each file. The pids of
    the scanner prune the folders at run time, its lowest and highest bound reach the file scan
    and skip row groups, and the ranges themselves are met by :func:`range_join`.
    """
    mine = cut_lineage(
        scans.filter(F.col("scanner_id") == scanner_id).select("pid", "start_seq", "end_seq").distinct(), "assigned"
    )
    low, high = mine.agg(F.min("start_seq"), F.max("end_seq")).first()
    ident = F.col("material_id")
    inside = (ident >= low) & (ident < high) if low is not None else F.lit(False)
    rows = materials.filter((F.col(status_col) == status) & inside)
    # Spark prunes at run time by a side that it deems selective: one with a comparison
    rows = rows.join(mine.filter("start_seq < end_seq").select("pid"), "pid", "left_semi")
    return range_join(rows, mine, "material_id", F.col("start_seq"), F.col("end_seq"), ["pid"])


def first_unassigned(partitions: DataFrame) -> DataFrame:
    """The unassigned partition with the least pid, if any."""
    return partitions.filter(~F.col("assigned")).orderBy("pid").limit(1)


def _level(width: Column) -> Column:
    """Least n with 2**n >= width."""
    return F.when(width <= 1, F.lit(0)).otherwise(F.length(F.bin(width - 1)))


def range_join(
    rows: DataFrame,
    ranges: DataFrame,
    id_col: str,
    low: Column,
    high: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows with every range of the same ``keys`` where ``low <= id < high``.

    A range of width w is filed under buckets of the next power of two, two at most; a
    row probes one bucket per width class in use. That makes the range test an equi-join:
    disjoint ranges give at most a few candidates per row, and nothing is compared
    with every range.
    """
    # Read three times below, so computed once.
    ranges = cut_lineage(ranges, "ranges")
    filed = (
        ranges.withColumns({"_low": low, "_high": high})
        .filter("_low < _high")
        .withColumn("_level", _level(F.col("_high") - F.col("_low")))
    )

    def shift(value: Column) -> Column:
        return F.call_function("shiftright", value, F.col("_level").cast("int"))

    filed = filed.withColumn(
        "_bucket",
        F.explode(F.array_distinct(F.array(shift(F.col("_low")), shift(F.col("_high") - 1)))),
    )
    # At most 64 width classes exist for 64-bit ids.
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    probes = rows.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in levels])))
    probes = probes.withColumn("_bucket", shift(F.col(id_col)))
    ident = F.col(id_col)
    return (
        probes.join(filed, [*keys, "_level", "_bucket"])
        .filter((ident >= F.col("_low")) & (ident < F.col("_high")))
        .drop("_level", "_bucket", "_low", "_high")
    )


def assign_ranges(rows: DataFrame, ranges: DataFrame, id_col: str, keys: Sequence[str] = ()):
    """Each row with the scan range its id falls in: ``start <= id < end``."""
    return range_join(rows, ranges, id_col, F.col("start_seq"), F.col("end_seq"), keys)


def lookup_ranges(points: DataFrame, ranges: DataFrame, point_col: str, keys: Sequence[str] = ("pid",)):
    """Each point with the range of its partition that holds it: ``start < x <= end``."""
    return range_join(
        points, ranges, point_col, F.col("start_seq") + 1, F.col("end_seq") + 1, keys
    )


def place_in_partitions(
    rows: DataFrame, partitions: DataFrame, id_col: str, closed_right: bool = False, clamp: bool = False
) -> DataFrame:
    """Each row with its range among those of :func:`partition_ranges`, by arithmetic.

    These ranges have one width per partition, so a row needs its partition and a division,
    no range test. Ranges are ``[s, e)``, or ``(s, e]`` with ``closed_right``; ``clamp`` as
    there. Ranges of any other kind go through :func:`range_join`.
    """
    width = fragment_width(F.col("min_seq"), F.col("max_seq"), F.col("split_num"))
    planned = first_partition(partitions).filter("split_num > 0").select(
        "pid", "min_seq", "max_seq", "split_num", width.alias("width")
    )
    shift = 1 if closed_right else 0
    past = F.col("max_seq") + 1
    start = F.col("min_seq") + F.col("range_no") * F.col("width")
    end = start + F.col("width")
    inside = (F.col(id_col) - shift >= F.col("min_seq")) & (F.col("range_no") < F.col("split_num"))
    if clamp:
        start, end = F.least(start, past), F.least(end, past)
        inside = inside & (F.col(id_col) - shift < past)
    placed = rows.join(planned, "pid").withColumn(
        "range_no", F.expr(f"CAST((`{id_col}` - {shift} - min_seq) div width AS INT)")
    )
    return placed.filter(inside).select(
        *rows.columns, "range_no", start.alias("start_seq"), end.alias("end_seq")
    )


def split_ranges(
    ranges: DataFrame, cuts: DataFrame, bucket_rows: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Ranges ``[s,e)`` of (pid, start_seq, end_seq) cut at the points (pid, x) strictly inside."""
    inside = range_join(
        cuts.select("pid", "x").distinct(),
        ranges.select("pid", "start_seq", "end_seq"),
        "x",
        F.col("start_seq") + 1,
        F.col("end_seq"),
        ["pid"],
    )
    whole = ranges.select("pid", F.col("start_seq").alias("x"), "start_seq", "end_seq")
    bounds = inside.select("pid", "x", "start_seq", "end_seq").unionByName(whole)
    bounds = _ordered_buckets(
        cut_lineage(bounds, "bounds"), ["pid", "start_seq", "end_seq", "x"], bucket_rows
    )
    owner = ["pid", "start_seq", "end_seq"]
    firsts = bounds.groupBy(*owner, "_bucket").agg(F.min("x").alias("_first"))
    later = firsts.select(
        *owner,
        "_bucket",
        F.lead("_first").over(Window.partitionBy(*owner).orderBy("_bucket")).alias("_later"),
    )
    near = F.lead("x").over(Window.partitionBy(*owner, "_bucket").orderBy("x"))
    return (
        bounds.withColumn("_near", near)
        .join(later, [*owner, "_bucket"])
        .select(
            "pid",
            F.col("x").alias("start_seq"),
            F.coalesce("_near", "_later", "end_seq").alias("end_seq"),
        )
    )
