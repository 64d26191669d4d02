"""Keys, tags and envelopes derived from ids and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the period part of result table names.
DEFAULT_PERIOD = "y20s1"


def seqno(material_id: Column, fetched_at: Column) -> Column:
    """Run key: material id followed by the fetch instant to the second."""
    return F.concat(material_id.cast("string"), F.date_format(fetched_at, "yyyyMMddHHmmss"))


def write_time(fetched_at: Column) -> Column:
    return F.date_format(fetched_at, "yyyy-MM-dd HH:mm:ss")


def half_year_period(at: Column) -> Column:
    """Period tag by calendar half-year, for callers that want it to follow the clock."""
    half = F.when(F.month(at) <= 6, F.lit("1")).otherwise(F.lit("2"))
    return F.concat(F.lit("y"), F.date_format(at, "yy"), F.lit("s"), half)


def bucket_start(at: Column, width: str) -> Column:
    """Start of the bucket an instant falls in; ``width`` is ``second``, ``hour``, ``day``..."""
    return F.date_trunc(width, at)


def envelope(charset: Column, url: Column, value: Column) -> Column:
    """Result document: charset, url and the extracted value, as JSON."""
    return F.to_json(F.struct(charset.alias("charset"), url.alias("url"), value.alias("value")))


def fragment_width(lowest: Column, highest: Column, parts: Column) -> Column:
    """Width of each of ``parts`` equal ranges that together cover both ends."""
    return F.ceil((highest - lowest + 1) / parts).cast("long")


def seconds_after(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds)
