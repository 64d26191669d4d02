"""Request quotas: usage counts, first-n admission per bucket, two-stage verdicts.

Requests carry a unique ``request_id``, an instant ``ts`` and a ``domain``. One domain
may send a third of all requests, so nothing here sorts a whole domain in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.keys import bucket_start

# Default caps per domain and second, and per domain and day.
SECOND_CAP = 10
DAY_CAP = 200

# Verdicts.
ADMITTED = "200"
BUCKET_FULL = "max parallel num reached"
DAY_FULL = "max service num reached"

_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their rank ``rn``.

    Up to the planner's group-limit threshold each map task keeps ``n`` rows per group
    before the shuffle. Above it the same is done by hand with a salt.
    """
    threshold = int(rows.sparkSession.conf.get(_LIMIT_CONF, "1000"))
    if n > threshold:
        salt = F.pmod(F.xxhash64(*order), F.lit(1024))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", salt)
            .withColumn("_part_rn", F.row_number().over(part))
            .filter(F.col("_part_rn") <= n)
            .drop("_salt", "_part_rn")
        )
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rn") <= n)


def bucket_admission(
    requests: DataFrame, cap: int = SECOND_CAP, width: str = "second"
) -> DataFrame:
    """The requests that pass the bucket cap: the first ``cap`` per domain and bucket."""
    slim = requests.select(
        "request_id", "ts", "domain", bucket_start(F.col("ts"), width).alias("bucket")
    )
    return first_n(slim, ["domain", "bucket"], ["ts", "request_id"], cap)


def admit(
    requests: DataFrame,
    bucket_cap: int = SECOND_CAP,
    day_cap: int = DAY_CAP,
    width: str = "second",
) -> DataFrame:
    """A verdict for every request.

    A bucket rejection uses no daily slot; a daily rejection has already used its
    bucket slot. Both stages keep the first n of a group before its rows meet: who passes
    the bucket cap and is not among the day's first is refused for the day, unranked. The
    verdicts return to the full rows by request id, a key without skew.
    """
    passed = bucket_admission(requests, bucket_cap, width).withColumn("day", F.to_date("ts"))
    slim = passed.select("request_id", "ts", "domain", "day")
    admitted = first_n(slim, ["domain", "day"], ["ts", "request_id"], day_cap)
    verdicts = passed.select("request_id").join(
        admitted.select("request_id", F.lit(ADMITTED).alias("admitted")), "request_id", "left"
    )
    verdicts = verdicts.select("request_id", F.coalesce("admitted", F.lit(DAY_FULL)).alias("verdict"))
    return requests.join(verdicts, "request_id", "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(BUCKET_FULL))
    )


def usage(requests: DataFrame, width: str = "second") -> DataFrame:
    """Requests per (bucket, domain); counted before the shuffle, so a busy domain is cheap."""
    return requests.groupBy(
        bucket_start(F.col("ts"), width).alias("bucket"), "domain"
    ).agg(F.count("*").alias("requests"))
