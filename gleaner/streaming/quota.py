"""Quotas over a stream of requests (request_id, ts, domain)."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleaner.functions.keys import bucket_start
from gleaner.operators import quota

#: Verdict on a request that came after the watermark had passed it.
LATE = "late"
#: Parts over which bundles of refused requests of one domain and day pass the second stage.
SPREAD = 1024
#: Refused requests that pass the second stage as one row.
BUNDLE = 256


def window_usage(requests: DataFrame, width: str = "second", delay: str = "1 day") -> DataFrame:
    """Requests so far per (bucket, domain), in windows of one ``width``.

    Each batch gives the windows it touched with their new totals (update mode). A window is
    forgotten when the watermark has passed its end; requests for it are not counted any more,
    see :func:`late_usage`. Windows start at whole units of UTC.
    """
    rows = requests.withWatermark("ts", delay)
    counted = rows.groupBy(F.window("ts", f"1 {width}").alias("w"), "domain").agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("bucket"), "domain", "requests")


def latest_totals(updates: DataFrame) -> DataFrame:
    """The newest total of each (bucket, domain) among the updates of all batches."""
    last = updates.groupBy("bucket", "domain").agg(F.max(F.struct("batch_id", "requests")).alias("u"))
    return last.select("bucket", "domain", F.col("u.requests").alias("requests"))


def late_usage(requests: DataFrame, totals: DataFrame, width: str = "second") -> DataFrame:
    """Requests of ``requests`` per (bucket, domain) that the stream came too late to count."""
    all_of = quota.usage(requests, width).withColumnRenamed("requests", "sent")
    joined = all_of.join(totals, ["bucket", "domain"], "left")
    late = F.col("sent") - F.coalesce("requests", F.lit(0))
    return joined.select("bucket", "domain", late.alias("requests")).filter("requests > 0")


def _slots(cap: int, fields: list[str], passed: str | None, refused: str, bundles: bool = False) -> StatefulProcessor:
    """Counts the slots taken of a key ``(domain, ends)`` and forgets them after ``ends``.

    The first rows by (ts, request_id) of a batch take what is left. No more than ``cap`` rows
    are held; a row that finds no place leaves at once. ``passed`` and ``refused`` are the
    verdicts; rows that pass without one keep NULL. With ``bundles`` the refused rows leave
    BUNDLE at a time, a list a field in the column ``refused``. A third part of the key, where
    there is one, is -1 but for bundles, which go through.
    """

    size = BUNDLE

    # Defined here so that it ships by value: workers need no copy of this package.
    class Slots(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.handle = handle
            self.used = handle.getValueState("used", "n int")

        def row(self, source, verdict, **more):  # noqa: ANN001, ANN003, ANN202
            return Row(**{f: source[f] for f in fields}, verdict=verdict, **more)

        def bundle(self, rows):  # noqa: ANN001, ANN202
            lists = {f"f{k}": [r[f] for r in rows] for k, f in enumerate(fields)}
            return self.row(rows[-1], refused, refused=lists)

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201
            if len(key) > 2 and key[2] >= 0:
                for row in rows:
                    yield self.row(row, row.verdict, refused=row.refused)
                return
            more = {"refused": None} if bundles or len(key) > 2 else {}
            known = self.used.get()
            free = cap - (known[0] if known else 0)
            held: list = []
            out: list = []
            for n, row in enumerate(rows):
                insort(held, (row.ts, row.request_id, n, row))
                if len(held) > free:
                    last = held.pop()[3]
                    if not bundles:
                        yield self.row(last, refused, **more)
                        continue
                    out.append(last)
                    if len(out) == size:
                        yield self.bundle(out)
                        out = []
            if out:
                yield self.bundle(out)
            for *_, row in held:
                yield self.row(row, passed, **more)
            if known is None:
                self.handle.registerTimer(key[1])
            self.used.update((cap - free + len(held),))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201
            self.used.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Slots()


def _ends(width: str) -> Column:
    return F.unix_millis(bucket_start(F.col("ts"), width) + F.expr(f"interval 1 {width}"))


def admission_stream(
    requests: DataFrame,
    bucket_cap: int = quota.SECOND_CAP,
    day_cap: int = quota.DAY_CAP,
    width: str = "second",
    delay: str = "1 day",
) -> DataFrame:
    """Stream form of :func:`gleaner.operators.quota.admit`: requests with their verdict.

    Slots are the engine's keyed state, a number per (domain, bucket) and per (domain, day);
    inside a batch the first requests take them, later batches what is left. A timer clears a
    slot when the watermark, ``delay`` behind the newest request, has passed its bucket or day.
    Requests behind the watermark get no row here, see :func:`late_requests`. A domain's
    requests meet in one task for one bucket only; of each bucket ``bucket_cap`` at most go on to
    the domain's day, and the refused ones pass in bundles,
    in ``SPREAD`` parts.
    """
    fields = requests.columns
    verdict = StructField("verdict", StringType())
    lists = StructType([StructField(f"f{k}", ArrayType(f.dataType)) for k, f in enumerate(requests.schema.fields)])
    schema = StructType([*requests.schema.fields, verdict, StructField("refused", lists)])
    rows = requests.withWatermark("ts", delay).withColumn("ends", _ends(width))
    first = rows.groupBy("domain", "ends").transformWithState(
        _slots(bucket_cap, fields, None, quota.BUCKET_FULL, True), schema, "append", "EventTime", eventTimeColumnName="ts"
    )
    bundled = F.col("refused").isNotNull()
    rows = first.withColumns(
        {"ends": _ends("day"), "part": F.when(bundled, F.pmod(F.xxhash64("request_id"), F.lit(SPREAD))).otherwise(-1).cast("int")}
    )
    second = rows.groupBy("domain", "ends", "part").transformWithState(
        _slots(day_cap, fields, quota.ADMITTED, quota.DAY_FULL), schema, "append", "EventTime"
    )
    one = F.array(F.struct(*[F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(fields)]))
    many = F.arrays_zip(*[F.col(f"refused.f{k}") for k in range(len(fields))])
    opened = second.select("verdict", F.explode(F.when(bundled, many).otherwise(one)).alias("row"))
    return opened.select(*[F.col(f"row.f{k}").alias(f) for k, f in enumerate(fields)], "verdict")


def late_requests(requests: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Requests that the stream read and gave no verdict: they came behind the watermark."""
    return requests.join(verdicts.select("request_id"), "request_id", "left_anti").withColumn("verdict", F.lit(LATE))
