"""Streams of tasks and children: suppression of repeats, completeness of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

RUN_SCHEMA = "seqno string, expected long, arrived long, complete boolean"


def suppress_repeats(tasks: DataFrame, key: str = "url", delay: str = "1 hour") -> DataFrame:
    """Drop a task whose key was seen within the delay."""
    return tasks.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def _open_runs(timeout_ms: int) -> StatefulProcessor:
    # Defined here so that it ships by value: workers need no copy of this package.
    class OpenRuns(StatefulProcessor):
        def init(self, handle) -> None:  # noqa: ANN001
            self.handle = handle
            self.run = handle.getValueState("run", "expected long, arrived long, done boolean")
            self.urls = handle.getMapState("urls", "url string", "seen boolean")

        def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201
            known = self.run.get()
            expected, arrived, done = known or (None, 0, False)
            if known is None:
                since = None
            for row in rows:
                if known is None:
                    since = row.ts if since is None else min(since, row.ts)
                if row.expected is not None:
                    expected = row.expected if expected is None else max(expected, row.expected)
                if row.url is not None and not done and not self.urls.containsKey((row.url,)):
                    self.urls.updateValue((row.url,), (True,))
                    arrived += 1
            if known is None:
                self.handle.registerTimer(int(since.timestamp() * 1000) + timeout_ms)
            complete = not done and expected is not None and arrived >= expected
            if complete:
                self.urls.clear()
                yield Row(seqno=key[0], expected=expected, arrived=arrived, complete=True)
            self.run.update((expected, arrived, done or complete))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201
            expected, arrived, done = self.run.get() or (None, 0, True)
            self.urls.clear()
            if done:
                self.run.clear()
                return
            # what arrives late belongs to a run that was given up: remembered as long again
            self.run.update((expected, arrived, True))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + timeout_ms)
            yield Row(seqno=key[0], expected=expected, arrived=arrived, complete=False)

        def close(self) -> None:
            pass

    return OpenRuns()


def run_gate(arrivals: DataFrame, timeout_hours: float = 24, delay: str = "1 hour") -> DataFrame:
    """Hold runs until all their children have arrived, then report them once.

    ``arrivals`` is a stream of (seqno, url, expected, ts): a parent names ``expected`` and no
    url, a child names its url. One row per run: ``complete``, or given up when the watermark
    (``delay`` behind the newest row) passes its first row by the timeout. State has one entry
    per child of an open run and one row per run, and both go: those of a complete run with its
    timeout, those of one given up after twice that time.
    """
    rows = arrivals.select("seqno", "url", "expected", "ts").withWatermark("ts", delay)
    return rows.groupBy("seqno").transformWithState(
        _open_runs(int(timeout_hours * 3_600_000)), RUN_SCHEMA, "append", "EventTime"
    )
