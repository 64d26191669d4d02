import os
import random
from datetime import datetime, timedelta

import pytest

from gleaner.operators import quota
from gleaner.session import run_dir
from gleaner.streaming import quota as quota_stream
from gleaner.streaming.queries import append_rows, read_output, update_rows

START = datetime(2024, 1, 1)
SCHEMA = "request_id long, ts timestamp, domain string"


def log(count, seed=5):
    """Requests over three days; one domain sends most of them, many within one minute."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        hot = rng.random() < 0.6
        minute = 7 if hot and rng.random() < 0.5 else rng.randrange(3 * 1440)
        rows.append((i, START + timedelta(minutes=minute, seconds=rng.randrange(60)),
                     "hot" if hot else rng.choice("abc")))
    return rows


def simulate(rows, bucket_cap, day_cap):
    """One request after the other, as a gate would see them."""
    buckets, days, out = {}, {}, {}
    for ident, ts, domain in rows:
        bucket, day = (domain, ts.replace(second=0)), (domain, ts.date())
        if buckets.get(bucket, 0) >= bucket_cap:
            out[ident] = quota.BUCKET_FULL
            continue
        buckets[bucket] = buckets.get(bucket, 0) + 1
        if days.get(day, 0) >= day_cap:
            out[ident] = quota.DAY_FULL
            continue
        days[day] = days.get(day, 0) + 1
        out[ident] = quota.ADMITTED
    return out


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_verdicts_equal_a_sequential_gate(spark, threshold):
    rows = log(1500)
    want = simulate(sorted(rows, key=lambda r: (r[1], r[0])), 4, 60)
    assert set(want.values()) == {quota.ADMITTED, quota.BUCKET_FULL, quota.DAY_FULL}
    conf = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, threshold)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r.request_id: r.verdict for r in quota.admit(df, 4, 60, "minute").collect()}
    finally:
        spark.conf.set(conf, before)
    assert got == want


def test_rows_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(log(50), SCHEMA)
    plan = quota.bucket_admission(df, 3, "minute")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _stream(spark, rows_per_run, base, *caps, source=None, **options):
    source = source or run_dir(spark, "requests")
    queries = []
    for rows in rows_per_run:
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        queries.append(append_rows(quota_stream.admission_stream(stream, *caps, **options), base))
        queries[-1].awaitTermination()
    return {r.request_id: r.verdict for r in read_output(spark, base).collect()}, queries


def test_stream_keeps_counts_between_runs_in_any_order(spark):
    rows = log(900)
    random.Random(1).shuffle(rows)
    # Later runs hold instants before those of earlier runs; slots go by arrival.
    runs = [sorted(rows[k::3], key=lambda r: (r[1], r[0])) for k in range(3)]
    want = simulate([r for run in runs for r in run], 4, 60)
    got, _ = _stream(spark, runs, run_dir(spark, "quota"), 4, 60, "minute", delay="30 days")
    assert got == want


def test_stream_state_is_forgotten_and_late_requests_are_told(spark):
    day = timedelta(days=1)
    runs = [
        [(k, START + timedelta(seconds=k), "abc"[k % 3]) for k in range(60)] + [(100, START + 5 * day, "a")],
        [(101, START + 2 * day, "a"), (102, START + 5 * day, "a"), (103, START + 9 * day, "b")],
        [],
    ]
    source, base = run_dir(spark, "requests"), run_dir(spark, "quota")
    got, queries = _stream(spark, runs, base, 10, 1, "second", delay="1 day", source=source)
    assert 101 not in got and got[100] == quota.ADMITTED and got[102] == quota.DAY_FULL
    late = quota_stream.late_requests(spark.read.parquet(source), read_output(spark, base))
    assert [(r.request_id, r.verdict) for r in late.collect()] == [(101, quota_stream.LATE)]
    # days before the watermark hold no slot any more
    sizes = [max((o.numRowsTotal for p in q.recentProgress for o in p.stateOperators), default=0) for q in queries]
    left = [q.recentProgress[-1].stateOperators for q in queries if q.recentProgress]
    assert sizes[0] >= 60 and all(o.numRowsTotal <= 6 for o in left[-1])


def test_a_batch_that_runs_again_changes_nothing(spark):
    rows = log(200)
    source, base = run_dir(spark, "requests"), run_dir(spark, "quota")
    _stream(spark, [rows], base, 4, 60, "minute", source=source, delay="30 days")
    # the last entry is lost, as after a loss between output and commit
    last = max(int(f) for f in os.listdir(f"{base}/checkpoint/commits") if f.isdigit())
    os.rename(f"{base}/checkpoint/commits/{last}", f"{base}/lost-commit")
    crc = f"{base}/checkpoint/commits/.{last}.crc"
    if os.path.exists(crc):
        os.rename(crc, f"{base}/lost-commit.crc")
    got, _ = _stream(spark, [[]], base, 4, 60, "minute", source=source, delay="30 days")
    assert got == simulate(sorted(rows, key=lambda r: (r[1], r[0])), 4, 60)
    assert read_output(spark, base).count() == len(rows)


def test_windows_count_in_time_and_late_usage_the_rest(spark):
    day = timedelta(days=1)
    runs = [[(1, START, "a"), (2, START + day, "a")], [(3, START + timedelta(minutes=5), "a"), (4, START + day, "a"), (5, START + 3 * day, "b")]]
    source, base = run_dir(spark, "requests"), run_dir(spark, "usage")
    for rows in runs:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        update_rows(quota_stream.window_usage(stream, "hour", "1 hour"), base).awaitTermination()
    totals = quota_stream.latest_totals(read_output(spark, base))
    assert {(r.bucket, r.domain): r.requests for r in totals.collect()} == {
        (START, "a"): 1, (START + day, "a"): 2, (START + 3 * day, "b"): 1,
    }
    late = quota_stream.late_usage(spark.read.parquet(source), totals, "hour")
    assert [tuple(r) for r in late.collect()] == [(START, "a", 1)]


def test_both_stages_are_cut_before_the_shuffle(spark):
    plan = quota.admit(spark.createDataFrame(log(50), SCHEMA), 3, 5, "minute")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 4


def test_refused_requests_pass_the_second_stage_in_bundles(spark, monkeypatch):
    monkeypatch.setattr(quota_stream, "BUNDLE", 7)
    rows = [(k, START + timedelta(seconds=k), "ab"[k % 10 == 0]) for k in range(400)] + [(900, START, None), (901, START, None)]
    base = run_dir(spark, "quota")
    got, queries = _stream(spark, [rows], base, 3, 5, "minute", delay="30 days")
    assert got == simulate([r for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2]], 3, 5) | {900: quota.ADMITTED, 901: quota.ADMITTED}
    assert read_output(spark, base).count() == len(rows)
    assert read_output(spark, base).columns == ["request_id", "ts", "domain", "verdict"]
