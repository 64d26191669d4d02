import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import scan
from gleaner.sources.catalog import range_predicates


def test_range_width_examples(spark):
    catalog = spark.createDataFrame(
        [("a", 10000, 19999, 3), ("b", 0, 9, 4)], "pid string, min_seq long, max_seq long, split_num int"
    )
    got = scan.partition_ranges(catalog).orderBy("pid", "range_no").collect()
    assert [(r.pid, r.start_seq, r.end_seq) for r in got] == [
        ("a", 10000, 13334), ("a", 13334, 16668), ("a", 16668, 20002),
        ("b", 0, 3), ("b", 3, 6), ("b", 6, 9), ("b", 9, 12),
    ]
    clamped = scan.partition_ranges(catalog, clamp=True).groupBy("pid").agg(F.max("end_seq")).collect()
    assert dict(map(tuple, clamped)) == {"a": 20000, "b": 10}


def test_ranges_cover_and_are_disjoint(spark):
    rng = random.Random(7)
    rows = [(str(i), lo := rng.randrange(10**6), lo + rng.randrange(5000), rng.randrange(1, 9))
            for i in range(40)]
    catalog = spark.createDataFrame(rows, "pid string, min_seq long, max_seq long, split_num int")
    found = {}
    for r in scan.partition_ranges(catalog).collect():
        found.setdefault(r.pid, []).append((r.start_seq, r.end_seq))
    for pid, low, high, _ in rows:
        parts = sorted(found[pid])
        assert parts[0][0] == low and parts[-1][1] > high
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_range_join_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    ranges, ids = [], []
    for pid in ("hot", "x", "y"):
        low = -50
        for _ in range(60):
            width = rng.choice([1, 2, 3, 17, 1000, 40000])
            ranges.append((pid, low, low + width))
            low += width + rng.choice([0, 0, 5])
        ids += [(pid, rng.randrange(-100, low + 100)) for _ in range(400)]
    ids = list(set(ids))
    want = sorted(
        (p, i, s) for p, i in ids for q, s, e in ranges if p == q and s <= i < e
    )
    rows = spark.createDataFrame(ids, "pid string, id long")
    table = spark.createDataFrame(ranges, "pid string, start_seq long, end_seq long")
    for bound in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
        got = scan.assign_ranges(rows, table, "id", ["pid"]).select("pid", "id", "start_seq")
        assert sorted(map(tuple, got.collect())) == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = scan.lookup_ranges(rows, table, "id").select("pid", "id", "start_seq").collect()
    assert sorted(map(tuple, found)) == sorted(
        (p, i, s) for p, i in ids for q, s, e in ranges if p == q and s < i <= e
    )


def test_split_keeps_the_covered_length(spark):
    ranges = spark.createDataFrame(
        [("a", 0, 100), ("a", 100, 130), ("b", 5, 9)], "pid string, start_seq long, end_seq long"
    )
    cuts = spark.createDataFrame(
        [("a", 0), ("a", 10), ("a", 10), ("a", 64), ("a", 99), ("a", 100), ("a", 200), ("b", 7), ("c", 1)],
        "pid string, x long",
    )
    for rows in (2, 1000):
        got = sorted((r.pid, r.start_seq, r.end_seq) for r in scan.split_ranges(ranges, cuts, rows).collect())
        assert got == [("a", 0, 10), ("a", 10, 64), ("a", 64, 99), ("a", 99, 100), ("a", 100, 130),
                       ("b", 5, 7), ("b", 7, 9)]


def test_pages_of_a_scan(spark):
    ids = sorted(random.Random(1).sample(range(10_000), 537))
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r.id: r.page_no for r in scan.number_pages(rows, 50, "id", bucket_rows=64).collect()}
    assert got == {i: k // 50 for k, i in enumerate(ids)}
    page = scan.page_after(rows, 50, "id", after=ids[99]).collect()
    assert [r.id for r in page] == ids[100:150]


def test_scan_filter_reaches_the_file(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.range(100).select(F.col("id").alias("material_id"), (F.col("id") % 3).alias("status")).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    found = scan.scan_range(spark.read.parquet(path), 10, 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(material_id,10)" in plan and "LessThan(material_id,20)" in plan
    assert sorted(r.material_id for r in found.collect()) == [11, 14, 17]


def test_assignments(spark):
    parts = spark.createDataFrame(
        [("p", 9, 0, "t", True, 2, 1), ("p", 19, 0, "t", True, 2, 1), ("q", 5, 1, "t", False, 1, 1)],
        "pid string, max_seq long, min_seq long, table_name string, assigned boolean, split_num int, phase int",
    )
    scans = spark.createDataFrame(
        [(0, 5, 600, "s1", "p"), (5, 10, 600, "s2", "p"), (1, 6, 600, "s1", "q")],
        "start_seq long, end_seq long, interval_secs int, scanner_id string, pid string",
    )
    mine = scan.scan_assignments(scans, parts, "s1").collect()
    assert sorted((r.pid, r.max_seq) for r in mine) == [("p", 9), ("q", 5)]
    assert [r.pid for r in scan.first_unassigned(parts).collect()] == ["q"]


def test_jdbc_predicates():
    assert range_predicates([(1, 5), (5, 9)]) == [
        "materialId >= 1 AND materialId < 5", "materialId >= 5 AND materialId < 9",
    ]
    with pytest.raises(ValueError, match="overlap"):
        range_predicates([(1, 6), (5, 9)])


def test_arithmetic_agrees_with_the_range_join(spark):
    rng = random.Random(12)
    parts = [(f"p{k}", rng.randrange(-50, 50), rng.randrange(1, 6)) for k in range(12)]
    parts = [(p, low, low + rng.randrange(0, 40), n) for p, low, n in parts]
    table = spark.createDataFrame(parts, "pid string, min_seq long, max_seq long, split_num int")
    ids = [(p, i) for p, low, high, _ in parts for i in range(low - 3, high + 4)]
    rows = spark.createDataFrame(ids, "pid string, id long")
    for closed, clamp in ((False, False), (True, True), (True, False), (False, True)):
        ranges = scan.partition_ranges(table, clamp=clamp)
        join = scan.lookup_ranges if closed else scan.assign_ranges
        want = join(rows, ranges, "id", ["pid"]).select("pid", "id", "range_no", "start_seq", "end_seq").collect()
        got = scan.place_in_partitions(rows, table, "id", closed, clamp)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
