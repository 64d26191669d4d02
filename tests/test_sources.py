import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner.operators import assemble, definitions, scan
from gleaner.operators.extract import match_selectors, prepare_pages
from gleaner.session import run_dir, shared_dir
from gleaner.sources import catalog, landing, records, results
from gleaner.streaming import gate
from gleaner.streaming.queries import append_rows, read_output


def drop_task(folder, seqno, text=None):
    task = {"pid": "p", "materialId": 1, "type": 3, "url": "http://a.com/", "seqno": seqno, "charset": "gbk"}
    with open(f"{folder}/{seqno}.ini", "w") as out:
        out.write((json.dumps(task) if text is None else text) + "\nsecond line\n")


def test_landing_folder_with_orphan_and_bad_task(spark, tmp_path):
    work, bodies = tmp_path / "work", tmp_path / "html"
    work.mkdir(), bodies.mkdir()
    for seqno in ("s1", "s2"):
        drop_task(work, seqno)
    drop_task(work, "bad", "{not json")
    (work / "notes.txt").write_text("{}")
    (bodies / "s1").write_bytes("中".encode("gbk"))
    decoded = landing.read_sidecars(spark, str(work))
    tasks = records.good_records(decoded)
    found = landing.read_bodies(spark, str(bodies))
    html = landing.decoded(landing.join_bodies(tasks, found)).collect()
    assert [(r.seqno, r.html, r.type) for r in html] == [("s1", "中", 3)]
    assert [r.seqno for r in landing.orphans(tasks, found).collect()] == ["s2"]
    assert [r.corrupt for r in records.quarantine(decoded).collect()] == ["{not json"]


def test_landing_stream_reads_each_task_once_and_archives(spark, tmp_path):
    work, done = tmp_path / "work", tmp_path / "done"
    work.mkdir()
    out = run_dir(spark, "seen")

    def poll():
        stream = landing.read_sidecars(spark, str(work), stream=True, archive_to=str(done))
        (
            records.good_records(stream).select("seqno").writeStream.format("parquet")
            .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log")
            .trigger(availableNow=True).start().awaitTermination()
        )

    for seqno in ("s1", "s2", "s3"):
        drop_task(work, seqno)
        poll()
    assert sorted(r.seqno for r in spark.read.parquet(f"{out}/rows").collect()) == ["s1", "s2", "s3"]
    assert os.path.exists(work / "s3.ini")  # the newest waits for a later batch


def test_many_files_of_a_batch_are_listed_by_few_tasks(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    cores = spark.sparkContext.defaultParallelism
    for n in range(8 * cores):
        drop_task(work, f"s{n}")
    stream = records.good_records(landing.read_sidecars(spark, str(work), stream=True)).select("seqno")
    query = append_rows(stream, str(tmp_path / "out"))
    query.awaitTermination()
    assert read_output(spark, str(tmp_path / "out")).distinct().count() == 8 * cores
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).get().stageIds()}
    found = [i.get().numTasks() for i in map(tracker.getStageInfo, stages) if i.isDefined() and "Listing" in i.get().name()]
    assert max([0, *found]) <= 4 * cores and spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == str(4 * cores)


def test_unsupported_selector_fails_loudly(spark):
    bad = '{"addr":"http://a.com","type":3,"selectors":[{"xpath":"//a[2]"}]}'
    flat = definitions.flatten(spark.createDataFrame([(1, bad)], "material_id long, definition string"))
    assert flat.filter(~definitions.is_supported()).count() == 1
    with pytest.raises(PySparkException, match="unsupported selector: //a"):
        definitions.require_supported(flat).collect()


def test_nested_definition(spark):
    inner = {"selectors": [{"xpath": "//p"}], "level": 3, "wrap": 1}
    middle = {"selectors": [{"xpath": "//h1", "extract": 1}], "child": inner}
    outer = {"addr": "http://a.com", "type": 1, "child": middle, "pagination": {
        "limit": 3, "interim": 1, "mode": 1, "selector": {"xpath": "//a[@class='next']"}},
        "selectors": [{"xpath": "//li", "subselectors": [{"xpath": "./b"}]}, {"xpath": "//a"}]}
    rows = spark.createDataFrame([(7, json.dumps(outer))], "material_id long, definition string")
    got = definitions.flatten(rows).orderBy("phase", "selector_no").collect()
    assert [(r.phase, r.selector_no, r.xpath, r.extract, r.level, r.wrap) for r in got] == [
        (1, 1, "//li", 0, 1, 0), (1, 2, "//a", 0, 1, 0), (2, 1, "//h1", 1, 2, 0), (3, 1, "//p", 0, 3, 1),
    ]
    assert got[0].page_limit == 3 and got[0].next_xpath == "//a[@class='next']"
    assert got[0].sub_steps[0][0].tag == "b" and got[0].item_limit == -1


def test_any_depth_and_rejects(spark):
    body = {"selectors": [{"xpath": "//p"}]}
    for _ in range(7):
        body = {"selectors": [{"xpath": "//h1"}], "child": body}
    bad = {"selectors": [{"xpath": "//a[2]"}, {"xpath": "//a", "subselectors": [{"xpath": "b"}]},
                         {"xpath": "./img", "linkselector": {"xpath": "a()"}}]}
    rows = [(1, json.dumps(body)), (2, json.dumps(bad)), (3, '{"addr":'), (4, None), (5, "[1]"), (6, '{"type":3}')]
    materials = spark.createDataFrame(rows, "material_id long, definition string")
    flat = definitions.flatten(materials).filter(definitions.is_supported()).collect()
    assert sorted((r.material_id, r.phase) for r in flat) == [(1, n) for n in range(1, 9)]
    found = sorted((r.material_id, r.phase, r.reason, r.text) for r in definitions.rejects(materials).collect() if r.text)
    assert found == [
        (2, 1, "unsupported selector", "//a[2]"), (2, 1, "unsupported selector", "a()"), (2, 1, "unsupported selector", "b"),
        (3, 0, "not a definition", '{"addr":'), (5, 0, "not a definition", "[1]"),
    ]
    assert {r.material_id for r in definitions.rejects(materials).collect()} == {2, 3, 4, 5, 6}


def test_every_level_gives_a_selector_or_a_reject(spark):
    rows = [
        (1, '{"type":3,"selectors":[]}'), (2, '{"selectors":[{"xpath":"//p"}],"child":{"selectors":"text"}}'),
        (3, '{"limit":"abc","type":"3","selectors":[{"xpath":"//p"},{"xpath":["x"]},7]}'), (4, '{"type":4}'),
        (5, '{"type":5}'), (6, '{"type":4,"yaxisXpath":"a()"}'), (7, '{"child":7,"selectors":[{"xpath":"//p"}]}'),
        (8, json.dumps({"selectors": [{"xpath": "//p"}], "note": '"child":' * 1000})),
    ]
    materials = spark.createDataFrame(rows, "material_id long, definition string")
    used = {(r.material_id, r.phase, r.xpath) for r in definitions.flatten(materials).filter(definitions.is_supported()).collect()}
    assert used == {(2, 1, "//p"), (3, 1, "//p"), (7, 1, "//p"), (8, 1, "//p")}
    found = {(r.material_id, r.phase, r.reason, r.text) for r in definitions.rejects(materials).collect()}
    assert found == {
        (1, 1, "no selector", None), (2, 2, "bad field", "$.selectors"), (2, 2, "no selector", None), (3, 1, "bad field", "$.limit"),
        (3, 1, "bad field", "$.selectors[1].xpath"), (3, 1, "unsupported selector", '["x"]'), (3, 1, "unsupported selector", ""),
        (4, 1, "no axis", None), (6, 1, "unsupported selector", "a()"), (7, 1, "bad field", "$.child"),
    }


def test_every_body_is_decoded_once(spark):
    rows = [
        (1, None, "é".encode()), (2, "utf-8", "é".encode()), (3, "GBK", "中文".encode("gbk")), (4, "no such", b"x"),
        (5, "UTF-16LE", "é".encode("utf-16-le")), (6, "utf-8", b"\xff"), (7, "latin1", "é".encode("latin-1")), (8, "utf-8", None),
    ]
    decoded = landing.decoded(spark.createDataFrame(rows, "id int, charset string, body binary"))
    assert {r.id: r.html for r in decoded.collect()} == {
        1: "é", 2: "é", 3: "中文", 4: None, 5: "é", 6: None, 7: "é", 8: None,
    }
    plan = decoded._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan


def test_table_driven_pages_are_read_once(spark):
    """Selectors of a material meet its page in one row; markup is not repeated for each."""
    pages = spark.createDataFrame([(1, "http://a.com/", "<p>a<p>b<h1>c</h1>")], "material_id long, url string, html string")
    body = {"addr": "http://a.com/", "type": 3, "selectors": [{"xpath": "//p"}, {"xpath": "//h1"}, {"xpath": "//p"}]}
    flat = definitions.flatten(spark.createDataFrame([(1, json.dumps(body))], "material_id long, definition string"))
    matched = match_selectors(prepare_pages(pages), flat.drop("addr"))
    assert sorted((r.selector_no, len(r.elements)) for r in matched.collect()) == [(1, 2), (2, 1), (3, 2)]


def test_results_skip_empty_pages(spark):
    rows = spark.createDataFrame(
        [(1, "s1", "utf-8", "u", "p", ["é"]), (2, "s2", "utf-8", "u", "p", [])],
        "material_id long, seqno string, charset string, url string, pid string, value array<string>",
    )
    at = F.to_timestamp(F.lit("2024-02-03 04:05:06"))
    path = run_dir(spark, "res")
    results.write_results(results.result_rows(rows, at), path)
    row = spark.read.parquet(path).collect()
    assert len(row) == 1 and row[0].contents == '{"charset":"utf-8","url":"u","value":["é"]}'
    assert row[0].period == "y20s1" and str(row[0].insert_day) == "2024-02-03"


class FakeSession:
    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_folder_comes_from_the_session():
    named = FakeSession(spark_checkpoint_dir="hdfs://shared/x/", spark_master="yarn")
    assert run_dir(named, "y").startswith("hdfs://shared/x/y-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(spark_master="yarn"))
    local = FakeSession(spark_master="local[2]")
    assert os.path.isdir(shared_dir(local)) and shared_dir(local) == shared_dir(local)


def test_gate_waits_then_reports_once_or_gives_up(spark):
    start = datetime(2024, 1, 1)
    hour = timedelta(hours=1)
    schema = "seqno string, url string, expected long, ts timestamp"
    runs = [
        [("a", None, 2, start), ("a", "u1", None, start), ("b", None, 1, start), ("z", None, 0, start)],
        [("a", "u1", None, start + hour), ("c", "early", None, start + hour)],
        [("a", "u2", None, start + 2 * hour), ("c", None, 1, start + 2 * hour)],
        [("a", "u2", None, start + 9 * hour)],
        [("b", "late", None, start + 10 * hour), ("d", None, 0, start + 30 * hour)],
    ]
    source, base, seen = run_dir(spark, "gate-in"), run_dir(spark, "gate"), []
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = append_rows(gate.run_gate(stream, timeout_hours=6, delay="3 hours"), base)
        query.awaitTermination()
        out = {(r.seqno, r.arrived, r.complete) for r in read_output(spark, base).collect()}
        seen.append(out)
    assert seen[0] == {("z", 0, True)}
    assert seen[1] == seen[0]
    assert seen[2] == seen[0] | {("a", 2, True), ("c", 1, True)}
    # the watermark now stands at six hours
    assert seen[3] == seen[4] - {("d", 0, True)}
    assert seen[4] == seen[2] | {("b", 0, False), ("d", 0, True)}
    # closed runs are forgotten with their timeout, given-up ones after twice that time
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= 4


def test_batches_are_committed_once(spark):
    at = F.to_timestamp(F.lit("2024-02-03 04:05:06"))
    made = spark.range(10).select(
        F.col("id").alias("material_id"), F.col("id").cast("string").alias("seqno"), F.lit("p").alias("pid"), F.lit("x").alias("data")
    )
    rows, path = results.generic_rows(made, at), run_dir(spark, "ledger")
    broken = rows.withColumn("contents", F.when(F.col("material_id") == 9, F.raise_error(F.lit("killed"))).otherwise(F.col("contents")))
    with pytest.raises(PySparkException):
        results.write_once(broken, path, "b1")
    assert results.committed_batches(spark, path).count() == 0
    assert results.write_once(rows, path, "b1") and not results.write_once(rows, path, "b1")
    assert results.write_once(rows.filter("material_id < 3"), path, "b2")
    assert results.read_committed(spark, path).count() == 13
    assert {(r.batch, r.rows) for r in results.committed_batches(spark, path).collect()} == {("b1", 10), ("b2", 3)}


def test_assigned_scan_reads_the_folders_of_its_pids(spark):
    path = run_dir(spark, "mat")
    rows = spark.range(40_000).select(
        F.col("id").alias("material_id"), (F.col("id") % 8).cast("string").alias("pid"), F.lit(2).alias("status")
    )
    catalog.write_materials(rows, path)
    scans = spark.createDataFrame(
        [("3", 100, 200, "s1"), ("3", 300, 301, "s1"), ("5", 0, 50, "s1"), ("6", 0, 9999, "s2")],
        "pid string, start_seq long, end_seq long, scanner_id string",
    )
    found = scan.scan_assigned(catalog.read_materials(spark, path), scans, "s1")
    got = sorted((r.pid, r.material_id) for r in found.select("pid", "material_id").collect())
    assert got == sorted([("3", i) for i in range(100, 200) if i % 8 == 3] + [("5", i) for i in range(50) if i % 8 == 5])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "dynamicpruning" in plan.lower() and "GreaterThanOrEqual(material_id,0)" in plan and "LessThan(material_id,301)" in plan
    assert scan.scan_assigned(catalog.read_materials(spark, path), scans, "nobody").count() == 0


def test_completeness_without_children(spark):
    parents = spark.createDataFrame([("s", "u")], "seqno string, href string")
    none = spark.createDataFrame([], "seqno string, url string")
    row = assemble.completeness(parents, none).first()
    assert (row.expected, row.arrived, row.complete) == (1, 0, False)
