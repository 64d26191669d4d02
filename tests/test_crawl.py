import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import assemble, extract, frontier, seen
from gleaner.operators.extract import Selector, match_selectors, prepare_pages

from gleaner.session import run_dir

SITE = "https://s.example.com/"
START = datetime(2024, 1, 1)


def page(name, *links, title=None, after=None):
    anchors = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in links)
    tail = f'<a class="next" href="{after}">more</a>' if after else ""
    return (SITE + name, f"<body><h1>{title or name}</h1><ul>{anchors}</ul>{tail}</body>")


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def links(ready):
    return extract.phased_items(match_selectors(ready, [Selector("//li/a", extract=1)]))


def titles(ready):
    return extract.phased_items(match_selectors(ready, [Selector("//h1")]))


def test_only_pages_of_the_frontier_reach_the_executor(spark):
    pages = pages_of(spark, [page("r", "a"), page("q", "b")])
    wanted = spark.createDataFrame([(SITE + "r", 1), (SITE + "gone", 1)], "url string, visits long")
    given = []
    frontier.visit(pages, wanted, lambda ready: given.append(ready) or links(ready)).collect()
    assert [r.url for r in given[0].select("url").collect()] == [SITE + "r"]


def test_phases_carry_visit_counts(spark):
    pages = pages_of(
        spark,
        [page("r", "a", "b", "gone"), page("q", "a"), page("a", "c", "c"), page("b", "c"), page("c")],
    )
    seeds = spark.createDataFrame([(SITE + "r",), (SITE + "q",)], "url string")
    items = frontier.crawl_phases(pages, seeds, [links, links, titles]).collect()
    got = sorted((r.phase, r.url[len(SITE):], r.value, r.visits) for r in items)
    assert got == [
        (1, "q", "a", 1), (1, "r", "a", 1), (1, "r", "b", 1), (1, "r", "gone", 1),
        (2, "a", "c", 2), (2, "a", "c", 2), (2, "b", "c", 1), (3, "c", "c", 5),
    ]


def test_missing_pages(spark):
    pages = pages_of(spark, [page("r")])
    wanted = spark.createDataFrame([(SITE + "r", 1), (SITE + "x", 2)], "url string, visits long")
    assert [r.url for r in frontier.missing_pages(pages, wanted).collect()] == [SITE + "x"]


def test_pagination_resolves_against_the_root(spark):
    rows = [
        page("list/", after="p2"),
        page("list/p2", after="p3#x"),
        page("list/p3", after="p4"),
        page("list/p4"),
        page("loop", after="loop"),
        page("dead", after="/nowhere"),
    ]
    pages = pages_of(spark, rows)
    nexts = frontier.next_links(prepare_pages(pages), "//a[@class='next']")
    roots = spark.createDataFrame([(SITE + "list/",), (SITE + "loop",), (SITE + "dead",)], "url string")
    got = sorted(
        (r.root[len(SITE):], r.page_no, r.url[len(SITE):])
        for r in frontier.paginate(nexts, roots, 3).collect()
    )
    assert got == [
        ("dead", 1, "dead"),
        ("list/", 1, "list/"), ("list/", 2, "list/p2"), ("list/", 3, "list/p3"),
        ("loop", 1, "loop"), ("loop", 2, "loop"), ("loop", 3, "loop"),
    ]


def test_long_chains_take_a_logarithm_of_rounds(spark, monkeypatch):
    rows = [page(f"p{n}", after=f"p{n + 1}") for n in range(40)] + [page("q0", after="?n=1"), page("q0?n=1", after="?n=2")]
    rows += [page("d/a", after="../e/b"), page("e/b", after="c"), page("d/c", after="/p38"), page("e/c")]
    nexts = frontier.next_links(prepare_pages(pages_of(spark, rows)), "//a[@class='next']")
    roots = spark.createDataFrame([(SITE + r,) for r in ("p0", "p3", "q0", "d/a")], "url string")
    written = []
    keep = frontier.cut_lineage
    monkeypatch.setattr(frontier, "cut_lineage", lambda df, label, *a: written.append(label) or keep(df, label, *a))
    got = {}
    for r in frontier.paginate(nexts, roots, 30).collect():
        got.setdefault(r.root[len(SITE):], {})[r.page_no] = r.url[len(SITE):]
    monkeypatch.undo()
    assert got["p0"] == {n + 1: f"p{n}" for n in range(30)} and got["p3"] == {n + 1: f"p{n + 3}" for n in range(30)}
    assert got["q0"] == {1: "q0", 2: "q0?n=1"}
    # "c" on e/b means d/c for a root in d, and p39 on p38 means d/p39: stepped by itself where the pointers end
    assert got["d/a"] == {1: "d/a", 2: "e/b", 3: "d/c", 4: "p38"}
    assert written.count("pointers") == 5


def test_each_run_sees_the_last_capture_before_it(spark):
    captures = spark.createDataFrame(
        [("u", START, 1), ("u", START + timedelta(days=2), 2), ("v", START + timedelta(days=1), 3), ("v", START + timedelta(days=9), 4)],
        "url string, captured_at timestamp, capture_id long",
    )
    tasks = spark.createDataFrame(
        [("a", "u", START), ("b", "u", START + timedelta(days=1)), ("c", "u", START + timedelta(days=2)), ("c", "u", START + timedelta(days=2)),
         ("d", "v", START), ("e", "v", START + timedelta(days=5)), ("f", "w", START)],
        "task string, url string, run_at timestamp",
    )
    got = sorted((r.task, r.capture_id) for r in frontier.as_of(tasks, captures).collect())
    assert got == [("a", 1), ("b", 1), ("c", 2), ("c", 2), ("d", None), ("e", 3), ("f", None)]


def _definition(addr, *selectors, child=None, **fields):
    body = {"addr": addr, "selectors": [{"xpath": x, "extract": 1} for x in selectors], **fields}
    return body | ({"child": child} if child else {})


def test_equal_captures_count_once_and_programs_share_pages(spark, monkeypatch):
    pages = pages_of(spark, [page("r", "a"), page("r", "a"), page("a"), page("a")])
    body = json.dumps(_definition(SITE + "r", "//li/a", child=_definition(None, "//h1")))
    other = json.dumps(_definition(SITE + "r", "//li/a", child=_definition(None, "//li")))
    materials = spark.createDataFrame([(k, body) for k in range(5)] + [(9, other)], "material_id long, definition string")
    given = []
    match = frontier.match_selectors
    monkeypatch.setattr(frontier, "match_selectors", lambda ready, *a: given.append(ready.count()) or match(ready, *a))
    items, missing = frontier.crawl_definitions(pages, materials)
    got = sorted((r.material_id, r.phase, r.value, int(r.visits)) for r in items.collect())
    assert got == sorted([(k, 1, "a", 1) for k in (0, 1, 2, 3, 4, 9)] + [(k, 2, "a", 1) for k in range(5)])
    assert given == [1, 2] and missing.count() == 0  # a page for each set of selectors asked of it


def test_crawls_without_a_usable_definition_are_empty(spark):
    pages = pages_of(spark, [page("r", "a")])
    for rows in ([], [(1, '{"selectors":[]}'), (2, None)]):
        materials = spark.createDataFrame(rows, "material_id long, definition string")
        items, missing = frontier.crawl_definitions(pages, materials)
        assert items.count() == missing.count() == 0 and "visits" in items.columns
    tasks = spark.createDataFrame([], "pid string, material_id long, uuid string, type int, charset string, seqno string, write_time string, url string, definition string")
    assert frontier.crawl_levels(pages, tasks).count() == 0


def test_url_states_outlive_runs_and_read_what_may_hit(spark):
    path = run_dir(spark, "states")
    at = lambda h: F.lit(START + timedelta(hours=h))
    tasks = spark.createDataFrame([(f"u{n}",) for n in range(30)] * 2 + [(" ",), (None,)], "url string")
    assert seen.claim(tasks, path, at(0)).count() == 30  # nothing is known yet
    states = [(f"u{n}", seen.FETCHED, 1) for n in range(10)] + [(f"u{n}", seen.DEAD, 1) for n in range(10, 15)]
    states += [(f"u{n}", seen.FETCHING, 1) for n in range(15, 20)] + [("u20", seen.FAILED, 3), ("u21", seen.FAILED, 1)]
    table = spark.createDataFrame(states, "url string, status string, tries int").withColumn("at", at(0))
    for _ in range(2):  # a run that is repeated replaces what it left
        seen.record(table, path, 1)
    soon = {r.url: r.tries for r in seen.claim(tasks, path, at(0.5)).collect()}
    assert soon == {f"u{n}": 1 for n in range(22, 30)} | {"u21": 2}
    assert {r.url for r in seen.claim(tasks, path, at(2)).collect()} == soon.keys() | {f"u{n}" for n in range(15, 20)}
    many = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("url"), F.lit(seen.FETCHED).alias("status"), F.lit(1).alias("tries"), at(3).alias("at"))
    seen.record(many.unionByName(table.filter("url = 'u21'").withColumns({"status": F.lit(seen.DEAD), "at": at(3)})), path, 2)
    assert {r.url: r.tries for r in seen.claim(tasks, path, at(0.5)).collect()} == {f"u{n}": 1 for n in range(22, 30)}
    asked = spark.range(2000).select(F.concat(F.lit("never"), "id").alias("url"))
    assert seen._may_hold(asked, path).count() < 40  # of 4,000 pairs of urls and runs
    target = run_dir(spark, "states")
    seen.compact(spark, path, target, 5)
    assert seen.known_states(tasks, target).count() == seen.known_states(tasks, path).count() == 22


def test_breadth_first_search_against_brute_force(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(60), 0 if rng.random() < 0.3 else rng.randrange(60)) for _ in range(110)}
    depth, level = {5: 0}, {5}
    for d in range(1, 4):
        level = {t for s, t in edges if s in level} - depth.keys()
        depth.update(dict.fromkeys(level, d))
    table = spark.createDataFrame(sorted(edges), "src long, dst long")
    seeds = spark.createDataFrame([(5,)], "node long")
    assert {r.node: r.depth for r in frontier.bfs(table, seeds, 3).collect()} == depth


def test_unseen_and_child_tasks(spark):
    tasks = spark.createDataFrame([("u1",), ("u1",), ("u2",), (" ",), (None,)], "url string")
    seen = spark.createDataFrame([("u2",)], "url string")
    assert [r.url for r in frontier.unseen(tasks, seen).collect()] == ["u1"]
    parents = spark.createDataFrame(
        [("p", 1, "x", 1, "utf-8", "s1", '{"child":{"level":2}}'), ("p", 2, "y", 1, "utf-8", "s2", "{}")],
        "pid string, material_id long, uuid string, type int, charset string, seqno string, definition string",
    )
    items = spark.createDataFrame(
        [("s1", "a"), ("s1", "a"), ("s1", None), ("s2", "b")], "seqno string, href string"
    )
    got = frontier.child_tasks(parents, items).collect()
    assert [(r.seqno, r.url, r.definition) for r in got] == [("s1", "a", '{"level":2}')]


def test_documents(spark):
    parents = spark.createDataFrame(
        [("s1", "l1", n, f"t{n}", f"h{n}", f"c{n}") for n in range(1, 8)]
        + [("s1", "l1", 8, "again", "h", "c1"), ("s2", "l2", 1, "x", "h", "lost"),
           ("s3", "l3", 1, "no link", "h", None)],
        "seqno string, url string, no int, value string, hashcode string, href string",
    )
    children = spark.createDataFrame(
        [("s1", f"c{n}", k, f"v{n}.{k}", "h") for n in range(1, 8) for k in (1, 2)],
        "seqno string, url string, no int, value string, hashcode string",
    )
    gate = {r.seqno: (r.expected, r.arrived, r.complete) for r in assemble.completeness(parents, children).collect()}
    assert gate == {"s1": (7, 7, True), "s2": (1, 0, False), "s3": (0, 0, True)}
    rows = assemble.document_rows(parents, children)
    for size, sizes in ((1000, [8]), (3, [3, 3, 2])):
        docs = sorted(assemble.documents(rows, size).filter("seqno = 's1'").collect(), key=lambda d: d.chunk_no)
        assert [len(d.tablelist) for d in docs] == sizes
        assert [(d.chunk_no, d.chunks) for d in docs] == [(k, len(sizes)) for k in range(len(sizes))]
        assert [i.no for d in docs for i in d.tablelist] == list(range(1, 9))
        contents = {k: v.value for d in docs for k, v in d.contents.items()}
        assert contents == {f"c{n}": f"v{n}.2" for n in range(1, 8)}
        assert all(f"c{i.no}" in d.contents for d in docs for i in d.tablelist if i.no < 8)
    assert '"chunk_no":0,"chunks":1,"tablelist":[{"no":1' in assemble.document_calls(
        assemble.documents(rows).filter("seqno = 's1'")
    ).first().data


def test_items_without_links_are_chunked_by_position(spark):
    parents = spark.range(5000).select(
        F.lit("s").alias("seqno"), F.lit("l").alias("url"), (F.col("id") + 1).cast("int").alias("no"),
        F.lit("v").alias("value"), F.lit("h").alias("hashcode"), F.lit(None).cast("string").alias("href"),
    )
    children = spark.createDataFrame([], "seqno string, url string, no int, value string, hashcode string")
    docs = assemble.documents(assemble.document_rows(parents, children)).collect()
    assert sorted((d.chunk_no, d.chunks, len(d.tablelist)) for d in docs) == [(k, 5, 1000) for k in range(5)]


def test_call_results_and_nested_dump(spark):
    pages = pages_of(spark, [page("r", "é")])
    items = links(prepare_pages(pages)).withColumns({"phase": F.lit(1), "visits": F.lit(3)})
    row = assemble.phase_documents(assemble.call_results(items)).first()
    assert '"srcurl":"https://s.example.com/r"' in row.value and '"visits":3' in row.value
    assert '"value":"é"' in row.value and '"href":"https://s.example.com/é"' in row.value


def test_limits_banners_and_dispatch(spark):
    html = '<a href="/1">t</a><a href="/2"><img alt=x><img src="i/2.png?v=1"></a><img src=/3.gif>'
    ready = prepare_pages(spark.createDataFrame([(SITE + "d/p", html, 2)], "url string, html string, type int"))
    linked = extract.banner_items(match_selectors(ready, [Selector("//a")], inside=True), "./img").first()
    assert (linked.no, linked.imgsrc, linked.link, linked.imgname, linked.domain) == (
        1, SITE + "d/i/2.png?v=1", SITE + "2", "2.png?v=1", "example.com",
    )
    plain = extract.banner_items(match_selectors(ready, [Selector("//img")])).collect()
    assert [(r.no, r.imgname) for r in plain] == [(1, "2.png?v=1"), (2, "3.gif")]
    none = extract.subscribe_items(match_selectors(ready, [Selector("//a", item_limit=0)]))
    assert none.count() == 0
    collectors = {
        2: lambda t: extract.banner_items(match_selectors(t, [Selector("//img")])),
        3: lambda t: extract.subscribe_items(match_selectors(t, [Selector("//a")])),
    }
    assert {r.type for r in extract.dispatch(ready, collectors).collect()} == {2}


def test_the_index_sorts_a_bounded_number_of_tags_a_task(spark, monkeypatch):
    from gleaner.operators import elements

    rows = [page(f"p{n}", *[f"x{k}" for k in range(20)]) for n in range(30)]
    whole = sorted(map(tuple, prepare_pages(pages_of(spark, rows)).collect()))
    pages = spark.createDataFrame([(n, ["<b>", "</b>"] * 100) for n in range(60)], "page_no long, tags array<string>")
    for limit, tasks in ((elements.TAGS_A_TASK, 1), (1000, 12)):
        monkeypatch.setattr(elements, "TAGS_A_TASK", limit)
        found = elements.element_rows(pages)
        assert found.count() == 6000 and found.rdd.getNumPartitions() == tasks
        assert sorted(map(tuple, prepare_pages(pages_of(spark, rows)).collect())) == whole


def test_captures_are_chosen_once(spark):
    other = START + timedelta(days=1)
    rows = [("u", START, "<p>1</p>"), ("u", START, "<p>2</p>"), ("u", other, "<p>1</p>"), (None, START, "<p>3</p>"),
            (None, START, "<p>4</p>"), ("v", None, "<p>5</p>"), ("v", None, "<p>5</p>"), ("w", START, None)]
    index = frontier.index_captures(spark.createDataFrame(rows, "url string, captured_at timestamp, html string"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    got = [(r.url, r.captured_at) for r in index.collect()]
    assert len(got) == 5 and set(got) == {("u", START), ("u", other), (None, START), ("v", datetime(1970, 1, 1)), ("w", START)}
    assert "Aggregate" not in plan.replace("PushedAggregat", "") and plan.count("FileScan") == 2, plan
