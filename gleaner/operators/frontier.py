"""Following links across captured pages: phases, pagination, bounded breadth-first search.

Pages are indexed once; rounds run one after another from the driver, but each is a
distributed join, and its result is written to the shared folder: later rounds start from
files, and the driver sees nothing but emptiness checks. A page is extracted once for each
set of selectors that is asked of it, however many runs and materials ask.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gleaner.functions import markup
from gleaner.functions.sqltext import each, first, keep
from gleaner.functions.text import is_blank
from gleaner.functions.urls import abs_url
from gleaner.operators import definitions
from gleaner.operators.extract import (
    mass_items,
    match_selectors,
    phased_items,
    prepare_pages,
    wrapped_items,
)
from gleaner.session import cut_lineage, run_dir

Executor = Callable[[DataFrame], DataFrame]
WEIGHT = "decimal(38,0)"
#: A run without an instant sees every capture, a capture without one is seen by every run.
ALWAYS, EVER = "timestamp'9999-12-31 00:00:00'", "timestamp'1970-01-01 00:00:00'"

_ITEMS = (
    "material_id bigint, srcurl string, url string, page_no int, selector_no int, no int, value string, "
    "hashcode string, subvalues array<string>, href string, visits decimal(38,0), phase int"
)
_MISSING = "phase int, material_id bigint, srcurl string, url string"
_LEVEL_ITEMS = (
    "seqno string, material_id bigint, url string, selector_no int, no int, value string, "
    "hashcode string, href string, level int"
)


def with_round(schema: StructType, name: str) -> StructType:
    """A written round's schema plus the column its folder name carries."""
    return StructType([*schema.fields, StructField(name, IntegerType())])


# ---- captures --------------------------------------------------------------------------


def index_captures(pages: DataFrame) -> DataFrame:
    """Indexed pages, one row per url and instant, with ``capture_id`` and ``captured_at``.

    Pages without ``captured_at`` count as captured before every run. Of several captures of
    one url at one instant the one whose content sorts last by fingerprint counts; the others
    are written once, so that no reader of the index chooses again or shuffles what it holds.
    """
    if "capture_id" in pages.columns:
        return pages
    at = F.coalesce("captured_at", F.expr(EVER)) if "captured_at" in pages.columns else F.expr(EVER)
    content = F.to_json("markup") if "html" not in pages.columns else F.col("html")
    marked = pages.withColumns(
        {"capture_id": F.monotonically_increasing_id(), "captured_at": at, "print": F.md5(content)}
    )
    marked = cut_lineage(marked, "captures") if "html" not in pages.columns else prepare_pages(marked)
    slim = marked.select("url", "captured_at", "print", "capture_id")
    several = slim.groupBy(F.col("url").alias("u"), F.col("captured_at").alias("t")).agg(
        F.max(F.struct("print", "capture_id")).alias("c"), F.count("*").alias("n")
    )
    same = F.col("url").eqNullSafe(F.col("u")) & (F.col("captured_at") == F.col("t")) & (F.col("capture_id") != F.col("c.capture_id"))
    others = cut_lineage(slim.join(several.filter("n > 1"), same, "left_semi").select("capture_id"), "other-captures")
    return marked.drop("print").join(others, "capture_id", "left_anti")


def latest_captures(captures: DataFrame) -> DataFrame:
    """The last capture of each url."""
    last = captures.groupBy("url").agg(F.max(F.struct("captured_at", "capture_id")).alias("c"))
    return captures.join(last.select("c.capture_id"), "capture_id", "left_semi")


def as_of(tasks: DataFrame, captures: DataFrame, at: str = "run_at") -> DataFrame:
    """Tasks with the ``capture_id`` of the last capture of their url at or before their instant.

    NULL where there is none. Captures and distinct (url, instant) pairs are sorted together
    by url and time, and each pair takes the capture before it: no task meets more than one.
    """
    known = captures.select("url", F.col("captured_at").alias(at), F.lit(0).alias("asks"), "capture_id")
    asked = tasks.select("url", at).distinct().select("url", at, F.lit(1).alias("asks"), F.lit(None).cast("long").alias("capture_id"))
    before = Window.partitionBy("url").orderBy(at, "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = known.unionByName(asked).withColumn("capture_id", F.last("capture_id", ignorenulls=True).over(before))
    return tasks.join(found.filter("asks = 1").drop("asks"), ["url", at], "left")


# ---- phases given as executors ---------------------------------------------------------


def visit(pages: DataFrame, frontier: DataFrame, executor: Executor) -> DataFrame:
    """Items of the pages on the frontier, with the frontier's columns.

    ``frontier`` holds each url once, and so do ``pages``. ``executor`` maps prepared pages to
    items that keep ``url``; it is given the frontier's pages and no others, whatever the size
    of either. Spark picks the join by the sizes it knows: the frontier is a written table.
    """
    hit = pages.join(frontier.select("url"), "url", "left_semi")
    return executor(prepare_pages(hit)).join(frontier, "url")


def missing_pages(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier rows whose page was not captured."""
    return frontier.join(pages.select("url"), "url", "left_anti")


def next_frontier(items: DataFrame) -> DataFrame:
    """Distinct hrefs with the number of visits they stand for.

    A page linked a million times is one row of weight a million, not a million rows. Weights
    multiply from phase to phase: they are decimals of 38 digits.
    """
    return (
        items.filter("href is not null")
        .groupBy(F.col("href").alias("url"))
        .agg(F.sum("visits").cast(WEIGHT).alias("visits"))
    )


def crawl_phases(pages: DataFrame, seeds: DataFrame, phases: Sequence[Executor]) -> DataFrame:
    """Phase chain: the hrefs found in one phase are the pages of the next.

    Each executor returns items with ``url`` and ``href``, and the same columns in every
    phase. The result has every item once, with its ``phase`` and its ``visits``. Of a page
    captured more than once the last capture counts.
    """
    extra = ["capture_id", *([] if "captured_at" in pages.columns else ["captured_at"])]
    index = latest_captures(index_captures(pages)).drop(*extra)
    frontier = seeds.groupBy("url").agg(F.count("*").cast(WEIGHT).alias("visits"))
    base = run_dir(pages.sparkSession, "phases")
    schema = None
    for number, executor in enumerate(phases, 1):
        found = visit(index, frontier, executor)
        items = cut_lineage(found, "phase", f"{base}/phase={number}")
        schema = schema or found.schema
        frontier = cut_lineage(next_frontier(items), "frontier", f"{base}-frontier-{number}")
        if number < len(phases) and frontier.isEmpty():
            break
    return pages.sparkSession.read.schema(with_round(schema, "phase")).parquet(base)


# ---- pagination ------------------------------------------------------------------------


def _next_href(steps: list | str) -> Column:
    """The raw href of the first "next" element that has one."""
    found = markup.select_sql("markup.elements", steps)
    hrefs = each(found, lambda e: markup.attribute_sql(f"{e}.open", "href"))
    return F.expr(first(keep(hrefs, lambda h: f"{h} IS NOT NULL")))


def next_links(prepared: DataFrame, xpath: str) -> DataFrame:
    """The raw href of the first "next" element that has one, per page."""
    return prepared.select("url", _next_href(markup.parse_steps(xpath)).alias("next_href"))


def _origin(url: str) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


def _folder(url: str) -> Column:
    return F.concat(_origin(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/(?:[^?#]*/)?)?", 1))


def _path(url: str) -> Column:
    return F.regexp_extract(url, "^[^?#]*", 0)


def _pointers(nexts: DataFrame) -> DataFrame:
    """``sel, url, target`` of one step, with what a root must have in common for it to hold.

    A next href resolves against the root of its chain. It gives the same page from any root
    of one origin if it is an absolute path, of one folder if it is relative, of one path if
    it is a query; ``newest`` is the capture a run must be able to see. An href that stands
    for the root itself gives no pointer.
    """
    last = nexts.groupBy("sel", "url").agg(F.max(F.struct("captured_at", "next_href")).alias("n"))
    rows = last.select("sel", "url", F.col("n.next_href").alias("href"), F.col("n.captured_at").alias("newest"))
    href = F.col("href")
    fixed = href.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.\-]*:)")
    return rows.filter(href.isNotNull() & ~href.rlike(r"^\s*(?:#.*)?$")).select(
        "sel",
        "url",
        abs_url("url", "href").alias("target"),
        _origin("url").alias("origin"),
        F.when(~fixed & ~href.startswith("?"), _folder("url")).alias("folder"),
        F.when(href.startswith("?"), _path("url")).alias("path"),
        "newest",
    )


def _squared(steps: DataFrame) -> DataFrame:
    """Pointers over twice the distance, where the needs of both halves agree."""
    a, b = steps.alias("a"), steps.alias("b")
    agree = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(True))
    both = a.join(b, (F.col("a.sel") == F.col("b.sel")) & (F.col("a.target") == F.col("b.url")) & (F.col("a.origin") == F.col("b.origin")))
    return both.filter(agree("folder") & agree("path")).select(
        "a.sel", "a.url", "b.target", "a.origin",
        F.coalesce("a.folder", "b.folder").alias("folder"), F.coalesce("a.path", "b.path").alias("path"),
        F.greatest("a.newest", "b.newest").alias("newest"),
    )


def _chains(starts: DataFrame, nexts: DataFrame, captures: DataFrame) -> DataFrame:
    """Pages of each chain: the columns of ``starts``, ``url`` and ``page_no`` from 1.

    ``starts`` has ``chain, root, sel, page_limit, run_at``; ``nexts`` the raw next href of each
    capture by selector (``sel, url, captured_at, capture_id, next_href``). Pointers are squared
    round by round, and round k lengthens all chains from 2**k pages to twice that, so rounds
    follow the logarithm of the longest limit. A cycle goes round until its limit. Links that
    depend on the root, and runs before a later capture, are stepped one by one from where the
    pointers end.
    """
    keep_columns = starts.columns
    longest = starts.agg(F.max("page_limit")).first()[0] or 1
    pages = cut_lineage(starts.withColumns({"url": F.col("root"), "page_no": F.lit(1)}), "chains")
    fits = (
        (F.col("origin") == _origin("root"))
        & F.coalesce(F.col("folder") == _folder("root"), F.lit(True))
        & F.coalesce(F.col("path") == _path("root"), F.lit(True))
        & (F.col("newest") <= F.col("run_at"))
    )
    reach, steps = 1, None
    while reach < longest:
        steps = cut_lineage(_pointers(nexts) if steps is None else _squared(steps), "pointers")
        further = pages.join(steps, ["sel", "url"]).filter(fits & (F.col("page_no") + reach <= F.col("page_limit")))
        further = further.select(*keep_columns, F.col("target").alias("url"), (F.col("page_no") + reach).alias("page_no"))
        grown = cut_lineage(pages.unionByName(further), "chains")
        if steps.isEmpty():
            break
        pages, reach = grown, 2 * reach
    ends = pages.groupBy(*keep_columns).agg(F.max_by("url", "page_no").alias("url"), F.max("page_no").alias("page_no"))
    while longest > 1:
        going = as_of(ends.filter("page_no < page_limit"), captures)
        after = going.join(nexts.select("sel", "capture_id", "next_href"), ["sel", "capture_id"]).filter("next_href is not null")
        after = after.select(*keep_columns, abs_url("root", "next_href").alias("url"), (F.col("page_no") + 1).alias("page_no"))
        ends = cut_lineage(after, "chain-step")
        if ends.isEmpty():
            break
        pages = pages.unionByName(ends)
    return pages


def paginate(nexts: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Pages reached from each root by following "next", ``limit`` at most, root included.

    ``nexts`` has one row per captured page: (url, next_href). A next href resolves
    against the root, and a page that was not captured ends its chain.
    """
    known = nexts.select("url", "next_href").withColumns(
        {"sel": F.lit(""), "captured_at": F.expr(EVER), "capture_id": F.monotonically_increasing_id()}
    )
    known = cut_lineage(known, "nexts")
    starts = roots.select(F.col("url").alias("root")).distinct()
    starts = starts.withColumns({"sel": F.lit(""), "page_limit": F.lit(limit), "run_at": F.expr(ALWAYS)})
    found = _chains(starts, known, known.select("url", "captured_at", "capture_id"))
    return found.select("root", "url", "page_no").join(known.select("url"), "url", "left_semi")


# ---- crawls by definition --------------------------------------------------------------


def _programs(flat: DataFrame) -> DataFrame:
    """``flat`` with ``program``: the same for materials that ask the same of a page in a phase."""
    asked = F.array_sort(
        F.collect_list(F.struct("selector_no", "extract", "wrap", "item_limit", "xpath", "sub_xpaths", "link_xpath"))
    )
    known = flat.groupBy("material_id", "phase").agg(F.md5(F.to_json(asked)).alias("program"))
    return flat.join(known, ["material_id", "phase"])


def _selector_table(flat: DataFrame, *columns: str) -> DataFrame:
    return flat.select("program", "selector_no", *columns).dropDuplicates(["program", "selector_no"])


def _run_instant(rows: DataFrame) -> Column:
    return F.coalesce("run_at", F.expr(ALWAYS)) if "run_at" in rows.columns else F.expr(ALWAYS)


def crawl_definitions(pages: DataFrame, materials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crawl as the definitions say: ``(items, missing)``.

    Each level of a definition is a phase. Its pages are the links of the phase before, and
    what its pagination reaches from them; items of all those carry the page they started
    from as ``srcurl``. Materials may have a ``run_at`` and pages a ``captured_at``: a run sees
    the last capture at or before its instant. ``missing`` has (phase, material_id, srcurl, url)
    of pages without such a capture: their results are empty. Unusable selectors are left to
    :func:`definitions.rejects`; without usable ones both tables are empty.
    """
    spark = pages.sparkSession
    flat = definitions.flatten(materials).filter(definitions.is_supported())
    flat = cut_lineage(_programs(flat.withColumn("next_steps", markup.step_column("next_xpath"))), "selectors")
    last = flat.agg(F.max("phase")).first()[0] or 0
    if last == 0:
        return spark.createDataFrame([], _ITEMS), spark.createDataFrame([], _MISSING)
    index = index_captures(pages)
    instants = index.select("url", "captured_at", "capture_id")
    runs = materials.select("material_id", _run_instant(materials).alias("run_at"))
    start = flat.filter("phase = 1 and addr is not null").select("material_id", F.col("addr").alias("url")).distinct()
    roots = start.join(runs, "material_id").withColumn("visits", F.lit(1).cast(WEIGHT))
    base = run_dir(spark, "definition-crawl")
    schema = missing = None
    for phase in range(1, last + 1):
        here = flat.filter(F.col("phase") == phase)
        rules = here.groupBy("material_id", "program").agg(
            F.max("page_limit").alias("page_limit"),
            F.max(F.when(F.col("next_steps").isNotNull(), F.col("next_xpath"))).alias("sel"),
        )
        ruled = roots.join(rules, "material_id").withColumnRenamed("url", "root")
        limit = F.when(F.col("sel").isNull(), 1).otherwise(F.greatest(F.coalesce("page_limit", F.lit(1)), F.lit(1)))
        starts = cut_lineage(
            ruled.select("material_id", "root", "run_at", "visits", "program", F.coalesce("sel", F.lit("")).alias("sel"), limit.alias("page_limit")),
            "roots",
        )
        paged = starts.filter("page_limit > 1").select(_origin("root").alias("origin"), "sel").distinct()
        paged = paged.join(here.select(F.col("next_xpath").alias("sel"), "next_steps").dropDuplicates(["sel"]), "sel")
        # written, so that its size is known: a few sites need no shuffle of all pages by site, no site none at all
        paged = cut_lineage(paged, "paged")
        nexts = index.withColumn("origin", _origin("url")).join(paged, "origin")
        nexts = cut_lineage(
            nexts.select("sel", "url", "captured_at", "capture_id", _next_href("next_steps").alias("next_href")), "nexts"
        )
        visited = cut_lineage(as_of(_chains(starts, nexts, instants), instants), "visited")
        wanted = visited.filter("capture_id is not null").select("program", "capture_id").distinct()
        ready = index.select("capture_id", "url", "markup").join(wanted, "capture_id")
        selectors = _selector_table(here, "extract", "wrap", "item_limit", "steps", "sub_steps", "link_steps")
        found = phased_items(match_selectors(ready, selectors, "program"), "sub_steps").drop("url")
        found = found.join(visited.drop("sel", "page_limit", "run_at"), ["program", "capture_id"]).select(
            "material_id", F.col("root").alias("srcurl"), "url", "page_no", "selector_no", "no", "value",
            "hashcode", "subvalues", "href", "visits",
        )
        items = cut_lineage(found, "phase", f"{base}/phase={phase}")
        schema = schema or found.schema
        lost = visited.filter("capture_id is null").select(
            F.lit(phase).alias("phase"), "material_id", F.col("root").alias("srcurl"), "url"
        )
        missing = lost if missing is None else missing.unionByName(lost)
        roots = (
            items.filter("href is not null")
            .groupBy("material_id", F.col("href").alias("url"))
            .agg(F.sum("visits").cast(WEIGHT).alias("visits"))
        ).join(runs, "material_id")
    return spark.read.schema(with_round(schema, "phase")).parquet(base), missing


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Nodes within ``max_depth`` links of the seeds, with their least depth.

    ``edges`` has (src, dst), seeds have ``node``. A node is expanded once: each round's
    targets are made distinct and those seen before are dropped by an anti-join.
    """
    spark = edges.sparkSession
    edges = cut_lineage(edges.select("src", "dst").distinct(), "edges")
    base = run_dir(spark, "bfs")
    level = seeds.select("node").distinct()
    schema = with_round(level.schema, "depth")
    level = cut_lineage(level, "bfs", f"{base}/depth=0")
    for depth in range(1, max_depth + 1):
        reached = (
            edges.join(level, edges.src == level.node, "left_semi")
            .select(F.col("dst").alias("node"))
            .distinct()
        )
        seen = spark.read.schema(schema).parquet(base).select("node")
        level = cut_lineage(
            reached.join(seen, "node", "left_anti"), "bfs", f"{base}/depth={depth}"
        )
        if level.isEmpty():
            break
    return spark.read.schema(schema).parquet(base)


def crawl_levels(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """List pages and what they lead to, level by level as each task's definition nests.

    ``tasks`` (pid, material_id, uuid, type, charset, seqno, write_time, url, definition) open
    runs. The links of a level become the tasks of the next, each url once in a run. A level
    gives one item per match or, with ``wrap``, one per selector. Items keep their ``seqno``
    and ``level``; a page that was not captured when the run was written has none. Without a
    usable definition the result is empty.
    """
    spark = pages.sparkSession
    materials = tasks.select("material_id", "definition").distinct()
    flat = definitions.flatten(materials).filter(definitions.is_supported())
    flat = cut_lineage(_programs(flat), "selectors")
    last = flat.agg(F.max("phase")).first()[0] or 0
    if last == 0:
        return spark.createDataFrame([], _LEVEL_ITEMS)
    index = index_captures(pages)
    instants = index.select("url", "captured_at", "capture_id")
    written = F.to_timestamp("write_time") if "write_time" in tasks.columns else F.expr(ALWAYS)
    columns = ["seqno", "material_id", "url", "selector_no", "no", "value", "hashcode", "href"]
    base, schema = run_dir(spark, "levels"), None
    current = cut_lineage(tasks, "tasks")
    for level in range(1, last + 1):
        here = flat.filter(F.col("phase") == level)
        asked = current.withColumn("run_at", F.coalesce(written, F.expr(ALWAYS))).select("seqno", "material_id", "url", "run_at")
        asked = asked.join(here.select("material_id", "program").distinct(), "material_id")
        visited = cut_lineage(as_of(asked, instants).filter("capture_id is not null"), "visited")
        ready = index.select("capture_id", "url", "markup").join(visited.select("program", "capture_id").distinct(), "capture_id")
        matched = match_selectors(ready, _selector_table(here, "extract", "wrap", "item_limit", "steps", "link_steps"), "program")
        listed = mass_items(matched.filter("wrap = 0"))
        wrapped = wrapped_items(matched.filter("wrap = 1")).withColumn("href", F.lit(None).cast("string"))
        items = ["program", "capture_id", "selector_no", "no", "value", "hashcode", "href"]
        found = listed.select(*items).unionByName(wrapped.select(*items))
        found = found.join(visited, ["program", "capture_id"]).select(*columns)
        items = cut_lineage(found, "level", f"{base}/level={level}")
        schema = schema or found.schema
        current = cut_lineage(child_tasks(current, items), "tasks")
    return spark.read.schema(with_round(schema, "level")).parquet(base)


def unseen(tasks: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Tasks with a key that was not processed before, each key once."""
    filled = tasks.filter(~is_blank(F.col(key)))
    return filled.dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def child_tasks(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks for the links of a task's page: the run's keys, the link, the child definition."""
    links = items.filter("href is not null").select("seqno", "href").distinct()
    child = F.get_json_object("definition", "$.child")
    written = ["write_time"] if "write_time" in tasks.columns else []
    return (
        tasks.filter(child.isNotNull())
        .select(
            "pid", "material_id", "uuid", "type", "charset", "seqno", *written, child.alias("definition")
        )
        .distinct()  # a run may have many pages on a level; its child definition is one
        .join(links, "seqno")
        .withColumnRenamed("href", "url")
    )
