"""Inputs of the registered queries: the given tables, and data derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions.keys import seqno, write_time
from gleaner.operators import extract
from gleaner.operators.extract import Selector, mask_pages, prepare_pages
from gleaner.operators.scan import split_ranges
from gleaner.session import cut_lineage

# Definitions of the materials derived from pages: page p has type p % 5 + 1.
DEFINITIONS = {
    1: """{"addr":"@URL","type":1,"level":1,"wrap":0,"selectors":[{"xpath":"//li/a","extract":1},{"xpath":"//h1","extract":0}],"child":{"level":2,"wrap":1,"selectors":[{"xpath":"//p","extract":0}]}}""",
    2: """{"addr":"@URL","type":2,"selectors":[{"xpath":"./img","linkselector":{"xpath":"//a"}}]}""",
    3: """{"addr":"@URL","type":3,"limit":3,"selectors":[{"xpath":"//p"},{"xpath":"//div[@class='ad']"}]}""",
    4: """{"addr":"@URL","type":4,"yaxisXpath":"//p","timeXAxis":true}""",
    5: """{"addr":"@URL","type":5}""",
}
START = "2024-01-01 00:00:00"
SITE = "https://site.example.com/p/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def start_instant() -> Column:
    return F.to_timestamp(F.lit(START))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_pages(pages(spark, sf_dir))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_pages(pages(spark, sf_dir))


def banner_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a linked image at the end; seven pages share an image name."""
    ident = F.col("page_id").cast("string")
    tail = F.concat(
        F.lit('<a href="/p/'), ident, F.lit('"><img src="/i/'),
        F.floor(F.col("page_id") / 7).cast("string"), F.lit('.png"></a>'),
    )
    return pages(spark, sf_dir).withColumn("html", F.concat("html", tail))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One material per page, with a definition by type."""
    kind = F.col("page_id") % 5 + 1
    definition = F.lit(None).cast("string")
    for number, body in DEFINITIONS.items():
        definition = F.when(
            kind == number, F.replace(F.lit(body), F.lit("@URL"), F.col("url"))
        ).otherwise(definition)
    return pages(spark, sf_dir).select(
        F.lit("p1").alias("pid"),
        F.col("page_id").alias("material_id"),
        F.md5("url").alias("uuid"),
        definition.alias("definition"),
    )


def _nested(levels: int) -> str:
    body = '{"selectors":[{"xpath":"//b"}]}'
    for _ in range(levels - 2):
        body = f'{{"selectors":[{{"xpath":"//p"}}],"child":{body}}}'
    return f'{{"addr":"@URL","type":1,"selectors":[{{"xpath":"//h1"}}],"child":{body}}}'


# Definitions as they come: deep ones, one cut off, one with a selector out of range, none.
MIXED = {
    0: _nested(6),
    1: '{"addr":"@URL","type":3,"selectors":[{"xp',
    2: """{"addr":"@URL","type":3,"selectors":[{"xpath":"//p[1]"},{"xpath":"//h1"}]}""",
}


def mixed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials with good, bad and missing definitions by page_id % 4."""
    definition = F.lit(None).cast("string")
    for number, body in MIXED.items():
        filled = F.replace(F.lit(body), F.lit("@URL"), F.col("url"))
        definition = F.when(F.col("page_id") % 4 == number, filled).otherwise(definition)
    return pages(spark, sf_dir).select(F.col("page_id").alias("material_id"), definition.alias("definition"))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under one site, each with three links to other pages and most with a next link."""
    rows = pages(spark, sf_dir)
    total = table(spark, sf_dir, "pages").count()
    ident = F.col("page_id")
    links = [
        F.concat(
            F.lit('<a href="/p/'), ((ident * 13 + k * 7 + 1) % total).cast("string"), F.lit('">to</a>')
        )
        for k in range(3)
    ]
    after = F.when(
        ident % 5 != 4,
        F.concat(F.lit('<a class="next" href="/p/'), (ident + 1).cast("string"), F.lit('">next</a>')),
    ).otherwise(F.lit(""))
    return rows.select(
        "page_id",
        F.concat(F.lit(SITE), ident.cast("string")).alias("url"),
        F.concat("html", F.lit('<div class="to">'), *links, F.lit("</div>"), after).alias("html"),
    )


# Crawls over the site: three phases with pagination, and two with sub-selectors.
CRAWLS = {
    0: """{"addr":"@URL","selectors":[{"xpath":"//div[@class='to']/a","extract":1}],
"pagination":{"limit":2,"interim":1,"mode":1,"selector":{"xpath":"//a[@class='next']"}},
"child":{"selectors":[{"xpath":"//h1"},{"xpath":"//div[@class='to']/a","extract":1}],
"child":{"selectors":[{"xpath":"//h1"}]}}}""",
    1: """{"addr":"@URL","selectors":[{"xpath":"//article","subselectors":[{"xpath":"./h1"}]},
{"xpath":"//li/a","extract":1},{"xpath":"//div[@class='to']/a","extract":1}],
"child":{"selectors":[{"xpath":"//h1"}]}}""",
}


def crawl_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from each page of the site, of either kind by page_id % 2."""
    definition = F.when(F.col("page_id") % 2 == 0, F.lit(CRAWLS[0])).otherwise(F.lit(CRAWLS[1]))
    url = F.concat(F.lit(SITE), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("material_id"), F.replace(definition, F.lit("@URL"), url).alias("definition")
    )


# Definitions that hide what a run cannot use: empty, of other types, deep, strange.
AUDITED = {
    0: '{"addr":"@URL","type":3,"selectors":[]}',
    1: '{"addr":"@URL","type":3,"limit":"many","selectors":[{"xpath":"//p"},{"xpath":["//b"]}]}',
    2: '{"addr":"@URL","type":1,"selectors":[{"xpath":"//h1"}],"child":{"selectors":"//p","child":{"selectors":[{"xpath":"//b"}]}}}',
    3: '{"addr":"@URL","type":"3","selectors":[{"xpath":"//p"}],"note":"\\"child\\":\\"child\\":"}',
    4: '{"addr":"@URL","type":4}',
    5: '{"addr":"@URL","type":3,"selectors":[{"xpath":"//p"}],"child":[1]}',
    6: "[]",
}


def audited_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials with one of the audited definitions by page_id % 7."""
    definition = F.lit(None).cast("string")
    for number, body in AUDITED.items():
        filled = F.replace(F.lit(body), F.lit("@URL"), F.col("url"))
        definition = F.when(F.col("page_id") % 7 == number, filled).otherwise(definition)
    return pages(spark, sf_dir).select(F.col("page_id").alias("material_id"), definition.alias("definition"))


RECAPTURE_DAYS, EARLY_DAYS, LATE_DAYS = 10, 1, 20
RECAPTURED = """{"addr":"@URL","selectors":[{"xpath":"//div[@class='to']/a","extract":1},{"xpath":"//h1"}],
"child":{"selectors":[{"xpath":"//h1"}]}}"""


def recaptured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of each page of the site, the second with a new title; of every seventh the second only."""
    first = site_pages(spark, sf_dir).withColumn("captured_at", start_instant())
    later = start_instant() + F.expr(f"interval {RECAPTURE_DAYS} days")
    second = first.withColumn("html", F.replace("html", F.lit("<h1>"), F.lit("<h1>New "))).withColumn("captured_at", later)
    return first.filter("page_id % 7 <> 3").unionByName(second)


def timed_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from each page: before its second capture for even pages, after it for odd ones."""
    url = F.concat(F.lit(SITE), F.col("page_id").cast("string"))
    early, late = (start_instant() + F.expr(f"interval {n} days") for n in (EARLY_DAYS, LATE_DAYS))
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("material_id"),
        F.replace(F.lit(RECAPTURED), F.lit("@URL"), url).alias("definition"),
        F.when(F.col("page_id") % 2 == 0, early).otherwise(late).alias("run_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between pages, from the number of links on each page."""
    total = table(spark, sf_dir, "pages").count()
    tags = markup.link_tags("markup")
    found = masked(spark, sf_dir).select("page_id", F.posexplode(tags).alias("no", "tag"))
    dst = (F.col("page_id") * 13 + F.col("no") * 7 + 1) % total
    return found.select(F.col("page_id").alias("src"), dst.alias("dst")).distinct()


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two-level runs: level-1 items of every page and the contents of the linked pages.

    Pages whose id is a multiple of five were not captured as children.
    """
    site = site_pages(spark, sf_dir)
    ready = prepare_pages(site)
    lists = extract.mass_items(
        extract.match_selectors(ready, [Selector("//div[@class='to']/a", extract=1)])
    )
    parents = cut_lineage(
        lists.select(
            seqno(F.col("page_id"), start_instant()).alias("seqno"),
            "url", "no", "value", "hashcode", "href",
        ),
        "parents",
    )
    captured = ready.filter(F.col("page_id") % 5 != 0)
    contents = extract.wrapped_items(
        extract.match_selectors(captured, [Selector("//h1", wrap=1)])
    ).select(F.col("url").alias("href"), "no", "value", "hashcode")
    children = (
        parents.select("seqno", "href").distinct().join(contents, "href")
        .withColumnRenamed("href", "url")
    )
    return parents, cut_lineage(children, "children")


def list_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list task for each page; those of odd pages are on level 2."""
    deeper = F.lit(DEFINITIONS[1].replace('"level":1', '"level":2', 1))
    definition = F.when(F.col("page_id") % 2 == 0, F.lit(DEFINITIONS[1])).otherwise(deeper)
    return pages(spark, sf_dir).select(
        F.lit("p1").alias("pid"), F.col("page_id").alias("material_id"), F.md5("url").alias("uuid"),
        F.replace(definition, F.lit("@URL"), F.col("url")).alias("definition"),
    )


# A list page, its linked pages, and theirs; @L is the level of the outermost part.
NESTED_LIST = """{"addr":"@URL","type":1,"level":@L,"wrap":0,
"selectors":[{"xpath":"//div[@class='to']/a","extract":1}],
"child":{"level":2,"wrap":0,"selectors":[{"xpath":"//h1","extract":0},{"xpath":"//div[@class='to']/a","extract":1}],
"child":{"level":3,"wrap":1,"selectors":[{"xpath":"//h1","extract":0}]}}}"""


def site_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each page of the site; those of odd pages are not on level 1."""
    ident = F.col("page_id")
    level = F.when(ident % 2 == 0, F.lit("1")).otherwise(F.lit("2"))
    url = F.concat(F.lit(SITE), ident.cast("string"))
    definition = F.replace(F.replace(F.lit(NESTED_LIST), F.lit("@URL"), url), F.lit("@L"), level)
    at = start_instant()
    return pages(spark, sf_dir).select(
        F.lit("p1").alias("pid"), ident.alias("material_id"), F.md5("url").alias("uuid"), F.lit(1).alias("type"),
        F.lit("utf-8").alias("charset"), seqno(ident, at).alias("seqno"), write_time(at).alias("write_time"),
        url.alias("url"), definition.alias("definition"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log keyed by event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("domain"),
    )


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition catalog: one partition of order keys per customer."""
    orders = table(spark, sf_dir, "orders")
    grouped = orders.groupBy(F.col("o_custkey").cast("string").alias("pid")).agg(
        F.max("o_orderkey").alias("max_seq"),
        F.min("o_orderkey").alias("min_seq"),
        F.least(F.count("*"), F.lit(4)).cast("int").alias("split_num"),
    )
    return grouped.withColumn("assigned", F.col("pid").cast("long") % 2 == 0)


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def delayed_slice(column: str = "ts") -> Column:
    """Thirds of a month by time, but that every 50th request of the first comes with the last."""
    third = F.least(F.floor((F.dayofmonth(column) - 1) / 10), F.lit(2))
    return F.when((third == 0) & (F.col("request_id") % 50 == 0), 2).otherwise(third)


def priority_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of order keys per priority, cut at every key that is a multiple of 97 or below 100."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pid"), F.col("o_orderkey").alias("x"))
    whole = orders.groupBy("pid").agg(F.min("x").alias("start_seq"), (F.max("x") + 1).alias("end_seq"))
    return split_ranges(whole, orders.filter("x % 97 = 0 or x < 100"))
