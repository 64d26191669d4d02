"""Element tables: every element of a page as an interval of its tags.

A page is cut into tags and texts by one pattern each, whatever will be asked of it. Its tags
become rows; running sums over them give the depth in containers, and one more pass from the
end tells each open tag which tag ends it:

* Tags that may end one another share a *scope*, a key and a depth. A tag enters its own scope
  and those of the groups in which it closes something, as an event or asking for one.
* Within a scope, read backwards, the last event of each kind is the next one in the page.

Begin, end and the number of elements around it make an element; a page row then holds its
elements in order, so that what lies inside an element follows it in the list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions.sqltext import raw
from gleaner.session import cut_lineage, run_dir

#: Kinds of events in a scope (in that of rows, OTHER is a cell), and a tag without content.
OWN, OTHER, BLOCK_END, ALONE = 1, 2, 4, 8
#: Depths that are summed: in blocks, and in the containers of each group of siblings.
DEPTHS = ["blocks", *markup.SIBLING_GROUPS]
#: Tags that are sorted in one task, some 2 KB of memory each in all the sorts; a page stays in one task.
TAGS_A_TASK = 50_000
_SELF_CLOSED = r"""(?:["'\s]|^<[A-Za-z][A-Za-z0-9\-]*)/>$"""
_NAME = r"^</?([A-Za-z][^\s/>]*)"


def _tags(pages: DataFrame) -> DataFrame:
    """``page_no, behind, pos, name, closing, alone`` of each tag that has a name."""
    tag = F.col("tag")
    rows = pages.select("page_no", "behind", F.posexplode("tags").alias("at", "tag"))
    rows = rows.select(
        "page_no",
        "behind",
        (F.col("at") + 1).alias("pos"),
        F.lower(F.regexp_extract(tag, _NAME, 1)).alias("name"),
        tag.startswith("</").alias("closing"),
        (tag.endswith("/>") & tag.rlike(_SELF_CLOSED)).alias("slashed"),
    )
    void = F.col("name").isin(markup.VOID_TAGS)
    return rows.filter("name <> ''").withColumn("alone", ~F.col("closing") & (void | F.col("slashed"))).drop("slashed")


def _enters(name: str, kind: str) -> list[tuple[str, str, int, int]]:
    """The scopes of a tag ("*": of any other name) as ``key, depth, event, asks``.

    ``key`` "*" stands for its name, ``depth`` names the sum that counts there; ``event`` is what
    the tag is for others, ``asks`` are the events it waits for, as bits.
    """
    closing = kind == "close"

    def asks(bits: int) -> int:
        return 0 if closing else ALONE if kind == "alone" else bits

    grouped = [*markup.CELLS, *(t for members, _, _ in markup.SIBLING_GROUPS.values() for t in members)]
    font = name in markup.FONT_TAGS
    found = []
    if name in markup.FLAT_TAGS:
        found.append(("*", "none", OWN, asks(OWN)))
    elif name == "a" or font:
        found.append(("*", "blocks", OWN, asks(OWN)))
    elif name != "p" and name not in grouped:
        found.append(("*", "own", OWN if closing else 0, asks(OWN)))
    if name in markup.PARAGRAPH_BOUNDARIES:
        found.append(("#p", "none", OWN, asks(OWN) if name == "p" else 0))
    for group, (members, others, containers) in markup.SIBLING_GROUPS.items():
        cell = group == "tr" and name in markup.CELLS
        if cell:
            found.append((f"#{group}", group, OTHER, asks(OWN | OTHER)))
        elif name in [*members, *others] or (name in containers and closing):
            found.append((f"#{group}", group, OWN, asks(OWN) if name in members else 0))
    event = BLOCK_END if closing and name in markup.BLOCKS else {"p": OTHER, "center": OWN}.get(name, 0)
    inline = BLOCK_END if name == "a" else BLOCK_END | OTHER | OWN if font else BLOCK_END | OTHER
    waits = asks(inline) if name == "a" or font or name in markup.PHRASE_TAGS else 0
    found.append(("#b", "blocks", event, waits))
    return [x for x in found if x[2] or x[3]]


def _steps(name: str, kind: str) -> list[int]:
    """What a tag adds to the depth in blocks and in the containers of each group."""
    sets = [markup.BLOCKS, *(containers for _, _, containers in markup.SIBLING_GROUPS.values())]
    return [{"open": 1, "close": -1, "alone": 0}[kind] * (name in names) for names in sets]


def rule_names() -> list[str]:
    """Tag names that have rules of their own."""
    groups = markup.SIBLING_GROUPS.values()
    names = {
        "a", "p", "center", *markup.FLAT_TAGS, *markup.FONT_TAGS, *markup.PHRASE_TAGS, *markup.BLOCKS, *markup.CELLS,
        *markup.PARAGRAPH_BOUNDARIES, *(t for group in groups for names in group for t in names),
    }
    return sorted(names)


def _rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Scopes and depth steps by ``rule, kind``: small tables over :func:`rule_names` and "*"."""
    each_kind = [(n, k) for n in [*rule_names(), "*"] for k in ("open", "close", "alone")]
    scopes = [(n, k, *entry) for n, k in each_kind for entry in _enters(n, k)]
    steps = [(n, k, *_steps(n, k)) for n, k in each_kind]
    counted = ", ".join(f"d_{c} int" for c in DEPTHS)
    return (
        spark.createDataFrame(scopes, "rule string, kind string, key string, depth_of string, event int, asks int"),
        spark.createDataFrame(steps, f"rule string, kind string, {counted}"),
    )


def element_rows(pages: DataFrame) -> DataFrame:
    """``page_no, el, end, level`` of each element of ``page_no, tags``.

    ``el`` and ``end`` count the tags of the page from 1; an element without content ends at
    its own tag, and one that nothing ends at the tag after the last. ``level`` counts the
    elements around it. Pages meet in one shuffle; everything after it sorts within it, in as
    many tasks as the number of tags asks for: partitions by bytes would hold all that fits them.
    """
    scopes, steps = _rules(pages.sparkSession)
    known = rule_names()
    tags = pages.agg(F.sum(F.size("tags"))).first()[0] or 0
    tasks = max(1, -(-tags // TAGS_A_TASK))
    spread = pages.select("page_no", (F.size("tags") + 1).alias("behind"), "tags").repartition(tasks, "page_no")
    kind = F.when(F.col("closing"), "close").when(F.col("alone"), "alone").otherwise("open")
    ruled = _tags(spread).withColumns({"kind": kind, "rule": F.when(F.col("name").isin(known), F.col("name")).otherwise("*")})
    # both tables hold the tag names of the standard
    ruled = ruled.join(F.broadcast(steps), ["rule", "kind"])
    # every window below is over a page: scopes follow one another in it, and a change of scope shows
    page = Window.partitionBy("page_no")
    earlier = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = ruled.select(
        "page_no", "behind", "pos", "name", "kind", "rule",
        *[F.coalesce(F.sum(f"d_{c}").over(earlier), F.lit(0)).alias(f"s_{c}") for c in DEPTHS],
    )
    by_name = page.orderBy("name", "pos")
    change = F.when(F.col("kind") == "close", -1).when(F.col("kind") == "open", 1).otherwise(0)
    summed = summed.withColumns(
        {
            "first": ~F.lag("name").over(by_name).eqNullSafe(F.col("name")),
            "run": F.coalesce(F.sum(change).over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    base = F.last(F.when(F.col("first"), F.col("run")), ignorenulls=True)
    base = base.over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # an open tag is as deep as the close tag that it meets: after the one, before the other
    summed = summed.withColumn("s_own", F.col("run") - base + F.when(F.col("kind") == "open", 1).otherwise(0))
    depth = F.lit(0)
    for c in ("own", *DEPTHS):
        depth = F.when(F.col("depth_of") == c, F.col(f"s_{c}")).otherwise(depth)
    entered = summed.join(F.broadcast(scopes), ["rule", "kind"]).select(
        "page_no", "behind", "pos", F.when(F.col("key") == "*", F.col("name")).otherwise(F.col("key")).alias("key"),
        depth.cast("int").alias("depth"), "event", "asks",
    )
    later = page.orderBy("key", "depth", F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    scope = F.xxhash64("key", "depth")
    is_event = lambda bit: F.col("event").bitwiseAND(bit) != 0
    bits = (OWN, OTHER, BLOCK_END)
    entered = entered.withColumn("scope", scope)
    nexts = {}
    for bit in bits:
        nexts[f"next_{bit}"] = F.last(F.when(is_event(bit), F.col("pos")), ignorenulls=True).over(later)
        nexts[f"scope_{bit}"] = F.last(F.when(is_event(bit), F.col("scope")), ignorenulls=True).over(later)
    asked = lambda bit: F.col("asks").bitwiseAND(bit) != 0
    reached = [F.when(asked(bit) & (F.col(f"scope_{bit}") == F.col("scope")), F.col(f"next_{bit}")) for bit in bits]
    stop = F.when(asked(ALONE), F.col("pos")).otherwise(F.coalesce(F.least(*reached), F.col("behind")))
    ends = entered.withColumns(nexts).filter("asks > 0").select("page_no", "pos", stop.alias("stop"))
    ends = ends.groupBy("page_no", F.col("pos").alias("el")).agg(F.min("stop").alias("end"))
    holds = F.col("end") > F.col("el")
    marks = F.when(
        holds, F.array(F.struct(F.col("el").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))
    ).otherwise(F.array(F.struct(F.col("el").alias("at"), F.lit(0).alias("step"))))
    order = Window.partitionBy("page_no").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = ends.select("page_no", "el", "end", F.inline(marks)).withColumn("open", F.sum("step").over(order))
    return levels.filter("step >= 0").select("page_no", "el", "end", (F.col("open") - F.col("step")).cast("int").alias("level"))


def index_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``markup`` (:data:`markup.PAGE`) in place of the raw page: a written table.

    Rows are kept as they are, equal ones too; a null or empty page has no elements. Each
    selector, material and crawl round reads this table; nothing is cut twice.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c != html]
    base = run_dir(spark, "page-index")
    masked = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("#")).alias("page"),
        F.coalesce(markup.prepare(html), F.lit("")).alias("masked"),
    )
    cut = masked.select(
        F.monotonically_increasing_id().alias("page_no"),
        "page",
        F.expr(markup.tags_sql("masked")).alias("tags"),
        F.expr(markup.nodes_sql("masked")).alias("nodes"),
    )
    cut = cut.withColumn("texts", F.expr(markup.stripped_sql("nodes")))
    pieces = cut_lineage(cut, "pieces", f"{base}/pieces")
    listed = element_rows(pieces).groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("el", "end", "level"))).alias("found"))
    name = f"lower(regexp_extract(tags[x.el - 1], {raw(_NAME)}, 1))"
    elements = F.expr(
        f"transform(found, (x, i) -> struct(x.el as el, x.end as end, i + 1 as idx, x.level as level, {name} as name, tags[x.el - 1] as open))"
    )
    whole = F.struct("nodes", "texts", F.coalesce(elements, F.array()).alias("elements")).cast(markup.PAGE)
    joined = pieces.join(listed, "page_no", "left")
    return cut_lineage(
        joined.select(*[F.col("page").getField(c).alias(c) for c in kept], whole.alias("markup")), "index", f"{base}/pages"
    )


def is_indexed(pages: DataFrame) -> bool:
    return "markup" in pages.columns and pages.schema["markup"].dataType.typeName() == "struct"
