"""Extraction: pages and selectors to items, links, banners and series.

Pages are indexed once (:mod:`gleaner.operators.elements`). Everything here is a narrow
projection or generator over that table, whatever the number of selectors, and a page's
elements are dropped as soon as the items are out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup, text, urls
from gleaner.functions.keys import seconds_after
from gleaner.functions.sqltext import each, let
from gleaner.operators.elements import index_pages, is_indexed


@dataclass(frozen=True)
class Selector:
    """A selector known when the plan is built."""

    xpath: str
    extract: int = 0
    wrap: int = 0
    item_limit: int = -1


def mask_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the raw page by markup in which every tag is one; enough to read its links."""
    return pages.withColumn("markup", markup.prepare(html)).drop(html)


def prepare_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the raw page by what selectors read; pages that are indexed stay as they are."""
    return pages if is_indexed(pages) else index_pages(pages, html)


def _subvalues(match: str, sub_steps: Sequence[list] | str) -> Column:
    """For each sub-selector, the blank-free text of what it selects inside a match."""

    def joined(steps: list | str) -> str:
        found = markup.inner_sql(match, steps)
        texts = each(found, lambda e: text.nonblank_sql(markup.text_sql(f"{match}.texts", e, f"{match}.el")))
        return f"array_join({texts}, '')"

    if isinstance(sub_steps, str):
        return F.expr(each(sub_steps, joined))
    values = ", ".join(joined(steps) for steps in sub_steps)
    return F.expr(f"CAST(array({values}) AS ARRAY<STRING>)")


def match_selectors(
    prepared: DataFrame, selectors: Sequence[Selector] | DataFrame, key: str = "material_id", inside: bool = False
) -> DataFrame:
    """One row per (page, selector) with the matched ``elements``; the page itself is gone.

    Selectors given as a list are applied in one pass over the page. Those of a table are
    gathered into one row per ``key`` and join the pages once, so that a page is not repeated
    for each of its selectors; Spark picks the join by size. Matches keep what is inside them
    with ``inside``, or where a row of the table has sub-selectors or a link selector.
    """
    kept = [c for c in prepared.columns if c != "markup"]
    if isinstance(selectors, DataFrame):
        columns = [c for c in selectors.columns if c != key]
        gathered = selectors.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("selectors"))
        joined = prepared.join(gathered, key)

        def found(s: str) -> str:
            fields = ", ".join(f"'{c}', {s}.{c}" for c in columns)
            needed = [f"{s}.link_steps IS NOT NULL"] if "link_steps" in columns else []
            needed += [f"size({s}.sub_steps) > 0"] if "sub_steps" in columns else []
            steps = f"coalesce({s}.link_steps, {s}.steps)" if "link_steps" in columns else f"{s}.steps"
            elements = markup.matches_sql("markup", steps, " OR ".join(needed) or "false")
            return f"named_struct({fields}, 'elements', {elements})"

        return joined.select(*kept, F.inline(F.expr(each("selectors", found))))
    entries = [
        F.struct(
            F.lit(number).alias("selector_no"),
            F.lit(s.extract).alias("extract"),
            F.lit(s.wrap).alias("wrap"),
            F.lit(s.item_limit).alias("item_limit"),
            F.expr(markup.matches_sql("markup", markup.parse_steps(s.xpath), str(inside).lower())).alias("elements"),
        )
        for number, s in enumerate(selectors, 1)
    ]
    return prepared.select(*kept, F.inline(F.array(*entries)))


def _numbered(matched: DataFrame, limited: bool = False) -> DataFrame:
    """One row per element, numbered from 0 within its page and selector."""
    elements = F.col("elements")
    if limited:
        bound = F.col("item_limit")
        elements = F.when(
            bound >= 0, F.slice(elements, F.lit(1), bound)
        ).otherwise(elements)
    kept = [c for c in matched.columns if c not in ("elements", "item_limit")]
    return matched.select(*kept, F.posexplode(elements).alias("idx", "element"))


def _value() -> Column:
    return F.col("element.text")


def _href(base: str, when: Column | None = None) -> Column:
    """Absolute href of the element, if it has one."""
    raw = markup.attribute_sql("element.open", "href")
    found = F.expr(let(raw, lambda h: f"if({h} IS NULL, NULL, {urls.abs_url_sql(base, h)})"))
    return found if when is None else F.when(when, found)


def _finish(rows: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    gone = {"idx", "element", "extract", "wrap", *drop}
    return rows.select(*[c for c in rows.columns if c not in gone])


def subscribe_items(matched: DataFrame, base: str = "url") -> DataFrame:
    """Items with value, fingerprint and the href of any element that has one; limit applied."""
    rows = _numbered(matched, limited=True)
    rows = rows.withColumns(
        {
            "no": F.col("idx") + 1,
            "value": _value(),
            "href": _href(base),
        }
    )
    return _finish(rows.withColumn("hashcode", text.fingerprint(F.col("value"))))


def mass_items(matched: DataFrame, base: str = "url") -> DataFrame:
    """List items: an empty value has an empty fingerprint, hrefs only where asked for."""
    rows = _numbered(matched).withColumns(
        {
            "no": F.col("idx") + 1,
            "value": _value(),
            "href": _href(base, F.col("extract") == 1),
        }
    )
    blank = F.when(F.col("value") == "", F.lit("")).otherwise(text.fingerprint(F.col("value")))
    return _finish(rows.withColumn("hashcode", blank))


def wrapped_items(matched: DataFrame) -> DataFrame:
    """All matches of a selector on a page as one item; a page without a match gives empty text."""
    gone = ("elements", "extract", "wrap", "item_limit")
    rows = matched.withColumns({"no": F.lit(1), "value": F.array_join("elements.text", "")})
    rows = rows.withColumn("hashcode", text.fingerprint(F.col("value")))
    return rows.select(*[c for c in rows.columns if c not in gone])


def phased_items(
    matched: DataFrame, sub_steps: Sequence[list] | str = (), base: str = "url"
) -> DataFrame:
    """Items of the phased crawl: blank-free value, fingerprint of the text before that.

    Sub-selectors need matches that keep what is inside them.
    """
    rows = _numbered(matched).withColumn("text", _value())
    rows = rows.withColumns(
        {
            "no": F.col("idx") + 1,
            "value": text.nonblank(F.col("text")),
            "hashcode": text.fingerprint(F.col("text")),
            "subvalues": _subvalues("element", sub_steps),
            "href": _href(base, F.col("extract") == 1),
        }
    )
    return _finish(rows, ["text"])


def page_links(masked: DataFrame, base: str = "url") -> DataFrame:
    """Every non-empty ``<a href>`` of a page (:func:`mask_pages`), in page order, raw and resolved."""
    kept = [c for c in masked.columns if c != "markup"]
    hrefs = each(markup.link_tags_sql("markup"), lambda tag: markup.attribute_sql(tag, "href"))
    filled = F.filter(F.expr(hrefs), lambda href: href != "")
    rows = masked.select(*kept, F.posexplode(filled).alias("no", "href"))
    return rows.withColumn("link", urls.abs_url(base, "href"))


def selected_links(matched: DataFrame) -> DataFrame:
    """Raw hrefs of the elements a selector picks."""
    rows = _numbered(matched)
    rows = rows.withColumn("href", markup.attribute("element.open", "href"))
    return _finish(rows.filter("href is not null").withColumn("no", F.col("idx")))


def _first_src(match: str, steps: list | str) -> Column:
    """Source of the first image selected inside a match that has one."""
    found = markup.inner_sql(match, steps)
    sources = each(found, lambda e: markup.attribute_sql(f"{e}.open", "src"))
    return F.try_element_at(F.filter(F.expr(sources), lambda s: s.isNotNull()), F.lit(1))


def banner_items(
    matched: DataFrame, image: str | None = None, base: str = "url"
) -> DataFrame:
    """Images, numbered from 0: either the matches themselves or the image inside each match.

    ``image`` is the selector of the image inside a link; the matches must keep what is inside
    them. Matches without an image source give no row but keep their number, so gaps count them.
    """
    rows = _numbered(matched)
    own = markup.attribute("element.open", "src")
    if image is None:
        source, link = own, F.lit(None).cast("string")
    else:
        source = _first_src("element", markup.parse_steps(image))
        link = _href(base)
    rows = rows.withColumn("src", source).filter("src is not null")
    rows = rows.withColumns(
        {
            "no": F.col("idx"),
            "imgsrc": urls.abs_url(base, "src"),
            "link": link,
        }
    )
    rows = rows.withColumns(
        {
            "imgname": urls.file_name(F.col("imgsrc")),
            "domain": urls.registered_domain(F.col("imgsrc")),
        }
    )
    return _finish(rows, ["src"])


def asset_manifest(banners: DataFrame) -> DataFrame:
    """Distinct assets with the path each is to be stored at."""
    return banners.select(
        "domain",
        "imgname",
        "imgsrc",
        F.concat_ws("/", "domain", "imgname").alias("target"),
    ).distinct()


def _text_lists(selector: str, known: bool) -> Column:
    """For each match, the list of its text nodes as they stand."""
    steps = markup.parse_steps(selector) if known else selector
    return F.expr(each(markup.select_sql("markup.elements", steps), lambda e: markup.node_list_sql("markup", e)))


def series_items(
    prepared: DataFrame,
    y: str,
    x: str | None = None,
    start: Column | None = None,
    known: bool = True,
) -> DataFrame:
    """Series points by position: text lists paired with text lists or with a time axis.

    With ``start`` the axis starts there and advances a second per point; ``x`` selects a
    text axis. The longer axis sets the length. With ``known=False`` the axes are columns
    of steps, which may be NULL per row.
    """
    kept = [c for c in prepared.columns if c != "markup"]
    lists = F.array().cast("array<array<string>>")
    xs = lists if x is None else F.coalesce(_text_lists(x, known), lists)
    zipped = F.arrays_zip(_text_lists(y, known).alias("y"), xs.alias("x"))
    points = prepared.select(*kept, F.posexplode(zipped).alias("pos", "point"))
    at = F.lit(None).cast("timestamp") if start is None else seconds_after(start, F.col("pos"))
    return points.select(
        *kept, "pos", F.col("point.y").alias("y"), at.alias("x_ts"), F.col("point.x").alias("x")
    )


Collector = Callable[[DataFrame], DataFrame]


def dispatch(tasks: DataFrame, collectors: dict[int, Collector]) -> DataFrame:
    """Send each task type to its collector and union what they give.

    A type without a collector yields no rows. Each branch filters on ``type`` first, so
    a landing table partitioned by type is read once in total.
    """
    branches = [
        collector(tasks.filter(F.col("type") == number)).withColumn("type", F.lit(number))
        for number, collector in sorted(collectors.items())
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch, allowMissingColumns=True)
    return out


def collect_definitions(matched: DataFrame, base: str = "url") -> DataFrame:
    """Items of table-driven selectors, all collector types in one pass over the pages.

    Type 1 gives list items or, with ``wrap``, one item per selector; type 2 images;
    type 3 limited items. Other types give no rows.
    """
    wrapped = (F.col("type") == 1) & (F.col("wrap") == 1)
    first = F.try_element_at("elements", F.lit(1))
    whole = F.transform(F.array(first), lambda e: e.withField("open", F.lit("")).withField("text", F.array_join("elements.text", "")))
    empty = F.expr(f"CAST(array(named_struct('el', 0, 'end', 0, 'idx', 0, 'level', 0, 'open', '', 'text', '', 'inside', array(), 'texts', array())) AS {markup.MATCHES})")
    elements = (
        F.when(wrapped & (F.size("elements") > 0), whole)
        .when(wrapped, empty)
        .when(
            (F.col("type") == 3) & (F.col("item_limit") >= 0),
            F.slice("elements", F.lit(1), F.col("item_limit")),
        )
        .when(F.col("type").isin(1, 2, 3), F.col("elements"))
    )
    rows = _numbered(matched.withColumn("elements", elements))
    is_image = F.col("type") == 2
    rows = rows.withColumns(
        {
            "no": F.col("idx") + F.when(is_image, 0).otherwise(1),
            "value": F.when(~is_image, _value()),
            "href": _href(base, ~is_image & ((F.col("type") == 3) | (F.col("extract") == 1))),
            "src": F.when(
                is_image & F.col("link_steps").isNotNull(),
                _first_src("element", "steps"),
            ).when(is_image, markup.attribute("element.open", "src")),
            "link": _href(base, is_image & F.col("link_steps").isNotNull()),
        }
    ).filter(~is_image | F.col("src").isNotNull())
    rows = rows.withColumns(
        {
            "hashcode": F.when((F.col("type") == 1) & ~wrapped & (F.col("value") == ""), F.lit(""))
            .otherwise(text.fingerprint(F.col("value"))),
            "imgsrc": F.when(is_image, urls.abs_url(base, "src")),
        }
    )
    rows = rows.withColumns(
        {
            "imgname": urls.file_name(F.col("imgsrc")),
            "domain": urls.registered_domain(F.col("imgsrc")),
        }
    )
    phase = ["phase"] if "phase" in rows.columns else []
    return rows.select(
        "material_id", "url", "type", *phase, "selector_no", "no", "value", "hashcode", "href",
        "imgsrc", "link", "imgname", "domain",
    )


def collect_series(prepared: DataFrame, series: DataFrame, start: Column) -> DataFrame:
    """Points of table-driven series (type 4), each on the axis its definition asks for."""
    joined = prepared.join(series, "material_id")
    clock = F.when(F.col("time_axis"), start)
    points = series_items(joined, "y_steps", "x_steps", clock, known=False)
    return points.drop("y_steps", "x_steps", "time_axis")
