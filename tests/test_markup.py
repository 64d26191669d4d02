import html as stdlib_html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup, text
from gleaner.operators.elements import index_pages
from gleaner.operators.extract import Selector, match_selectors

PAGE = """<html><head><meta http-equiv="Content-Type" content="text/html; charset=GBK">
<script>var a="<p>x</p>&lt;<!-- q -->";</script></head><body><!-- <p>no <script> -->
<div class="a"><div class='b' title="x>y">in <b>bold</b><!-- c --> z</div>out</div>
<ul><li>1<ul><li>2</li></ul></li><li><A HREF=/q?x=1&amp;y=2>L &eacute;&#8364; &nbsp;</A></ul>
<p>one<p>two <br>three</p><table><tr><td>c1<td>c2<table><tr><td>in</table></table>
<a href='/s'>x<div>y</div>z</a><span>s<span>t</span>u</span><p><b>open<br></body></html>"""

EXPECTED = {
    "//div": ["inboldzout", "inboldz", "y"],
    "//div[@class='b']": ["inboldz"],
    "//div[@title]": ["inboldz"],
    "//div[contains(@class,'b')]/b": ["bold"],
    "//div//b": ["bold"],
    "//li": ["12", "2", "L é€"],
    "//ul/li": ["12", "2", "L é€"],
    "//ul//li": ["12", "2", "L é€"],
    "//ul/li/a": ["L é€"],
    "//li/ul/li": ["2"],
    "//p": ["one", "twothree", "open"],
    "//script": ['var a="<p>x</p>&lt;<!-- q -->";'],
    "//a": ["L é€", "xyz"],
    "//td": ["c1", "c2in", "in"],
    "//span": ["stu", "t"],
    "//b": ["bold", "open"],
    "//br": ["", ""],
    "//video": [],
}


@pytest.fixture(scope="module")
def page(spark):
    rows = spark.createDataFrame([(PAGE,)], "html string")
    return rows.select(markup.prepare("html").alias("markup")).cache()


@pytest.fixture(scope="module")
def indexed(spark):
    return index_pages(spark.createDataFrame([(PAGE,)], "html string"))


def texts(steps):
    return F.expr(f"transform({markup.matches_sql('markup', steps)}, m -> m.text)")


@pytest.mark.parametrize("xpath", list(EXPECTED))
def test_selectors_known_and_as_data(indexed, xpath):
    known = indexed.select(texts(markup.parse_steps(xpath)).alias("t"))
    as_data = (
        indexed.withColumn("xpath", F.lit(xpath))
        .withColumn("steps", markup.step_column("xpath"))
        .select(texts("steps").alias("t"))
    )
    for found in (known, as_data):
        assert found.first().t == EXPECTED[xpath]


@pytest.mark.parametrize("xpath", ["//a[1]", "//*", "a", "//a/@href", "//a[@x='1' and @y]", ""])
def test_unsupported_selectors_are_refused(spark, xpath):
    with pytest.raises(markup.UnsupportedSelector):
        markup.parse_steps(xpath)
    row = spark.createDataFrame([(xpath,)], "x string").select(markup.step_column("x").alias("s"))
    assert row.first().s is None


def test_steps_parsed_alike(spark):
    paths = ["//a", "./b", ".//p", "/html/body", "//div[@id=\"x y\"]", "//a[@href]",
             "//i[contains(@class, 'k')]"]
    rows = spark.createDataFrame([(p,) for p in paths], "x string")
    for row in rows.withColumn("s", markup.step_column("x")).collect():
        want = [(s.axis, s.tag, s.attr, s.test, s.value) for s in markup.parse_steps(row.x)]
        assert [tuple(s)[:5] for s in row.s] == want


def test_attributes(spark):
    tags = {
        '<a data-href="no" href="/y?a=1&amp;b=2">': "/y?a=1&b=2",
        "<a title='href=z' HREF = '/q'>": "/q",
        "<a href=/bare>": "/bare",
        "<a href>": "",
        '<a href="">': "",
        "<a name=x>": None,
        '<a title="x href=no">': None,
    }
    rows = spark.createDataFrame([(t,) for t in tags], "t string")
    got = {r.t: r.v for r in rows.withColumn("v", markup.attribute("t", "href")).collect()}
    assert got == tags


def test_links_ignore_comments_and_scripts(page):
    tags = page.select(markup.link_tags("markup").alias("t")).first().t
    assert tags == ["<A HREF=/q?x=1&amp;y=2>", "<a href='/s'>"]


@pytest.mark.parametrize(
    "head, want",
    [
        ('<meta charset="GBK">', "GBK"),
        ("<meta charset=big5>", "big5"),
        ('<META HTTP-EQUIV="content-type" CONTENT="text/html; charset=GB2312">', "gb2312"),
        ('<meta http-equiv="Content-Type" content="text/html; charset=a"><meta charset="b">', "b"),
        ('<meta name="d" content="charset=no">', "utf-8"),
        ("", "utf-8"),
        ('<!-- <meta charset="no"> -->', "utf-8"),
    ],
)
def test_charset(spark, head, want):
    rows = spark.createDataFrame([(f"<head>{head}</head>",)], "h string")
    assert rows.select(markup.charset_of(markup.prepare_sql("h")).alias("c")).first().c == want


def test_entities_agree_with_standard_library(spark):
    samples = ["a &lt;b&gt; &amp;amp; &amp;lt; &#38;lt;", "&eacute;&copy;&#8364;&#x1F600;", "&nope; & &;",
               "&quot;x&quot; &middot; &#xE9; &#0233;", "plain"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    for row in rows.withColumn("d", F.expr(text.decode_entities_sql("s"))).collect():
        assert row.d == stdlib_html.unescape(row.s)


def test_node_text_agrees_with_tag_by_tag_strip(spark):
    samples = ["  a <b> c </b> d ", "x<br>\n y", "a < b", "<i title='>'>k</i> l", " q　",
               "t<a b=\"'\" c='>'> u </a>v", "<<p>w", "plain", "", "a<!>b<br/> c&amp;d "]

    def want(value):
        nodes = re.split(r"""<(?=[A-Za-z/!?])(?:[^>"']|"[^"]*"|'[^']*')*>""", value)
        return stdlib_html.unescape("".join(n.strip() for n in nodes))

    rows = spark.createDataFrame([(s,) for s in samples], "s string")
    whole = F.expr(f"array_join({markup.stripped_sql(markup.nodes_sql('s'))}, '')")
    for row in rows.withColumn("t", whole).collect():
        assert row.t == want(row.s), row.s


def test_blank_helpers(spark):
    raw = "  a\x1cb 　c\n"
    row = spark.createDataFrame([(raw,)], "s string").select(
        text.nonblank(F.col("s")).alias("dense"), text.strip(F.col("s")).alias("stripped")
    ).first()
    assert row.dense == "".join(re.findall(r"\S+", raw)) and row.stripped == raw.strip()


def test_decode_native_and_other(spark):
    rows = [
        ("utf-8", "é".encode(), "é"), ("UTF8", b"\xff", None), ("latin1", b"\xe9", "é"),
        ("ascii", b"\xe9", None), ("ascii", b"ok", "ok"), ("gbk", "中文".encode("gbk"), "中文"),
        ("gbk", b"\xff\xff", None), ("nonsense", b"x", None),
    ]
    from gleaner.sources.landing import decoded

    df = spark.createDataFrame(
        [(i, c, b) for i, (c, b, _) in enumerate(rows)], "id int, charset string, body binary"
    )
    got = {r.id: r.html for r in decoded(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(rows)}


def tree(html):
    """Elements of well-formed markup by a stack: (name, end tag number, level) by tag number."""
    from html.parser import HTMLParser

    out, stack, n = {}, [], 0

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            nonlocal n
            n += 1
            out[n] = [tag, n, len(stack)]
            if tag not in markup.VOID_TAGS:
                stack.append(n)

        def handle_endtag(self, tag):
            nonlocal n
            n += 1
            out[stack.pop()][1] = n

    Reader().feed(html)
    return {k: tuple(v) for k, v in out.items()}


def test_intervals_equal_those_of_a_stack(spark):
    rng = random.Random(7)
    inline = ["t", "t<br>u", "<video>v</video>", "<span>s<span>t</span></span>", "<code>c</code><img src=x>"]
    lists = {"ul": "li", "dl": "dd", "select": "option", "table": "tr"}

    def grow(depth):
        parts = []
        for _ in range(rng.randint(0, 4)):
            name = rng.choice("div section article video ul dl select table span b a em p h2".split())
            if name in lists:
                inner = "".join(f"<{lists[name]}>{rng.choice(inline[:2] if name == 'select' else inline)}</{lists[name]}>" for _ in range(rng.randint(0, 3)))
                if name != "select":
                    inner = inner.replace("t<br>u", grow(depth - 1) if depth else "t")
            elif name in ("div", "section", "article", "video"):
                inner = grow(depth - 1) if depth else "t"
            else:
                inner = rng.choice(inline)
            parts.append(f"<{name}>{inner}</{name}>")
        return "".join(parts)

    pages = ["<html><body>" + grow(3) + grow(3) + "</body></html>" for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(pages)), "n int, html string").repartition(3)
    for r in index_pages(rows).collect():
        got = {e.el: (e.name, e.end, e.level) for e in r.markup.elements}
        assert got == tree(pages[r.n]), pages[r.n]
        assert [e.idx for e in r.markup.elements] == list(range(1, len(got) + 1))


def test_open_items_and_overlapping_tags(spark):
    """Items, cells and paragraphs that nothing closes are siblings, not children."""
    html = "<ul><li>1<li>2<ul><li>3</ul><li>4</ul><table><tr><td>a<td>b<tr><td>c</table><p>x<div>y<b>z</div>w<p>v"
    one = index_pages(spark.createDataFrame([(html,)], "html string"))
    found = one.select(*[F.expr(f"transform({markup.matches_sql('markup', markup.parse_steps(x))}, m -> m.text)").alias(x[2:].replace("/", "_"))
                         for x in ("//ul/li", "/ul/li", "//tr/td", "//p", "//div/b")]).first()
    assert list(found) == [["1", "23", "3", "4"], ["1", "23", "4"], ["a", "b", "c"], ["x", "v"], ["z"]]


def test_pages_that_are_empty_equal_or_null(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no tags"), (4, "<p>a"), (4, "<p>a"), (5, "<p " * 50)], "n int, html string")
    got = sorted((r.n, len(r.markup.elements), "".join(r.markup.texts)) for r in index_pages(pages).collect())
    assert got[:5] == [(1, 0, ""), (2, 0, ""), (3, 0, "no tags"), (4, 1, "a"), (4, 1, "a")]


def test_ten_selectors_cost_little_more_than_one(spark):
    html = "<html><body>" + "<div class='k'><ul><li><a href='/x'>t</a></li></ul><p>u<b>v</b></p></div>" * 400 + "</body></html>"
    pages = index_pages(spark.createDataFrame([(html,)] * 16, "html string"))
    ten = ["//div", "//ul", "//li", "//a", "//p", "//b", "//li/a", "//div[@class='k']", "//body/div", "//ul//a"]

    def seconds(xpaths):
        made = match_selectors(pages, [Selector(x) for x in xpaths]).select("selector_no", F.size("elements").alias("n"))
        start = time.perf_counter()
        made.agg(F.sum("n")).collect()
        return time.perf_counter() - start

    def cut():
        start = time.perf_counter()
        index_pages(spark.createDataFrame([(html,)] * 16, "html string"))
        return time.perf_counter() - start

    seconds(ten), cut()
    one, all_ten, index = (min(f() for _ in range(2)) for f in (lambda: seconds(ten[:1]), lambda: seconds(ten), cut))
    assert index + all_ten < 2 * (index + one)
