import re
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from gleaner.functions import urls

BASE = "https://m.x.example.net/en/25/p?q=1#top"
JOINED = {
    "/a": "https://m.x.example.net/a",
    "/a#frag": "https://m.x.example.net/a",
    "a": "https://m.x.example.net/en/25/a",
    "./a/": "https://m.x.example.net/en/25/a/",
    "../a": "https://m.x.example.net/en/a",
    "../../../a": "https://m.x.example.net/a",
    "?z=1": "https://m.x.example.net/en/25/p?z=1",
    "#f": BASE,
    "": BASE,
    "//h.com/z": "https://h.com/z",
    "HTTP://A.com/x#f": "HTTP://A.com/x#f",
    "mailto:a@b": "mailto:a@b",
    "javascript:void(0)": "javascript:void(0)",
    "ftp://x/y#z": "ftp://x/y",
}
DOMAINS = {
    "https://www.foo.com.cn/x": "foo.com",
    "https://www.tsinghua.edu.cn": "tsinghua.edu.cn",
    "http://a.gov.cn": "a.gov.cn",
    "http://a.net.cn": "a.net",
    "http://a.org.cn": "a.org",
    "http://blog.community.com": "blog.com",
    "http://m.netflix.com": "m.net",
    "http://localhost/?u=foo.com": "foo.com",
    "http://x.eduxcn": "x.eduxcn",
    "http://foo.io/x": None,
}
BASES = [BASE, "http://h.com", "http://h.com/", "https://a.b/c/d/", "http://h.com/a//b/c",
         "http://u:p@h.com:80/x?y#z"]
REFS = [*JOINED, "a//b", "/a//b/../c", "..", ".", "a?", "?", "http:foo", "HTTPS:foo/../x",
        "a/b/../../c?x=../y", "/..", "/.", "a/..", "./", "../", "//h.com", "a;b?c", "/a/./b/",
        "tel:1", "x/y:z", "/é ü", "?a?b", "a?b?c#d", "/a.b/c.d", "/a..b"]


def test_join_table(spark):
    rows = spark.createDataFrame([(BASE, r) for r in JOINED], "base string, ref string")
    got = {r.ref: r.link for r in rows.withColumn("link", urls.abs_url("base", "ref")).collect()}
    assert got == JOINED


def test_join_agrees_with_standard_library(spark):
    def want(base, ref):
        absolute = ref.lower().startswith(("http://", "https://"))
        return ref if absolute else urljoin(base, urldefrag(ref)[0])

    pairs = [(b, r) for b in BASES for r in REFS]
    rows = spark.createDataFrame(pairs, "base string, ref string")
    got = rows.withColumn("link", urls.abs_url("base", "ref")).collect()
    assert {(r.base, r.ref): r.link for r in got} == {p: want(*p) for p in pairs}


def test_domains(spark):
    alternatives = "|".join(r"[A-Za-z0-9\-]+\." + e for e in urls.DOMAIN_ENDINGS)
    rows = spark.createDataFrame([(u,) for u in DOMAINS], "url string")
    got = {r.url: r.d for r in rows.withColumn("d", urls.registered_domain(F.col("url"))).collect()}
    assert got == DOMAINS
    for url, found in got.items():
        match = re.search(alternatives, url.lower())
        assert found == (match.group() if match else None)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.foo.com.cn/x", "foo.com.cn"),
        ("http://m.netflix.com", "netflix.com"),
        ("http://localhost/?u=foo.com", None),
    ],
)
def test_strict_domain(spark, url, want):
    row = spark.range(1).select(urls.registered_domain(F.lit(url), strict=True).alias("d")).first()
    assert row.d == want


def test_small_url_functions(spark):
    row = (
        spark.createDataFrame([("http://U@Ho.st:8/a/b.png?x=1#f",)], "u string")
        .select(
            urls.strip_fragment(F.col("u")).alias("bare"),
            urls.file_name(F.col("u")).alias("name"),
            urls.host_of(F.col("u")).alias("host"),
        )
        .first()
    )
    assert tuple(row) == ("http://U@Ho.st:8/a/b.png?x=1", "b.png?x=1#f", "ho.st")
