"""SQL with the meaning of each registered query, for an independent engine.

Markup is handled here by plain regular expressions that fit the given pages; nothing
is shared with the operators but the derived inputs and their parameters.
"""

from __future__ import annotations

from gleaner.functions.urls import DOMAIN_ENDINGS
from gleaner.plans.inputs import DEFINITIONS, EARLY_DAYS, LATE_DAYS, RECAPTURE_DAYS, SITE, START
from gleaner.plans.queries import DAY_CAP, HOUR_CAP, REFERENCE_FORMS

ORACLES: dict[str, str] = {}

DOMAIN = r"[A-Za-z0-9\-]+\.(?:" + "|".join(DOMAIN_ENDINGS) + ")"
BLANKS = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
    r"\x{205f}\x{3000}]+"
)
SEQNO = START.translate(str.maketrans("", "", "-: "))


def domain(url: str) -> str:
    return f"nullif(regexp_extract(lower({url}), '{DOMAIN}'), '')"


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^https?://[^/?#]+')"


def entities(text: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def text_of(markup: str) -> str:
    bare = rf"regexp_replace({markup}, '\s*<[^>]*>\s*', '', 'g')"
    return entities(f"trim({bare}, ' ' || chr(9) || chr(10) || chr(13))")


def dense(text: str) -> str:
    return f"regexp_replace({text}, '{BLANKS}', '', 'g')"


def clean(html: str) -> str:
    return (
        f"regexp_replace(regexp_replace({html}, '(?s)<!--.*?-->', '<!>', 'g'), "
        "'(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    )


PREP = f"prep AS (SELECT page_id, url, {origin('url')} AS origin, {clean('html')} AS m FROM pages)"

# Elements of the given pages, as lists of markup.
LINKS = """regexp_extract_all(m, '<a href="[^"]*">[^<]*</a>')"""
ITEMS = """regexp_extract_all(m, '<li><a href="[^"]*">[^<]*</a></li>')"""
PARAGRAPHS = (
    "list_transform(string_split_regex(m, '<p>')[2:], "
    "lambda s: regexp_extract(s, '(?s)^(.*?)(?:</p>|</article>|$)', 1))"
)
BOLDS = (
    "list_transform(string_split_regex(m, '<b>')[2:], "
    "lambda s: regexp_extract(s, '(?s)^(.*?)(?:</?p>|</b>|</article>|$)', 1))"
)
HEADINGS = "regexp_extract_all(m, '(?s)<h1>(.*?)</h1>', 1)"
ADS = """regexp_extract_all(m, '(?s)<div class="ad">(.*?)</div>', 1)"""
ARTICLES = "regexp_extract_all(m, '(?s)<article>(.*?)</article>', 1)"
BREAKS = "regexp_extract_all(m, '<br>')"


def elements(number: int, found: str, columns: str = "page_id, url, origin", source: str = "prep"):
    """Rows (columns, selector_no, no, el) of one selector."""
    return (
        f"SELECT {columns}, {number} AS selector_no, generate_subscripts(l, 1) AS no, "
        f"unnest(l) AS el FROM (SELECT {columns}, {found} AS l FROM {source})"
    )


def all_elements(*found: str, **options) -> str:
    return " UNION ALL ".join(elements(n, f, **options) for n, f in enumerate(found, 1))


HREF = """regexp_extract(el, '^(?:<li>)?<a href="([^"]*)"', 1)"""
LINK = f"CASE WHEN el LIKE '%<a href=%' AND selector_no IN (@) THEN origin || {HREF} END"


def link(*selectors: int) -> str:
    return LINK.replace("@", ", ".join(map(str, selectors)))


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---- links, items, banners, series -----------------------------------------------------

oracle(
    "extract_links",
    f"""WITH {PREP}, e AS ({elements(1, LINKS)}), l AS (
    SELECT page_id, no - 1 AS no, {HREF} AS href, origin || {HREF} AS link FROM e)
SELECT page_id, no, href, link, {domain('link')} AS site, md5(link) AS link_hash FROM l""",
)
oracle(
    "extract_items",
    f"""WITH {PREP}, e AS ({all_elements(ITEMS, PARAGRAPHS, HEADINGS, ADS, ARTICLES)}), t AS (
    SELECT *, {text_of('el')} AS value FROM e)
SELECT page_id, selector_no, no, value, md5(value) AS hashcode, {link(1)} AS href FROM t""",
)
oracle(
    "extract_items_limit",
    f"""WITH {PREP}, e AS ({all_elements(PARAGRAPHS, ITEMS)})
SELECT page_id, selector_no, no, md5({text_of('el')}) AS hashcode, {link(2)} AS href
FROM e WHERE no <= CASE selector_no WHEN 1 THEN 3 ELSE 2 END""",
)
oracle(
    "extract_items_flagged",
    f"""WITH {PREP}, e AS ({all_elements(ITEMS, LINKS, HEADINGS)}), t AS (
    SELECT *, {text_of('el')} AS value FROM e)
SELECT page_id, selector_no, no, {dense('value')} AS value, md5(value) AS hashcode,
    {link(1)} AS href FROM t""",
)
oracle(
    "extract_nested",
    f"""WITH {PREP}, a AS ({elements(1, ARTICLES)}), s AS (
    SELECT page_id, no, el, el AS m FROM a), t AS (
    SELECT page_id, no, md5({text_of('el')}) AS hashcode, {HEADINGS} AS h, {PARAGRAPHS} AS p,
        {BOLDS} AS b FROM s)
SELECT page_id, no, hashcode,
    {dense(text_of("array_to_string(h, '<!>')"))} || '|' ||
    {dense(text_of("array_to_string(p, '<!>')"))} || '|' ||
    {dense(text_of("array_to_string(b, '<!>')"))} AS subvalues
FROM t""",
)
oracle(
    "extract_links_sel",
    f"""WITH {PREP}, e AS ({elements(1, LINKS)}) SELECT page_id, no - 1 AS no, {HREF} AS href FROM e""",
)
oracle(
    "extract_list",
    f"""WITH {PREP}, e AS ({all_elements(ITEMS, BREAKS, BOLDS)}), t AS (
    SELECT *, {text_of('el')} AS value FROM e)
SELECT page_id, url, selector_no, no, value,
    CASE WHEN value = '' THEN '' ELSE md5(value) END AS hashcode, {link(1)} AS href FROM t""",
)
oracle(
    "extract_wrapped",
    f"""WITH {PREP}, w AS (
    SELECT page_id, 1 AS selector_no, array_to_string({PARAGRAPHS}, '<!>') AS el FROM prep UNION ALL
    SELECT page_id, 2, array_to_string({ITEMS}, '<!>') FROM prep UNION ALL
    SELECT page_id, 3, '' FROM prep), t AS (
    SELECT page_id, selector_no, {text_of('el')} AS value FROM w)
SELECT page_id, selector_no, 1 AS no, value, md5(value) AS hashcode FROM t""",
)

IMAGE = "'/i/' || (page_id // 7)::VARCHAR || '.png'"
BANNERS = f"""b AS (
    SELECT page_id, {origin('url')} || {IMAGE} AS imgsrc, {origin('url')} || '/p/' || page_id AS link,
        (page_id // 7)::VARCHAR || '.png' AS imgname, {domain('url')} AS domain,
        len(regexp_extract_all({clean('html')}, '<a ')) AS links FROM pages)"""
oracle(
    "extract_banner",
    f"WITH {BANNERS} SELECT page_id, links AS no, imgsrc, link, imgname, domain FROM b",
)
oracle(
    "extract_images",
    f"WITH {BANNERS} SELECT page_id, 0 AS no, imgsrc, imgname, domain FROM b",
)
oracle(
    "asset_manifest",
    f"""WITH {BANNERS} SELECT DISTINCT domain, imgname, imgsrc, domain || '/' || imgname AS target
FROM b""",
)


def nodes(markup: str) -> str:
    parts = f"list_filter(string_split_regex({markup}, '<[^>]*>'), lambda s: s <> '')"
    return f"array_to_string(list_transform({parts}, lambda s: {entities('s')}), '|')"


def clock(seconds: str) -> str:
    return (
        f"strftime(TIMESTAMP '{START}' + to_seconds(CAST({seconds} AS BIGINT)), "
        "'%Y-%m-%d %H:%M:%S')"
    )


oracle(
    "extract_series",
    f"""WITH {PREP}, e AS ({elements(1, PARAGRAPHS)})
SELECT page_id, no - 1 AS pos, {clock('no - 1')} AS x_ts, {nodes('el')} AS y FROM e""",
)
oracle(
    "extract_series_text",
    f"""WITH {PREP}, y AS ({elements(1, ITEMS)}), x AS ({elements(1, BOLDS)})
SELECT coalesce(y.page_id, x.page_id) AS page_id, coalesce(y.no, x.no) - 1 AS pos,
    {nodes('y.el')} AS y, {nodes('x.el')} AS x
FROM y FULL JOIN x ON y.page_id = x.page_id AND y.no = x.no""",
)

# ---- definitions and dispatch ----------------------------------------------------------


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


MATERIALS = (
    "mat AS (SELECT 'p1' AS pid, page_id AS material_id, md5(url) AS uuid, "
    "replace(CASE page_id % 5 + 1 "
    + " ".join(f"WHEN {n} THEN {sql_string(d)}" for n, d in DEFINITIONS.items())
    + " END, '@URL', url)::JSON AS definition FROM pages)"
)
oracle(
    "task_project",
    f"""WITH {MATERIALS}, t AS (SELECT *, definition->>'$.addr' AS url FROM mat)
SELECT pid, material_id, uuid, CAST(definition->>'$.type' AS BIGINT) AS type, url,
    {domain('url')} AS domain FROM t""",
)
FLAT = f"""{MATERIALS}, lev AS (
    SELECT material_id, 1 AS phase, definition AS d, definition AS root FROM mat UNION ALL
    SELECT material_id, 2, definition->'$.child', definition FROM mat
    WHERE (definition->'$.child') IS NOT NULL), sel AS (
    SELECT material_id, phase, d, root, unnest(range(json_array_length(d->'$.selectors')::BIGINT)) AS k FROM lev
    WHERE (d->'$.selectors') IS NOT NULL), flat AS (
    SELECT material_id, CAST(coalesce(d->>'$.type', root->>'$.type') AS BIGINT) AS type, phase,
        coalesce(CAST(d->>'$.level' AS BIGINT), phase) AS level,
        coalesce(CAST(d->>'$.wrap' AS BIGINT), 0) AS wrap,
        coalesce(CAST(d->>'$.limit' AS BIGINT), -1) AS item_limit, k + 1 AS selector_no,
        coalesce(CAST(s->>'$.extract' AS BIGINT), 0) AS extract, s->>'$.xpath' AS xpath,
        s->>'$.linkselector.xpath' AS link_xpath
    FROM (SELECT *, json_extract(d->'$.selectors', k) AS s FROM sel))"""
oracle("definition_flatten", f"WITH {FLAT} SELECT *, 1 AS supported FROM flat")
ALL_LINKS = f"""list_append({LINKS}, '<a href="/p/' || page_id || '"></a>')"""
BY_XPATH = f"""e AS (
    {elements(1, ITEMS)} UNION ALL {elements(2, HEADINGS)} UNION ALL {elements(3, PARAGRAPHS)}
    UNION ALL {elements(4, ADS)} UNION ALL {elements(5, ALL_LINKS)}), x AS (
    SELECT *, CASE selector_no WHEN 1 THEN '//li/a' WHEN 2 THEN '//h1' WHEN 3 THEN '//p'
        WHEN 4 THEN '//div[@class=''ad'']' ELSE './img' END AS xpath, {link(1, 5)} AS href FROM e)"""
oracle(
    "page_selector_join",
    f"""WITH {PREP}, {FLAT}, {BY_XPATH}
SELECT material_id, phase, flat.selector_no, xpath, no, md5({text_of('el')}) AS hashcode, href
FROM flat JOIN x USING (xpath) WHERE x.page_id = material_id
    AND (item_limit < 0 OR no <= item_limit)""",
)
DISPATCHED = f"""{PREP}, {FLAT}, {BY_XPATH}, {BANNERS}, y AS ({elements(1, PARAGRAPHS)}), t AS (
    SELECT material_id, type, phase, flat.selector_no, no, {text_of('el')} AS value,
        href, NULL AS imgsrc, NULL AS link, NULL AS imgname, NULL AS domain, NULL AS x_ts
    FROM flat JOIN x USING (xpath) WHERE x.page_id = material_id AND wrap = 0
        AND type IN (1, 3) AND (type = 1 OR no <= item_limit)
    UNION ALL
    SELECT material_id, type, phase, selector_no, 1,
        {text_of(f"array_to_string({PARAGRAPHS}, '<!>')")}, NULL, NULL, NULL, NULL, NULL, NULL
    FROM flat JOIN prep ON page_id = material_id WHERE type = 1 AND wrap = 1), dispatched AS (
SELECT material_id, type, phase, selector_no, no, value, md5(value) AS hashcode, href, imgsrc, link,
    imgname, domain, x_ts FROM t
UNION ALL
SELECT page_id, 2, 1, 1, links, NULL, NULL, NULL, imgsrc, link, imgname, domain, NULL FROM b
WHERE page_id % 5 + 1 = 2
UNION ALL
SELECT page_id, 4, 1, NULL, no - 1, {nodes('el')}, NULL, NULL, NULL, NULL, NULL, NULL,
    {clock('no - 1')} FROM y WHERE page_id % 5 + 1 = 4)"""
oracle("dispatch_by_type", f"WITH {DISPATCHED} SELECT * FROM dispatched")
oracle(
    "harvest_run",
    f"""WITH {DISPATCHED}, h AS (
    SELECT material_id, count(*) AS items, md5(string_agg(coalesce(value, imgsrc), '|'
        ORDER BY phase, coalesce(selector_no, 0), no)) AS hash FROM dispatched GROUP BY 1),
    bound AS (SELECT max(page_id) AS last FROM pages)
SELECT material_id, material_id || strftime(TIMESTAMP '{START}' + to_seconds(material_id), '%Y%m%d%H%M%S') AS seqno,
    'y20s1' AS period, 'p1' AS pid, url, items, hash FROM h JOIN pages ON page_id = material_id, bound
WHERE material_id % 3 <> 0 AND material_id >= last // 4 AND material_id < last - last // 4""",
)
oracle(
    "definition_levels",
    """SELECT page_id AS material_id, phase, 1 AS selector_no, 1 AS type,
    CASE phase WHEN 1 THEN '//h1' WHEN 6 THEN '//b' ELSE '//p' END AS xpath, 1 AS supported
FROM pages, (SELECT unnest(range(1, 7)) AS phase) WHERE page_id % 4 = 0
UNION ALL
SELECT page_id, 1, n, 3, CASE n WHEN 1 THEN '//p[1]' ELSE '//h1' END, n - 1
FROM pages, (SELECT unnest([1, 2]) AS n) WHERE page_id % 4 = 2""",
)
oracle(
    "definition_rejects",
    """SELECT page_id AS material_id, CASE WHEN page_id % 4 = 2 THEN 1 ELSE 0 END AS phase,
    CASE WHEN page_id % 4 = 2 THEN 'unsupported selector' ELSE 'not a definition' END AS reason,
    CASE page_id % 4 WHEN 1 THEN '{"addr":"' || url || '","type":3,"selectors":[{"xp'
        WHEN 2 THEN '//p[1]' END AS text
FROM pages WHERE page_id % 4 <> 0""",
)

oracle(
    "definition_audit",
    """SELECT page_id AS material_id, phase, reason, text FROM pages JOIN (VALUES
    (0, 1, 'no selector', NULL), (1, 1, 'used', '//p'), (1, 1, 'bad field', '$.limit'),
    (1, 1, 'bad field', '$.selectors[1].xpath'), (1, 1, 'unsupported selector', '["//b"]'),
    (2, 1, 'used', '//h1'), (2, 2, 'bad field', '$.selectors'), (2, 2, 'no selector', NULL),
    (2, 3, 'used', '//b'), (3, 1, 'used', '//p'), (4, 1, 'no axis', NULL), (5, 1, 'used', '//p'),
    (5, 1, 'bad field', '$.child'), (6, 0, 'not a definition', '[]')) v(kind, phase, reason, text)
    ON page_id % 7 = kind""",
)
oracle(
    "registry_dispatch",
    f"""WITH {PREP}, {BANNERS}, e1 AS ({elements(1, ITEMS)}), e3 AS ({elements(1, PARAGRAPHS)}),
    e5 AS ({elements(1, HEADINGS)})
SELECT page_id, 1 AS type, selector_no, no, {text_of('el')} AS value, {link(1)} AS href,
    NULL AS imgsrc, NULL AS link FROM e1 WHERE page_id % 5 = 0
UNION ALL
SELECT page_id, 2, 1, links, NULL, NULL, imgsrc, link FROM b WHERE page_id % 5 = 1
UNION ALL
SELECT page_id, 3, 1, no, {text_of('el')}, NULL, NULL, NULL FROM e3 WHERE page_id % 5 = 2 AND no <= 2
UNION ALL
SELECT page_id, 5, 1, no, {text_of('el')}, NULL, NULL, NULL FROM e5 WHERE page_id % 5 = 4""",
)

# ---- URLs and text ---------------------------------------------------------------------

FORMS = "[" + ", ".join(f"replace('{f}', '@W', w)" for f in REFERENCE_FORMS) + "]"
oracle(
    "abs_url",
    rf"""WITH {PREP}, e AS ({elements(1, LINKS)}), r AS (
    SELECT page_id, no - 1 AS no, url, origin, {HREF}[2:] AS w FROM e), f AS (
    SELECT page_id, no, url, origin, generate_subscripts(fs, 1) - 1 AS form, unnest(fs) AS ref
    FROM (SELECT *, {FORMS} AS fs FROM r)), p AS (
    SELECT *, regexp_replace(ref, '#.*$', '') AS u, regexp_extract(url, '^[^?#]*') AS page,
        regexp_extract(url, '^(https?:)', 1) AS scheme FROM f), q AS (
    SELECT *, regexp_extract(u, '^[^?]*') AS path, regexp_extract(u, '\?.*$') AS query,
        regexp_extract(page, '^https?://[^/]*((?:/.*)?)/[^/]*$', 1) AS dir FROM p), m AS (
    SELECT *, string_split(CASE WHEN path LIKE '/%' THEN path ELSE dir || '/' || path END, '/')[2:]
        AS segs FROM q), n AS (
    SELECT *, list_reduce(segs, lambda kept, s: CASE
        WHEN s = '.' THEN kept
        WHEN s = '..' THEN regexp_replace(kept, '/[^/]*$', '')
        ELSE kept || '/' || s END, '') AS folded FROM m)
SELECT page_id, no, form, CASE
    WHEN lower(ref) LIKE 'http://%' OR lower(ref) LIKE 'https://%' THEN ref
    WHEN u = '' THEN url
    WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN u
    WHEN u LIKE '//%' THEN scheme || u
    WHEN path = '' THEN page || query
    ELSE origin || CASE WHEN segs[-1] IN ('.', '..') THEN folded || '/'
        WHEN folded = '' THEN '/' ELSE folded END || query END AS link
FROM n""",
)
oracle(
    "strip_fragment",
    f"""WITH u AS (SELECT url, split_part(url, '#', 1) AS bare FROM pages)
SELECT {domain('url')} AS domain, count(*) FILTER (bare <> url) AS with_fragment,
    count(DISTINCT bare) AS pages, sum(length(bare))::BIGINT AS chars FROM u GROUP BY 1""",
)
oracle(
    "domain_of_url",
    f"""SELECT {domain('url')} AS domain,
    regexp_extract(regexp_extract(url, '^https?://([^/?#]*)', 1), '[a-z0-9-]+\\.[a-z]+$') AS strict_domain,
    regexp_extract('http://localhost.cn/?u=' || url, '[a-z]+\\.[a-z]+') AS nested_domain,
    regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, count(*) AS pages
FROM pages GROUP BY ALL""",
)
oracle(
    "charset_of_page",
    """WITH h AS (SELECT page_id, replace(html, '<meta charset="utf-8">', CASE page_id % 4
    WHEN 0 THEN '<meta charset="utf-8">'
    WHEN 1 THEN '<META http-equiv="Content-Type" content="text/html; charset=GB2312">'
    WHEN 2 THEN '' ELSE '<meta name="x" content="charset=no"><meta charset=ISO-8859-1>' END) AS html
    FROM pages), c AS (
    SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta charset="?([^">]+)"?>', 1), ''),
        nullif(lower(regexp_extract(html, 'http-equiv="Content-Type" content="[^"]*charset=([^"]+)"', 1)), ''),
        'utf-8') AS charset FROM h)
SELECT charset, count(*) AS pages, sum(page_id)::BIGINT AS ids FROM c GROUP BY 1""",
)
oracle(
    "nonblank_text",
    f"""WITH d AS (SELECT doc_id, lang, {dense('text')} AS dense FROM documents)
SELECT doc_id, lang, length(dense) AS chars, md5(dense) AS hash FROM d""",
)
oracle(
    "fingerprint_text",
    f"""SELECT md5({dense('text')}) AS hashcode, count(*) AS copies, min(doc_id) AS first_doc
FROM documents GROUP BY 1""",
)
oracle("decode_body", "SELECT page_id, length(html) AS chars, md5(html) AS hash FROM pages")
oracle(
    "fetch_seqno",
    """SELECT event_id, event_id || strftime(ts, '%Y%m%d%H%M%S') AS seqno,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS write_time FROM events""",
)

# ---- records, landing, results ---------------------------------------------------------

oracle(
    "ingest_quarantine",
    """SELECT event_id,
    CASE WHEN event_id % 10 <> 0 THEN CAST(props::JSON->>'$.k' AS BIGINT) END AS k,
    CASE WHEN event_id % 10 = 0 THEN left(props, -1) END AS corrupt
FROM events WHERE event_id % 10 <> 1""",
)
oracle(
    "landing_roundtrip",
    f"""WITH t AS (SELECT *, TIMESTAMP '{START}' + to_seconds(page_id) AS fetched FROM pages)
SELECT page_id AS material_id, {domain('url')} AS pid, page_id % 5 + 1 AS type,
    page_id || strftime(fetched, '%Y%m%d%H%M%S') AS seqno,
    strftime(fetched, '%Y-%m-%d %H:%M:%S') AS write_time,
    regexp_extract(html, '<meta charset="([^"]+)"', 1) AS charset,
    strftime(fetched, '%Y-%m-%d') AS write_day, md5(html) AS hash FROM t""",
)
oracle(
    "landing_join",
    f"""SELECT page_id || strftime(TIMESTAMP '{START}' + to_seconds(page_id), '%Y%m%d%H%M%S') AS seqno,
    CASE WHEN page_id % 10 = 3 THEN 'orphan' ELSE 'joined' END AS state,
    CASE WHEN page_id % 10 <> 3 THEN length(html) END AS chars FROM pages""",
)
oracle("landing_stream", ORACLES["landing_join"])
oracle(
    "result_replay",
    f"""SELECT page_id AS material_id, page_id || '{SEQNO}' AS seqno, 'y20s1' AS period, {domain('url')} AS pid,
    md5(html) AS contents, count(*) OVER (PARTITION BY {domain('url')}) AS listed FROM pages""",
)
oracle(
    "result_sink",
    f"""WITH {PREP}, l AS (SELECT page_id, url, {BOLDS} AS bs FROM prep)
SELECT page_id AS material_id, page_id || '{SEQNO}' AS seqno, 'y20s1' AS period,
    {domain('url')} AS pid, '{START[:10]}' AS insert_day, '{START}' AS insert_time,
    'utf-8' AS charset, url, len(bs) AS items,
    array_to_string(list_transform(bs, lambda s: {text_of('s')}), '|') AS value
FROM l WHERE len(bs) > 0""",
)

# ---- scans and ranges ------------------------------------------------------------------

oracle(
    "scan_range_status",
    """WITH b AS (SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders, b WHERE o_orderstatus = 'F'
    AND o_orderkey >= low + (high - low) // 4 AND o_orderkey < high - (high - low) // 4""",
)
oracle(
    "scan_page",
    """SELECT o_orderkey, o_orderpriority,
    (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page_no FROM orders""",
)
PARTS = """part AS (SELECT o_custkey::VARCHAR AS pid, max(o_orderkey) AS max_seq,
    min(o_orderkey) AS min_seq, least(count(*), 4) AS split_num, o_custkey % 2 = 0 AS even
    FROM orders GROUP BY o_custkey), wide AS (
    SELECT *, (max_seq - min_seq + split_num) // split_num AS width FROM part), rng AS (
    SELECT pid, max_seq, range_no, min_seq + range_no * width AS start_seq,
        min_seq + (range_no + 1) * width AS end_seq
    FROM (SELECT *, unnest(range(split_num)) AS range_no FROM wide))"""
oracle("partition_ranges", f"WITH {PARTS} SELECT pid, range_no, start_seq, end_seq FROM rng")
oracle(
    "range_assign",
    f"""WITH {PARTS} SELECT o_orderkey, pid, range_no FROM orders JOIN rng
    ON pid = o_custkey::VARCHAR AND o_orderkey >= start_seq AND o_orderkey < end_seq""",
)
oracle(
    "range_lookup",
    f"""WITH {PARTS}, c AS (SELECT pid, range_no, least(start_seq, max_seq + 1) AS start_seq,
    least(end_seq, max_seq + 1) AS end_seq FROM rng)
SELECT o_orderkey, pid, range_no, start_seq, end_seq FROM orders JOIN c
    ON pid = o_custkey::VARCHAR AND o_orderkey > start_seq AND o_orderkey <= end_seq""",
)
UNEVEN = """whole AS (SELECT o_orderpriority AS pid, min(o_orderkey) AS low, max(o_orderkey) + 1 AS high
    FROM orders GROUP BY 1), bound AS (SELECT pid, low AS x FROM whole UNION
    SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey < 100), r AS (
    SELECT pid, x AS start_seq, lead(x, 1, high) OVER (PARTITION BY pid ORDER BY x) AS end_seq
    FROM bound JOIN whole USING (pid))
SELECT o_orderkey, pid, start_seq, end_seq FROM orders JOIN r ON pid = o_orderpriority"""
oracle("range_assign_uneven", f"WITH {UNEVEN} AND o_orderkey >= start_seq AND o_orderkey < end_seq")
oracle("range_lookup_uneven", f"WITH {UNEVEN} AND o_orderkey > start_seq AND o_orderkey <= end_seq")
oracle(
    "scanner_run",
    """WITH w AS (SELECT o_orderpriority AS pid, min(o_orderkey) AS low,
    (max(o_orderkey) - min(o_orderkey) + 4) // 4 AS width FROM orders GROUP BY 1), r AS (
    SELECT pid, low + k * width AS start_seq, low + (k + 1) * width AS end_seq
    FROM w, (SELECT unnest([1, 3]) AS k) WHERE pid < '3')
SELECT o_orderkey AS material_id, pid, start_seq, end_seq FROM orders JOIN r ON pid = o_orderpriority
    AND o_orderkey >= start_seq AND o_orderkey < end_seq WHERE o_orderstatus = 'F'""",
)
oracle(
    "range_split",
    """SELECT o_orderpriority AS pid, o_orderkey AS start_seq,
    lead(o_orderkey, 1, o_orderkey + 1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)
        AS end_seq FROM (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders)""",
)
oracle(
    "scan_assignments",
    f"""WITH {PARTS} SELECT pid, start_seq, end_seq, 600 AS interval_secs,
    's' || (pid::BIGINT % 4) AS scanner_id, part.max_seq, min_seq, split_num,
    CASE WHEN even THEN 1 ELSE 0 END AS assigned FROM rng JOIN part USING (pid)""",
)
oracle(
    "first_unassigned",
    f"""WITH {PARTS} SELECT pid, min_seq, max_seq, split_num FROM part WHERE NOT even
ORDER BY pid LIMIT 1""",
)

# ---- quotas ----------------------------------------------------------------------------

PASSED = f"""ranked AS (SELECT event_id AS request_id, ts, event_type AS domain,
    date_trunc('hour', ts) AS bucket, row_number() OVER (
        PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
    FROM events), passed AS (
    SELECT *, row_number() OVER (PARTITION BY domain, ts::DATE ORDER BY ts, request_id) AS day_rn
    FROM ranked WHERE rn <= {HOUR_CAP})"""
oracle(
    "quota_bucket",
    f"""WITH {PASSED} SELECT request_id, domain, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, rn
FROM passed""",
)
ADMIT = f"""WITH {PASSED} SELECT r.request_id, r.domain, CASE
    WHEN r.rn > {HOUR_CAP} THEN 'max parallel num reached'
    WHEN p.day_rn > {DAY_CAP} THEN 'max service num reached' ELSE '200' END AS verdict
FROM ranked r LEFT JOIN passed p ON r.request_id = p.request_id"""
oracle("quota_two_stage", ADMIT)
oracle(
    "quota_usage",
    """SELECT w AS width, strftime(date_trunc(w, ts), '%Y-%m-%d %H:%M:%S') AS bucket,
    event_type AS domain, count(*) AS requests
FROM (SELECT *, unnest(['second', 'day']) AS w FROM events) GROUP BY ALL""",
)

# ---- link following --------------------------------------------------------------------

EDGES = f"""e AS ({elements(1, LINKS)}), edge AS (
    SELECT DISTINCT page_id AS src,
        (page_id * 13 + (no - 1) * 7 + 1) % (SELECT count(*) FROM pages) AS dst FROM e)"""
oracle(
    "frontier_bfs",
    f"""WITH RECURSIVE {PREP}, {EDGES}, walk AS (
    SELECT min(page_id) AS node, 0 AS depth FROM pages
    UNION
    SELECT dst, depth + 1 FROM walk JOIN edge ON src = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY node""",
)
SITE_EDGES = """hop AS (SELECT page_id AS src, k + 1 AS no,
    (page_id * 13 + k * 7 + 1) % (SELECT count(*) FROM pages) AS dst
    FROM pages, (SELECT unnest([0, 1, 2]) AS k))"""
CRAWL = f"""{PREP}, {SITE_EDGES}, v2 AS (
    SELECT dst AS page_id, count(*) AS visits FROM hop GROUP BY dst), v3 AS (
    SELECT dst AS page_id, sum(visits)::BIGINT AS visits FROM hop JOIN v2 ON src = page_id GROUP BY dst),
    head AS (SELECT page_id, {text_of("regexp_extract(m, '(?s)<h1>(.*?)</h1>', 1)")} AS value
    FROM prep), items AS (
    SELECT 1 AS phase, '{SITE}' || src AS url, 1 AS selector_no, no, 'to' AS value,
        md5('to') AS hashcode, '{SITE}' || dst AS href, 1 AS visits FROM hop
    UNION ALL
    SELECT 2, '{SITE}' || page_id, 1, 1, {dense('value')}, md5(value), NULL, visits
    FROM v2 JOIN head USING (page_id)
    UNION ALL
    SELECT 2, '{SITE}' || src, 2, no, 'to', md5('to'), '{SITE}' || dst, visits
    FROM v2 JOIN hop ON src = page_id
    UNION ALL
    SELECT 3, '{SITE}' || page_id, 1, 1, {dense('value')}, md5(value), NULL, visits
    FROM v3 JOIN head USING (page_id))"""
oracle("phase_crawl", f"WITH {CRAWL} SELECT * FROM items")
SUB_TITLE = dense(text_of("array_to_string(" + HEADINGS.replace("(m,", "(a,") + ", '<!>')"))
oracle(
    "crawl_from_definitions",
    f"""WITH {PREP}, {SITE_EDGES}, head AS (
    SELECT page_id, md5({text_of("regexp_extract(m, '(?s)<h1>(.*?)</h1>', 1)")}) AS hash FROM prep),
    start AS (
    SELECT p.page_id AS mat, p.page_id AS root, p.page_id + k AS page, k + 1 AS page_no
    FROM pages p, (SELECT unnest([0, 1]) AS k)
    WHERE k = 0 OR (p.page_id % 2 = 0 AND p.page_id % 5 <> 4)), one AS (
    SELECT * FROM start WHERE page IN (SELECT page_id FROM pages)), first AS (
    SELECT mat, root, src AS page, page_no, CASE mat % 2 WHEN 0 THEN 1 ELSE 3 END AS selector_no,
        no, dst FROM one JOIN hop ON src = page), art AS (
    SELECT page_id AS mat, no, el AS a FROM ({elements(1, ARTICLES)}) WHERE page_id % 2 = 1), li AS (
    SELECT page_id AS mat, no, el, '{SITE[: SITE.index("/p/")]}' || {HREF} AS href
    FROM ({elements(2, ITEMS)}) WHERE page_id % 2 = 1), two AS (
    SELECT mat, dst AS page, count(*) AS visits FROM first GROUP BY ALL), second AS (
    SELECT mat, page, no, dst, visits FROM two JOIN hop ON src = page WHERE mat % 2 = 0), three AS (
    SELECT mat, dst AS page, sum(visits)::BIGINT AS visits FROM second GROUP BY ALL), gone AS (
    SELECT DISTINCT mat, 2 AS phase, href AS root, href AS url FROM li
    UNION ALL
    SELECT mat, 1, '{SITE}' || root, '{SITE}' || page FROM start
    WHERE page NOT IN (SELECT page_id FROM pages))
SELECT mat AS material_id, 1 AS phase, '{SITE}' || root AS srcurl, '{SITE}' || page AS url, page_no,
    selector_no, no, md5('to') AS hashcode, '{SITE}' || dst AS href, '' AS subvalues, 1 AS visits FROM first
UNION ALL
SELECT mat, 1, '{SITE}' || mat, '{SITE}' || mat, 1, 1, no, md5({text_of('a')}), NULL,
    {SUB_TITLE}, 1 FROM art
UNION ALL
SELECT mat, 1, '{SITE}' || mat, '{SITE}' || mat, 1, 2, no, md5({text_of('el')}), href, '', 1 FROM li
UNION ALL
SELECT mat, 2, '{SITE}' || page, '{SITE}' || page, 1, 1, 1, hash, NULL, '', visits
FROM two JOIN head ON page_id = page
UNION ALL
SELECT mat, 2, '{SITE}' || page, '{SITE}' || page, 1, 2, no, md5('to'), '{SITE}' || dst, '', visits FROM second
UNION ALL
SELECT mat, 3, '{SITE}' || page, '{SITE}' || page, 1, 1, 1, hash, NULL, '', visits
FROM three JOIN head ON page_id = page
UNION ALL
SELECT mat, phase, root, url, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM gone""",
)
oracle(
    "mass_crawl",
    f"""WITH {PREP}, {SITE_EDGES}, head AS (
    SELECT page_id, md5({text_of("regexp_extract(m, '(?s)<h1>(.*?)</h1>', 1)")}) AS hash FROM prep),
    two AS (SELECT DISTINCT src AS run, dst AS page FROM hop WHERE src % 2 = 0),
    three AS (SELECT DISTINCT run, dst AS page FROM two JOIN hop ON src = page), items AS (
    SELECT 1 AS level, src AS run, src AS page, 1 AS selector_no, no, md5('to') AS hashcode, dst
    FROM hop WHERE src % 2 = 0
    UNION ALL SELECT 2, run, page, 1, 1, hash, NULL FROM two JOIN head ON page_id = page
    UNION ALL SELECT 2, run, page, 2, no, md5('to'), dst FROM two JOIN hop ON src = page
    UNION ALL SELECT 3, run, page, 1, 1, hash, NULL FROM three JOIN head ON page_id = page)
SELECT level, run || '{SEQNO}' AS seqno, '{SITE}' || page AS url, selector_no, no, hashcode,
    '{SITE}' || dst AS href FROM items""",
)
oracle(
    "paginate",
    f"""SELECT '{SITE}' || p.page_id AS root, '{SITE}' || q.page_id AS url, k + 1 AS page_no
FROM pages p, (SELECT unnest([0, 1, 2]) AS k), pages q
WHERE q.page_id = p.page_id + k AND p.page_id % 5 + k <= 4""",
)

# Early runs see first captures only, late runs the second ones.
assert EARLY_DAYS < RECAPTURE_DAYS < LATE_DAYS
oracle(
    "recaptured_crawl",
    f"""WITH {PREP}, {SITE_EDGES}, title AS (SELECT page_id, regexp_extract(m, '(?s)<h1>(.*?)</h1>', 1) AS t FROM prep),
    head AS (SELECT page_id, md5({text_of('t')}) AS old, md5({text_of("'New ' || t")}) AS new FROM title),
    seen AS (SELECT m.page_id AS mat, p.page_id AS page, m.page_id % 2 = 1 OR p.page_id % 7 <> 3 AS captured,
        CASE WHEN m.page_id % 2 = 0 THEN old ELSE new END AS hash
    FROM pages m, pages p JOIN head USING (page_id)), one AS (SELECT * FROM seen WHERE mat = page), two AS (
    SELECT mat, dst AS page, count(*) AS visits FROM one JOIN hop ON src = page WHERE captured GROUP BY ALL)
SELECT mat AS material_id, 1 AS phase, '{SITE}' || page AS url, 1 AS selector_no, no, md5('to') AS hashcode,
    '{SITE}' || dst AS href, 1 AS visits FROM one JOIN hop ON src = page WHERE captured
UNION ALL SELECT mat, 1, '{SITE}' || page, 2, 1, hash, NULL, 1 FROM one WHERE captured
UNION ALL SELECT mat, 2, '{SITE}' || page, 1, 1, hash, NULL, visits FROM two JOIN seen USING (mat, page) WHERE captured
UNION ALL SELECT mat, 1, '{SITE}' || page, NULL, NULL, NULL, NULL, NULL FROM one WHERE NOT captured
UNION ALL SELECT mat, 2, '{SITE}' || page, NULL, NULL, NULL, NULL, NULL FROM two JOIN seen USING (mat, page)
WHERE NOT captured""",
)
oracle(
    "second_run",
    f"""SELECT 2 AS run, '{SITE}' || page_id AS url, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END AS tries
FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 2
UNION ALL SELECT 3, '{SITE}' || page_id, 2 FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 = 3""",
)

# ---- assembly --------------------------------------------------------------------------

oracle(
    "collect_by_phase",
    f"""WITH {CRAWL} SELECT phase, url AS srcurl, max(visits) AS visits, count(*) AS items,
    string_agg(value, '|' ORDER BY selector_no, no) AS value FROM items GROUP BY phase, url""",
)
oracle(
    "phase_output",
    f"""WITH {CRAWL} SELECT phase, url AS srcurl, max(visits) AS visits, count(*) AS items,
    coalesce(string_agg(href, '|' ORDER BY selector_no, no), '') AS hrefs
FROM items GROUP BY phase, url""",
)
COUNTS = f"""{SITE_EDGES}, counts AS (
    SELECT src, count(DISTINCT dst) AS expected,
        count(DISTINCT CASE WHEN dst % 5 <> 0 THEN dst END) AS arrived FROM hop GROUP BY src),
    gate AS (SELECT src, src || '{SEQNO}' AS seqno, expected, arrived,
        CASE WHEN expected = arrived THEN 1 ELSE 0 END AS complete FROM counts)"""
oracle(
    "completeness_gate",
    f"WITH {COUNTS} SELECT seqno, expected, arrived, complete FROM gate",
)
oracle(
    "assemble_document",
    f"""WITH {PREP}, {COUNTS} SELECT seqno, 'list' AS kind, '{SITE}' || src AS url, no,
    'to' AS value, '{SITE}' || dst AS href FROM gate JOIN hop USING (src) WHERE complete = 1
UNION ALL
SELECT seqno, 'content', '{SITE}' || dst, 1, {text_of("regexp_extract(m, '(?s)<h1>(.*?)</h1>', 1)")},
    NULL FROM gate JOIN (SELECT DISTINCT src, dst FROM hop) USING (src)
    JOIN prep ON page_id = dst WHERE complete = 1""",
)

oracle("nested_dump", ORACLES["collect_by_phase"])
oracle(
    "document_sink",
    f"""WITH {COUNTS}, placed AS (
    SELECT src, seqno, dst, no, (no - 1) // 2 AS chunk_no,
        min(no) OVER (PARTITION BY src, dst) AS place FROM gate JOIN hop USING (src)
    WHERE complete = 1 AND src % 2 = 0), listed AS (
    SELECT src, seqno, chunk_no, string_agg('{SITE}' || dst, '|' ORDER BY no) AS hrefs
    FROM placed GROUP BY ALL), linked AS (
    SELECT src, (place - 1) // 2 AS chunk_no, count(DISTINCT dst) AS contents FROM placed GROUP BY ALL)
SELECT src AS material_id, seqno, 'y20s1' AS period, 'p1' AS pid, chunk_no, 2 AS chunks, hrefs,
    coalesce(contents, 0) AS contents FROM listed LEFT JOIN linked USING (src, chunk_no)""",
)

# ---- streams ---------------------------------------------------------------------------

oracle("quota_stream", ADMIT)
oracle(
    "quota_usage_stream",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket,
    event_type AS domain, count(*) AS requests FROM events
GROUP BY date_trunc('hour', ts), event_type""",
)
LATE = "(event_id % 50 = 0 AND day(ts) <= 10)"
oracle(
    "quota_stream_late",
    ADMIT.replace("FROM events)", f"FROM events WHERE NOT {LATE})")
    + f" UNION ALL SELECT event_id, event_type, 'late' FROM events WHERE {LATE}",
)
oracle(
    "quota_usage_late",
    f"""SELECT CASE WHEN {LATE} THEN 'late' ELSE 'counted' END AS kind,
    strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type AS domain, count(*) AS requests
FROM events GROUP BY ALL""",
)
oracle(
    "dedup_stream",
    """SELECT DISTINCT 'https://site.example.com/' || event_type || '/' || user_id AS url
FROM events""",
)
oracle(
    "gate_stream",
    f"WITH {COUNTS} SELECT seqno, expected, arrived, complete FROM gate WHERE complete = 1",
)
