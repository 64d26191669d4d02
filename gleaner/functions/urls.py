"""URL expressions: joining, fragments, registered domains, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.sqltext import fold, let, raw

# Recognised domain endings, tried in this order. The dot before a
# trailing "cn" matches any character.
DOMAIN_ENDINGS = (
    "com",
    "edu.cn",
    "cn",
    "com.cn",
    "org",
    "net",
    "tv",
    "vip",
    "cc",
    "gov.cn",
    "gov",
    "edu",
    "biz",
    "net.cn",
    "org.cn",
)

# A label never holds a dot, so sharing it between the endings keeps the first-match order.
DOMAIN_PATTERN = r"[A-Za-z0-9\-]+\.(?:" + "|".join(DOMAIN_ENDINGS) + ")"

_LONGEST_FIRST = sorted(DOMAIN_ENDINGS, key=len, reverse=True)
STRICT_DOMAIN_PATTERN = (
    r"([a-z0-9\-]+\.(?:" + "|".join(e.replace(".", r"\.") for e in _LONGEST_FIRST) + r"))$"
)

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
_DIRECTORY = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)/"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def strip_fragment(url: Column) -> Column:
    """Everything before the first ``#``."""
    return F.substring_index(url, "#", 1)


def host_of(url: Column) -> Column:
    """Lower-case host without user or port; NULL when the URL names none."""
    return F.nullif(F.regexp_extract(F.lower(url), _HOST, 1), F.lit(""))


def registered_domain(url: Column, strict: bool = False) -> Column:
    """Registered domain of a URL, NULL when no known ending occurs.

    The default looks for the first ending anywhere in the lower-cased URL, path and
    query included. ``strict`` looks at the host only and prefers the longest ending.
    """
    if strict:
        found = F.regexp_extract(host_of(url), STRICT_DOMAIN_PATTERN, 1)
    else:
        found = F.regexp_extract(F.lower(url), DOMAIN_PATTERN, 0)
    return F.nullif(found, F.lit(""))


def file_name(url: Column) -> Column:
    """Last path piece, query string kept."""
    return F.substring_index(url, "/", -1)


def _extract(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, {raw(pattern)}, 1)"


def _fold_dots(segments: str) -> str:
    """Resolve ``.`` and ``..`` in a list of path segments."""
    folded = fold(
        segments,
        "CAST(array() AS ARRAY<STRING>)",
        lambda kept, seg: f"""CASE
            WHEN {seg} = '..' THEN slice({kept}, 1, greatest(size({kept}) - 1, 0))
            WHEN {seg} = '.' THEN {kept}
            ELSE concat({kept}, array({seg})) END""",
    )
    # A path that ends in a dot segment names a directory.
    slash = f"if(element_at({segments}, -1) IN ('.', '..'), array(''), array())"
    return f"concat({folded}, {slash})"


def _folded_path(path: str) -> str:
    """Dot segments resolved, one leading slash."""
    dotted = raw(r"(?:^|/)\.{1,2}(?:/|$)")
    folded = f"array_join({let(f"split({path}, '/', -1)", _fold_dots)}, '/')"
    return f"concat('/', regexp_replace(if(rlike({path}, {dotted}), {folded}, {path}), '^/', ''))"


def _merged_path(base: str, path: str) -> str:
    """A non-empty reference path placed under the directory of the base."""
    # Repeated slashes collapse only when the two paths are merged.
    under = f"regexp_replace(concat({_extract(base, _DIRECTORY)}, '/', {path}), '/{{2,}}', '/')"
    return let(f"if(startswith({path}, '/'), {path}, {under})", _folded_path)


def _joined(base: str, ref: str) -> str:
    """Join a non-empty reference without scheme and fragment."""
    origin = _extract(base, _ORIGIN)

    def at_path(path: str) -> str:
        query = f"substring({ref}, length({path}) + 1)"
        return f"concat({origin}, {_merged_path(base, path)}, if({query} = '?', '', {query}))"

    return f"""CASE
        WHEN {ref} = '?' THEN substring_index({base}, '#', 1)
        WHEN startswith({ref}, '?') THEN concat({origin}, {_extract(base, _PATH)}, {ref})
        WHEN startswith({ref}, '//') THEN concat({_extract(base, _SCHEME)}, ':', {ref})
        ELSE {let(f"substring_index({ref}, '?', 1)", at_path)} END"""


def _resolved(base: str, ref: str) -> str:
    """Join a reference without fragment that is not an http(s) URL."""
    scheme = f"lower({_extract(ref, _SCHEME)})"
    # "http:page" under an http base is a relative reference with the scheme spelled out.
    own = f"lower({_extract(base, _SCHEME)})"
    rest = f"substring({ref}, length({scheme}) + 2)"
    return f"""CASE
        WHEN {ref} = '' THEN {base}
        WHEN {scheme} = '' THEN {_joined(base, ref)}
        WHEN {scheme} = {own} THEN {let(rest, lambda r: _joined(base, r))}
        ELSE {ref} END"""


def abs_url_sql(base: str, href: str) -> str:
    """Resolve ``href`` against an absolute http(s) ``base``.

    An http(s) href is returned as it is, fragment included. Any other href loses its
    fragment and is joined by the RFC 3986 rules; an empty one gives the base itself.
    """
    # The common form needs no more than the origin: rooted, no dots, query or fragment.
    rooted = raw(r"^/(?![/])[^#?.]*$")
    return let(
        href,
        lambda h: f"""CASE
            WHEN rlike({h}, {raw(r"(?i)^https?://")}) THEN {h}
            WHEN rlike({h}, {rooted}) THEN concat({_extract(base, _ORIGIN)}, {h})
            ELSE {let(f"substring_index({h}, '#', 1)", lambda ref: _resolved(base, ref))} END""",
    )


def abs_url(base: str, href: str) -> Column:
    """:func:`abs_url_sql` of two columns, or expressions, given by name."""
    return F.expr(abs_url_sql(base, href))
