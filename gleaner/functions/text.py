"""Text expressions: whitespace, entities, fingerprints, charsets.

Functions named ``*_sql`` take and return Spark SQL text; the others work on columns.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.sqltext import fold, let, quoted, raw

# Unicode white space plus the four separators that Python also counts as blank.
BLANK = r"[\s\x1c-\x1f]"
_EDGES = rf"(?U)^{BLANK}+|{BLANK}+$"
_ALL_BLANK = rf"(?U){BLANK}+"
BLANK_CHARACTERS = "".join(
    chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                     0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
TAG = r"""<(?=[A-Za-z/!?])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""

_AMP_ENTITY = r"&(?:amp|#0*38|#[xX]0*26);"
_OTHER_ENTITY = r"&(?!amp;)[A-Za-z0-9#]+;"
_NAMED = json.dumps({n: chr(c) for n, c in sorted(name2codepoint.items()) if n != "amp"})


def strip(text: Column) -> Column:
    """Remove blanks at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, _EDGES, "")


def nonblank(text: Column) -> Column:
    """Remove every blank."""
    return F.regexp_replace(text, _ALL_BLANK, "")


def nonblank_sql(text: str) -> str:
    return f"regexp_replace({text}, {raw(_ALL_BLANK)}, '')"


def fingerprint(text: Column) -> Column:
    """Stable content hash, comparable between runs."""
    return F.md5(text)


def _character_sql(code: str) -> str:
    """The character of a code point, NULL where there is none."""
    return (
        f"if(({code} > 0 AND {code} < 55296) OR ({code} > 57343 AND {code} <= 1114111), "
        f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), NULL)"
    )


def _replace_entities_sql(text: str, pattern: str, to_character) -> str:
    """Replace each distinct entity that ``pattern`` (one group) finds; unknown ones stay."""
    found = f"array_distinct(regexp_extract_all({text}, {raw(pattern)}, 0))"

    def one(result: str, entity: str) -> str:
        character = to_character(f"regexp_extract({entity}, {raw(pattern)}, 1)")
        return f"replace({result}, {entity}, coalesce({character}, {entity}))"

    return fold(found, text, one)


def decode_entities_sql(text: str) -> str:
    """HTML 4 named and numeric character references; ``&amp;`` last."""
    names = f"from_json({quoted(_NAMED)}, 'map<string,string>')"

    def named(value: str) -> str:
        return _replace_entities_sql(
            value,
            r"&((?!amp;)[A-Za-z][A-Za-z0-9]*);",
            lambda name: f"try_element_at({names}, {name})",
        )

    def numeric(value: str) -> str:
        decimal = _replace_entities_sql(
            value,
            r"&#(?!0*38;)0*([0-9]{1,7});",
            lambda digits: let(f"CAST({digits} AS BIGINT)", _character_sql),
        )
        return let(
            decimal,
            lambda v: _replace_entities_sql(
                v,
                r"&#[xX](?!0*26;)0*([0-9a-fA-F]{1,6});",
                lambda digits: let(f"CAST(conv({digits}, 16, 10) AS BIGINT)", _character_sql),
            ),
        )

    def decoded(value: str) -> str:
        rest = let(named(value), lambda v: f"if(contains({v}, '&#'), {numeric(v)}, {v})")
        full = f"regexp_replace({rest}, {raw(_AMP_ENTITY)}, '&')"
        return f"if(rlike({value}, {raw(_OTHER_ENTITY)}), {full}, replace({value}, '&amp;', '&'))"

    return let(text, lambda v: f"if(contains({v}, '&'), {decoded(v)}, {v})")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


# Charset labels decoded in the JVM, where bad bytes are found without an error.
NATIVE_CHARSETS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "utf": "UTF-8",
    "us-ascii": "US-ASCII",
    "ascii": "US-ASCII",
    "iso-8859-1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
}


def is_native_charset(charset: Column) -> Column:
    return F.lower(charset).isin(*NATIVE_CHARSETS)


def decode_native(body: Column, charset: Column) -> Column:
    """Decode with a charset from the native list; malformed UTF-8 or ASCII gives NULL."""
    label = F.lower(charset)

    def labels(name: str) -> list[str]:
        return [k for k, v in NATIVE_CHARSETS.items() if v == name]

    as_is = body.cast("string")
    return (
        F.when(label.isin(labels("UTF-8")), F.when(F.is_valid_utf8(as_is), as_is))
        .when(
            label.isin(labels("US-ASCII")),
            F.when(~F.hex(body).rlike("^(?:..)*[89A-F]."), as_is),
        )
        .when(label.isin(labels("ISO-8859-1")), F.decode(body, "ISO-8859-1"))
    )


def decode_other(body: Column, charset: Column) -> Column:
    """Decode bytes in any other charset; undecodable bytes or an unknown charset give NULL."""

    # Defined here so that it ships by value: workers need no copy of this package.
    def decode(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(raw_bytes, label):
            if raw_bytes is None or label is None:
                return None
            try:
                return bytes(raw_bytes).decode(label)
            except (UnicodeDecodeError, LookupError):
                return None

        return pd.Series([one(b, c) for b, c in zip(bodies, charsets)], dtype=object)

    return F.pandas_udf(decode, StringType())(body, charset)
