"""PII surrogates: detected entities get keyed stand-ins of the same type, script and format.

A stand-in comes from a keyed permutation of the entity's own alphabet positions: letters
become letters of the same script and case, digits become digits of their script, all else
stays. Different entities get different stand-ins; the same entity
gets the same one wherever and in whatever case or spacing it occurs. A stand-in that is
itself an entity of the corpus, or was given to another entity, is drawn anew.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import quoted, release, slices
from gleaner.session import cut_lineage

#: Stand-ins drawn for each pending entity in rounds of its own format. After these the
#: format counts as used up, and each further round adds a letter or digit to it.
DRAWS = (1, 1, 8, 64, 64, 64)
WIDER_DRAWS = 8
#: Key of the registered query and the pipeline. A user gives a secret one.
SAMPLE_KEY = b"sample key, replace in production"

# Forms of address by gender, and given names by gender and script.
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Señora Sra Madame Mme Mlle Signora Г-жа".split(),
    "m": "Mr Mister Sir Herr Señor Sr Monsieur Signor Г-н".split(),
    "": "Dr Prof".split(),
}
GIVEN = {
    ("f", "latin"): "Anna Maria Laura Julia Emma Sophie Claire Lucia Elena Nina Clara Irene Alice Helen Marta Eva".split(),
    ("m", "latin"): "John Peter Paul Martin Thomas David Daniel Lucas Simon Victor Oscar Hugo Felix Robert Mark Leon".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Наталья Вера Дарья".split(),
    ("m", "cyrillic"): "Иван Пётр Олег Сергей Антон Павел Денис Роман".split(),
}
_POOL = {name.lower(): (k, i) for k, names in GIVEN.items() for i, name in enumerate(names)}
_GENDER = {t: g for g, titles in TITLES.items() for t in titles}

ALPHABETS = [
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
]
_PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
#: Sizes of the aligned runs of code points whose letters may stand for each other.
RUNS = (1 << 7, 1 << 10, 1 << 16)
_HEX = {c: ("0123456789abcdef", i) for i, c in enumerate("0123456789abcdef")}


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


@lru_cache(1 << 10)
def _alphabet(script: str, category: str, begin: int, size: int) -> str:
    """The letters of a script and category in a run of code points, with one form in each case."""
    run = map(chr, range(begin, begin + size))
    steady = lambda c: len(c.upper()) == 1 and c.upper().lower() == c
    return "".join(c for c in run if unicodedata.category(c) == category and _script(c) == script and steady(c) and c not in _PLACE)


@lru_cache(1 << 16)
def _place(c: str) -> tuple[str, int] | None:
    """The alphabet of a letter or digit and a place in it; none for other characters.

    Digits have those of their script. Letters outside ALPHABETS have the letters around
    them of their script and category, or else vowels or consonants.
    """
    if c in _PLACE:
        return _PLACE[c]
    if c.isdecimal():
        digit = unicodedata.decimal(c)
        return "".join(chr(ord(c) - digit + k) for k in range(10)), digit
    category = unicodedata.category(c)
    if category[0] != "L":
        return None
    for size in RUNS:
        letters = _alphabet(_script(c), category, ord(c) // size * size, size)
        if len(letters) > 1:
            at = letters.find(c)
            return letters, at if at >= 0 else ord(c) % len(letters)
    return ALPHABETS[2], ord(c) % len(ALPHABETS[2])


def _ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Patterns in order of precedence; the first group, if any, is the entity.
PATTERNS = [
    # a quoted string, or else what stands before a delimiter
    ("secret", regex.compile(
        r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*"
        r"(?:\"(?P<v>[^\"\r\n]{6,})\"|'(?P<v>[^'\r\n]{6,})'|[\"']?(?P<v>[^\s\"<>,;]{6,}|[^\s\"<>]{6,}))"
    )),
    # a run of such characters is tried from its begin, or from the end of the match before, and once
    ("email", regex.compile(r"(?:\G|(?<![\p{L}\p{M}\d_.%+-]))[\p{L}\p{M}\d_.%+-]++@[\p{L}\p{M}\d-]+(?:\.[\p{L}\p{M}\d-]+)+")),
    ("secret", regex.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", regex.compile(r"(?<![\p{L}\d])(?=[a-fA-F]*\d)(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![\p{L}\d])")),
    ("iban", regex.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", regex.compile(r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\p{L}\d])")),
    ("ip", regex.compile(rf"(?<![\p{{L}}\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\d]|\.\d)")),
    ("ssn", regex.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", regex.compile(r"(?<![\p{L}\d])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\d)")),
    ("phone", regex.compile(r"(?<![\p{L}\d])(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)")),
]
NAME = regex.compile(rf"\b({_TITLE})\b\.?[ ]((?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]+)(?:[ ]\p{{Lu}}[\p{{L}}\p{{M}}'’-]+){{0,2}})")
#: A word with its inner hyphens and apostrophes, and the parts of one.
WORD = regex.compile(r"(?<![\p{L}\p{M}\d_])\p{L}[\p{L}\p{M}]*(?:['’-][\p{L}\p{M}]+)*(?![\p{L}\p{M}\d_])")
WORD_PART = regex.compile(r"[\p{L}\p{M}]+")
_TAIL = regex.compile(r"(?:['’][sS])?['’-]*$")
_FOREIGN_DIGIT = regex.compile(r"[^\P{Nd}0-9]")
#: What a text must hold for any pattern to match; others are passed on by Spark alone.
HINT = rf"[\p{{Nd}}@=:]|AKIA|(?:{_TITLE})\.? "


def canonical(kind: str, surface: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("card", "ssn"):
        return _ascii_digits(re.sub(r"\D", "", surface))
    if kind == "phone":
        return ("+" if surface.startswith("+") else "") + _ascii_digits(re.sub(r"\D", "", surface))
    if kind == "iban":
        return _ascii_digits(surface.replace(" ", "").lower())
    if kind == "ip":
        return ".".join(str(int(x)) for x in surface.split("."))
    return surface.lower()


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """``(begin, end, kind, canonical form)`` of the entities, in order and without overlap.

    A name found after a form of address is an entity wherever else it stands in the text as
    a word or part of one with a capital letter.
    """
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def add(begin: int, end: int, kind: str) -> None:
        if begin < end and not any(taken[begin:end]):
            taken[begin:end] = b"\x01" * (end - begin)
            found.append((begin, end, kind, canonical(kind, text[begin:end])))

    # digits of any script are read as ASCII ones
    plain = text if text.isascii() else _FOREIGN_DIGIT.sub(lambda m: str(unicodedata.decimal(m.group(), m.group())), text)
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(plain):
            begin, end = m.span("v" if "v" in pattern.groupindex else 0)
            if kind == "email":
                end = begin + len(text[begin:end].rstrip(".-"))
            if kind == "secret":  # punctuation at its ends would stay as it is
                while begin < end and not text[end - 1].isalnum():
                    end -= 1
            add(begin, end, kind)
    names: dict[str, str] = {}
    for m in NAME.finditer(text):
        gender = _GENDER[m.group(1)]
        parts = list(regex.finditer(r"[^ ]+", m.group(2)))
        for k, part in enumerate(parts):
            begin = m.start(2) + part.start()
            name = _TAIL.sub("", part.group(), count=1)
            kind = f"given-{gender}" if k < len(parts) - 1 else "surname"
            names.setdefault(name.lower(), kind)
            add(begin, begin + len(name), kind)
    for m in WORD.finditer(text) if names else ():
        whole = [(m.start(), m.group())]
        if m.group().lower() not in names:
            whole = [(m.start() + part.start(), part.group()) for part in WORD_PART.finditer(m.group())]
        for begin, word in whole:
            if word.lower() in names and word[0].isupper():
                add(begin, begin + len(word), names[word.lower()])
    return sorted(found)


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, repr(parts).encode(), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, values: list[int], radices: list[int], times: int = 1) -> list[int]:
    """A keyed bijection of mixed-radix numbers, another for each of ``times``.

    It has eight rounds that shift one half by the other.
    """
    half = len(values) // 2
    sides = [(values[:half], radices[:half]), (values[half:], radices[half:])]
    numbers = []
    for digits, bases in sides:
        n = 0
        for d, b in zip(digits, bases, strict=True):
            n = n * b + d
        numbers.append(n)
    sizes = [prod(bases) for _, bases in sides]
    label = (tweak, tuple(radices)) if times == 1 else (tweak, tuple(radices), times)
    for step in range(8):
        a = step % 2
        numbers[a] = (numbers[a] + _number(key, label, step, numbers[1 - a])) % sizes[a]
    out = []
    for n, (_, bases) in zip(numbers, sides, strict=True):
        digits = []
        for b in reversed(bases):
            n, d = divmod(n, b)
            digits.append(d)
        out += reversed(digits)
    return out


def _spelled(key: bytes, tweak: str, text: str, times: int, place: Callable = _place, fixed: int = 0) -> str:
    """``text`` with each letter and digit replaced by one of its own alphabet; the first ``fixed`` stay."""
    places = [place(c) if k >= fixed else None for k, c in enumerate(text)]
    held = [p for p in places if p]
    shape = "".join("?" if p else c for p, c in zip(places, text, strict=True))
    new = iter(permute(key, tweak + "|" + shape, [i for _, i in held], [len(a) for a, _ in held], times) if held else [])
    return "".join(p[0][next(new)] if p else c for p, c in zip(places, text, strict=True))


def _check_digit(digits: str) -> int:
    total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _pooled(kind: str, canon: str) -> bool:
    """Whether this is a given name of the built-in lists after a title that fits it."""
    return kind.startswith("given") and canon in _POOL and kind[-1] in ("-", _POOL[canon][0][0])


def space(kind: str, canon: str) -> str:
    """What must be distinct: names share one space, apart from those of the built-in lists."""
    if _pooled(kind, canon):
        return f"given-{_POOL[canon][0][0]}"
    return "name" if kind.startswith("given") or kind == "surname" else kind


def stand_in(key: bytes, kind: str, canon: str, times: int = 1, wider: int = 0) -> str:
    """The canonical form of an entity's surrogate, as drawn the ``times``-th time.

    It is ``wider`` letters or digits longer than the entity; an IPv4 address becomes an
    IPv6 one. Lists of given names are walked in a keyed order, so none stands for itself.
    """
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        head, _, top = domain.rpartition(".")
        return f"{_spelled(key, 'local ' + domain, local + 'b' * wider, times)}@{_spelled(key, 'domain', head, 1)}.{top}"
    if kind == "ip" and wider:
        return f"{_number(key, kind, canon, times) % 2**128:032x}"[:4] + "".join(f":{n:x}" for n in permute(key, kind, [int(x) for x in canon.split(".")] + [0] * 3, [256] * 4 + [1 << 16] * 3, times))
    if kind == "ip":
        return ".".join(map(str, permute(key, kind, [int(x) for x in canon.split(".")], [256] * 4, times)))
    if kind == "card":
        off = (int(canon[-1]) - _check_digit(canon[:-1])) % 10
        body = _spelled(key, f"card {off}", canon[:-1] + "0" * wider, times)
        return body + str((_check_digit(body) + off) % 10)
    if kind in ("phone", "ssn"):
        return _spelled(key, kind, canon + "0" * wider, times, fixed=2 if canon[0] == "+" else 0)
    if kind == "iban":
        return _spelled(key, kind, canon + "0" * wider, times, fixed=2)
    if kind == "secret":
        if set(canon) <= set(_HEX):
            return _spelled(key, "hex", canon + "0" * wider, times, _HEX.get)
        return _spelled(key, kind, canon + "0" * wider, times, fixed=4 if canon.startswith("akia") else 0)
    if _pooled(kind, canon):
        group, _ = _POOL[canon]
        order = sorted(GIVEN[group], key=lambda name: _number(key, group, name))
        return order[[name.lower() for name in order].index(canon) - 1].lower()
    # the ending of a name stays: it often tells the gender
    return _spelled(key, "name", canon[:-1] + "b" * wider, times) + canon[-1:]


def _like(new: str, old: str) -> str:
    """A character in the case of another, and a digit in its script."""
    if old.isdecimal() and new.isdecimal():
        return chr(ord(old) - unicodedata.decimal(old) + unicodedata.decimal(new))
    return new.upper() if old.isupper() else new


def render(kind: str, surface: str, surrogate: str) -> str:
    """The surrogate in the spacing, case and digits of the mention."""
    if kind == "ip":
        return "".join(_like(c, surface[0]) for c in surrogate)
    if kind.startswith("given") and len(surrogate) != len(surface):
        return surrogate.upper() if surface.isupper() else surrogate.capitalize()
    if kind == "secret" and surface.isupper():
        return surrogate.upper()
    bare = kind in ("card", "ssn", "phone")
    source = iter(re.sub(r"\D", "", surrogate) if bare else surrogate)
    out = []
    for c in surface:
        if (bare and not c.isdecimal()) or (kind == "iban" and c == " "):
            out.append(c)
        else:
            new = next(source, "")
            out.append(_like(new, c) if new else "")
    rest = "".join(source)
    return "".join(out) + (rest.upper() if surface.isupper() else rest)


def _detected(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``uid`` and ``entities`` of each document."""
    schema = T.StructType(
        [T.StructField("row", docs.schema), T.StructField("text", T.StringType()), T.StructField("uid", T.LongType()), *T.StructType.fromDDL("entities array<struct<begin:int,end:int,kind:string,canon:string>>")]
    )
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canon", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                found = [
                    [{"begin": b, "end": e, "kind": space(k, c), "canon": c} for b, e, k, c in detect(t or "")]
                    for t in part.column("text").to_pylist()
                ]
                ids = pa.array(range(uid, uid + len(found)), pa.int64())
                uid += len(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("text"), ids, pa.array(found, kind)],
                    ["row", "text", "uid", "entities"],
                )

    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    return docs.select(whole, "text").mapInArrow(run, schema)


def _stand_ins(entities: DataFrame, key: bytes, draws: range, wider: int) -> DataFrame:
    """The stand-ins of these draws, without those that are the entity itself or a listed given name."""

    def fits(kind: str, canon: str, new: str) -> bool:
        return new != canon and (new not in _POOL or kind not in ("name", "surname"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist(), strict=True)
            made = [(k, c, n, stand_in(key, k, c, n, wider)) for k, c in pairs for n in draws]
            made = [m for m in made if fits(m[0], m[1], m[3])]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "canon", "draw", "surrogate"])

    return entities.select("kind", "canon").mapInArrow(run, "kind string, canon string, draw int, surrogate string")


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, canon, surrogate`` of distinct entities: no two alike, none an entity of the corpus.

    A stand-in that occurs in the corpus or was given in an earlier round is void. One that
    several entities draw goes to that of smallest hash; the others draw again, at last in a
    wider format, until each has one. Given names from the built-in lists may occur in the
    corpus, as they identify nobody.
    """
    known = entities.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    pending, done, drawn, turn = entities, None, 0, 0
    while True:
        wider = max(0, turn + 1 - len(DRAWS))
        count = WIDER_DRAWS if wider else DRAWS[turn]
        made = cut_lineage(_stand_ins(pending, key, range(drawn + 1, drawn + count + 1), wider), "stand-ins")
        clash = (made["kind"] == known["k"]) & (made["surrogate"] == known["c"]) & ~made["kind"].startswith("given")
        free = made.join(known, clash, "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        rank = F.struct(F.xxhash64("surrogate", "canon").alias("h"), "canon", "draw")
        owned = free.groupBy("kind", "surrogate").agg(F.min(rank).alias("o"))
        won = owned.groupBy("kind", F.col("o.canon").alias("canon")).agg(F.min(F.struct("o.draw", "surrogate")).alias("w"))
        won = cut_lineage(won.select("kind", "canon", F.col("w.surrogate").alias("surrogate")), "surrogates")
        done = won if done is None else done.union(won)
        pending = cut_lineage(pending.join(won, ["kind", "canon"], "left_anti"), "clashes")
        if pending.isEmpty():
            return done
        drawn, turn = drawn + count, turn + 1


def _rewritten(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``row`` with its text rewritten, and the number of replacements."""
    out = T.StructType([T.StructField("row", schema), T.StructField("new_text", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts, counts = [], []
                for text, marks in zip(part.column("text").to_pylist(), part.column("marks").to_pylist(), strict=True):
                    pieces, at = [], 0
                    for m in sorted(marks or [], key=lambda m: m["begin"]):
                        pieces += [text[at : m["begin"]], render(m["kind"], text[m["begin"] : m["end"]], m["surrogate"])]
                        at = m["end"]
                    texts.append(text if not pieces else "".join(pieces) + text[at:])
                    counts.append(len(marks or []))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["row", "new_text", "n"]
                )

    return rows.select("row", "text", "marks").mapInArrow(run, out)


def replace_entities(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; rows and columns stay.

    ``count`` names an added column with the number of replacements. Null and empty texts
    stay as they are, equal rows change alike, and n_chars, if there is one, follows.
    """
    spark = docs.sparkSession
    hinted = F.coalesce(F.col("text"), F.lit("")).rlike(HINT)
    flagged = cut_lineage(_detected(docs.filter(hinted)), "detected")
    mentions = flagged.select("uid", F.explode("entities").alias("e")).select("uid", "e.*")
    entities = cut_lineage(mentions.select("kind", "canon").distinct(), "entities")
    table = surrogate_table(entities, key)
    marks = (
        mentions.join(table, ["kind", "canon"])
        .groupBy("uid")
        .agg(F.collect_list(F.struct("begin", "end", "kind", "surrogate")).alias("marks"))
    )
    new = _rewritten(flagged.join(marks, "uid", "left"), docs.schema)
    release(spark)

    def column(name: str, old: Column) -> Column:
        if name == "text":
            return F.col("new_text").alias(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("n") > 0, F.length("new_text").cast(kind)).otherwise(old).alias(name)
        return old.alias(name)

    number = [F.col("n").alias(count)] if count else []
    changed = new.select(*[column(c, F.col("row").getField(c)) for c in docs.columns], *number)
    zero = [F.lit(0).cast("long").alias(count)] if count else []
    same = docs.filter(~hinted).select(*[F.col(quoted(c)) for c in docs.columns], *zero)
    return same.union(changed)
