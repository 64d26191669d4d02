"""Selectors over captured HTML, as native column expressions.

Captured HTML is rarely well formed, so no tree is built. A page is first prepared (comments
become separators, script and style bodies lose their ``<``) and cut into its tags and the
texts between them, by one pattern each. :mod:`gleaner.operators.elements` gives every open
tag its interval; a selector is then a filter over names and intervals, whatever the markup
around them. Tags end by three rules:

* flat: the element ends at the next boundary (paragraphs, headings, void tags);
* scoped: it ends at the next sibling, unless that lies inside a nested container, or
  where a container around it closes (list items, table cells, links, inline tags);
* balanced: it ends at its matching close tag (every other tag).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.sqltext import Body, each, first, fold, fresh, keep, let, quoted, raw
from gleaner.functions.text import BLANK_CHARACTERS, TAG, decode_entities_sql

# Fixed values (HTML standard): elements without content.
VOID_TAGS = (
    "area base br col embed hr img input link meta source track wbr".split()
)
# Fixed values (HTML standard): tags whose start ends an open paragraph.
PARAGRAPH_ENDS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol pre section table ul"
).split()
_PARENT_ENDS = "body html li dd dt td th".split()
BLOCKS = [t for t in [*PARAGRAPH_ENDS, *_PARENT_ENDS] if t not in VOID_TAGS]
#: Any of these tags, opening or closing, ends a paragraph.
PARAGRAPH_BOUNDARIES = ["p", *PARAGRAPH_ENDS, *_PARENT_ENDS]
#: These end at the next tag of their own name.
FLAT_TAGS = "h1 h2 h3 h4 h5 h6 title script style textarea button".split()
#: Siblings that end one another, what else ends them, and the containers that hide all those.
SIBLING_GROUPS = {
    "li": (["li"], [], ["ul", "ol", "menu"]),
    "dd": (["dt", "dd"], [], ["dl"]),
    "option": (["option"], ["optgroup"], ["select"]),
    "tr": (["tr"], ["tbody", "thead", "tfoot"], ["table"]),
}
#: Cells are ended by what ends a row, and by one another.
CELLS = ["td", "th"]
#: Ended by their own name, and where a block around them closes; fonts also by paragraphs.
FONT_TAGS = "b big em font i s small strong tt u".split()
#: Balanced, but also ended by a paragraph or where a block around them closes.
PHRASE_TAGS = "abbr cite code label q span sub sup".split()

STEP_PATTERN = r"(//?)([A-Za-z][A-Za-z0-9\-]*)(\[[^\]]*\])?"
PREDICATE_PATTERN = (
    r"""^\[(?:@([A-Za-z][\w\-]*)(?:\s*=\s*(?:'([^']*)'|"([^"]*)"))?"""
    r"""|contains\(\s*@([A-Za-z][\w\-]*)\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\))\]$"""
)

_ATTRIBUTE = r"""[^\s=/>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


class UnsupportedSelector(ValueError):
    """The selector lies outside the supported forms."""


@dataclass(frozen=True)
class Step:
    """One step of a selector: axis (``/`` or ``//``), tag and an optional attribute test."""

    axis: str
    tag: str
    attr: str | None = None
    test: str | None = None  # "has", "equals" or "contains"
    value: str | None = None


def parse_steps(xpath: str) -> list[Step]:
    """Steps of a selector such as ``//ul/li``, ``./b`` or ``//div[@class='ad']``."""
    path = re.sub(r"^\.(?=/)", "", xpath.strip())
    steps, end = [], 0
    for match in re.finditer(STEP_PATTERN, path):
        if match.start() != end:
            raise UnsupportedSelector(xpath)
        end = match.end()
        axis, tag, predicate = match.groups()
        attr = test = value = None
        if predicate:
            found = re.match(PREDICATE_PATTERN, predicate)
            if not found:
                raise UnsupportedSelector(xpath)
            name, single, double, inside, part1, part2 = found.groups()
            attr = (name or inside).lower()
            value = next((v for v in (single, double, part1, part2) if v is not None), None)
            test = "contains" if inside else "has" if value is None else "equals"
        steps.append(Step(axis, tag.lower(), attr, test, value))
    if not steps or end != len(path):
        raise UnsupportedSelector(xpath)
    return steps


def step_sql(xpath: str) -> str:
    """Steps of selectors held in a column; NULL where the selector is not supported."""
    anchored = raw("^" + STEP_PATTERN)

    def part(piece: str, number: int) -> str:
        return f"regexp_extract({piece}, {anchored}, {number})"

    def groups(predicate: str, *numbers: int) -> str:
        found = (
            f"nullif(regexp_extract({predicate}, {raw(PREDICATE_PATTERN)}, {n}), '')"
            for n in numbers
        )
        return f"coalesce({', '.join(found)}, CAST(NULL AS STRING))"

    def to_step(piece: str) -> str:
        def with_predicate(p: str) -> str:
            value = groups(p, 2, 3, 5, 6)
            return f"""named_struct(
                'axis', {part(piece, 1)},
                'tag', lower({part(piece, 2)}),
                'attr', lower({groups(p, 1, 4)}),
                'test', CASE WHEN {p} = '' THEN NULL
                    WHEN {groups(p, 4)} IS NOT NULL THEN 'contains'
                    WHEN contains({p}, '=') THEN 'equals' ELSE 'has' END,
                'value', if(contains({p}, '='), coalesce({value}, ''), {value}))"""

        return let(part(piece, 3), with_predicate)

    def whole(path: str) -> str:
        def checked(pieces: str) -> str:
            bad = keep(
                pieces,
                lambda p: f"{part(p, 3)} != '' AND NOT rlike({part(p, 3)}, {raw(PREDICATE_PATTERN)})",
            )
            return f"""if(size({pieces}) > 0 AND array_join({pieces}, '') = {path}
                AND size({bad}) = 0, {each(pieces, to_step)}, NULL)"""

        return let(f"regexp_extract_all({path}, {raw(STEP_PATTERN)}, 0)", checked)

    return let(f"regexp_replace(trim({xpath}), {raw(r'^[.](?=/)')}, '')", whole)


def step_column(xpath: str) -> Column:
    """:func:`step_sql` as a column of ``array<struct<axis,tag,attr,test,value>>``."""
    return F.expr(step_sql(xpath))


def prepare_sql(html: str) -> str:
    """Make a page safe to cut at tags.

    A comment becomes ``<!>``, which still separates text nodes. Script and style
    bodies keep their text, but ``<`` and ``&`` in them become entities, so what looks
    like a tag there is never one.
    """
    # One pattern for both: whichever starts first hides the other. A script or style is
    # marked by a separator with its name, and loses its "<" to it.
    hidden = r"(?is)<(?:!--.*?(?:-->|$)|((script|style)(?=[\s/>])[^>]*>.*?(?:</\2\s*>|$)))"
    bare = f"regexp_replace({html}, {raw(hidden)}, '<!$2>$1')"
    pieces = f"split({bare}, {raw(r'(?i)<!(?:script|style)>')}, -1)"

    def masked(piece: str, index: str) -> str:
        end = raw(r"(?is)^(.*?)(</(?:script|style)\s*>.*|)$")

        def quiet(body: str) -> str:
            return f"replace(replace({body}, '&', '&amp;'), '<', '&lt;')"

        body, rest = (f"regexp_extract({piece}, {end}, {n})" for n in (1, 2))
        return f"if({index} = 0, {piece}, concat('<', {quiet(body)}, {rest}))"

    piece, index = fresh(), fresh()
    joined = f"array_join(transform({pieces}, ({piece}, {index}) -> {masked(piece, index)}), '')"
    return f"if(rlike({html}, {raw('(?i)<(?:!--|script|style)')}), {joined}, {html})"


def prepare(html: str) -> Column:
    return F.expr(prepare_sql(html))


def tags_sql(markup: str) -> str:
    """All tags of prepared markup in order, quoted ``>`` respected."""
    return f"regexp_extract_all({markup}, {raw(TAG)}, 0)"


def nodes_sql(markup: str) -> str:
    """The text before the first tag and the one after each tag, entities decoded."""
    cut = f"split({markup}, {raw(TAG)}, -1)"
    return f"if(contains({markup}, '&'), {each(cut, decode_entities_sql)}, {cut})"


def stripped_sql(nodes: str) -> str:
    return each(nodes, lambda node: f"trim(BOTH {quoted(BLANK_CHARACTERS)} FROM {node})")


def _attribute_pattern(name: str) -> str:
    return (
        rf"(?is)^<[a-z][^\s/>]*(?:[\s/]+(?!{name}[\s=/>]){_ATTRIBUTE})*"
        rf"""[\s/]+{name}(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/>]))"""
    )


def attribute_sql(tag: str, name: str, fixed: bool = True) -> str:
    """Value of an attribute of an open tag: NULL when absent, empty when it has no value.

    With ``fixed=False`` the name is itself an expression.
    """
    if fixed:
        pattern = raw(_attribute_pattern(re.escape(name)))
    else:
        pieces = _attribute_pattern("\0").split("\0")
        pattern = f"concat({f', {name}, '.join(map(raw, pieces))})"
    quotes = raw(r"""(?s)^(["'])(.*)\1$""")
    value = f"regexp_replace(regexp_extract({tag}, {pattern}, 1), {quotes}, '$2')"
    return f"if(rlike({tag}, {pattern}), {decode_entities_sql(value)}, NULL)"


def attribute(tag: str, name: str) -> Column:
    return F.expr(attribute_sql(tag, name))


#: An element: the number of its tag, that of the tag that ends it (its own where it holds
#: nothing), its place among the elements, how many elements are around it, name and open tag.
ELEMENTS = "array<struct<el:int,end:int,idx:int,level:int,name:string,open:string>>"
#: What a page becomes: texts between tags, as they stand and stripped, and its elements.
PAGE = f"struct<nodes:array<string>,texts:array<string>,elements:{ELEMENTS}>"
#: A matched element: itself, its text, and, where asked for, what is needed to look inside.
MATCHES = (
    "array<struct<el:int,end:int,idx:int,level:int,open:string,text:string,"
    f"inside:{ELEMENTS},texts:array<string>>>"
)
PAGE_ROOT = "named_struct('el', 0, 'end', 2147483647, 'idx', 0, 'level', -1)"


def _passes(tag: str, step: Step | str) -> str:
    """Attribute test of a step on an open tag."""
    if isinstance(step, Step):
        if step.attr is None:
            return "true"
        value = attribute_sql(tag, step.attr)
        if step.test == "has":
            return f"{value} IS NOT NULL"
        wanted = quoted(step.value)
        test = f"{value} = {wanted}" if step.test == "equals" else f"contains({value}, {wanted})"
        return f"coalesce({test}, false)"
    tested = let(
        attribute_sql(tag, f"{step}.attr", fixed=False),
        lambda value: f"""CASE WHEN {step}.test = 'has' THEN {value} IS NOT NULL
            WHEN {step}.test = 'equals' THEN coalesce({value} = {step}.value, false)
            ELSE coalesce(contains({value}, {step}.value), false) END""",
    )
    return f"if({step}.attr IS NULL, true, {tested})"


def _step_literal(step: Step) -> str:
    """A step known now in the form that selectors held in a column have."""
    fields = (("axis", step.axis), ("tag", step.tag), ("attr", step.attr), ("test", step.test), ("value", step.value))
    return f"named_struct({', '.join(f"'{name}', {quoted(value)}" for name, value in fields)})"


def _within(elements: str, context: str, step: Step | str, base: str) -> str:
    """The elements inside a context that a step selects, in page order.

    They follow the context in the list of elements, and there are no more of them than tags.
    """
    known = isinstance(step, Step)
    tag = quoted(step.tag) if known else f"{step}.tag"

    def selected(e: str) -> str:
        child = f"{e}.level = {context}.level + 1"
        if known:
            axis = child if step.axis == "/" else "true"
        else:
            axis = f"({step}.axis = '//' OR {child})"
        # nested conditions: the attribute is looked for only where the name fits
        return f"if({e}.name = {tag} AND {e}.el < {context}.end AND {axis}, {_passes(f'{e}.open', step)}, false)"

    first_inside = f"{context}.idx - {base} + 1"
    most = f"least({context}.end - {context}.el - 1, size({elements}))"
    inside = elements if context == PAGE_ROOT else f"slice({elements}, {first_inside}, greatest({most}, 0))"
    return keep(inside, selected)


def _clipped(found: str, context: str) -> str:
    """Elements end where their context ends, at the latest."""

    def clip(e: str) -> str:
        fields = f"'idx', {e}.idx, 'level', {e}.level, 'name', {e}.name, 'open', {e}.open"
        return f"if({e}.end <= {context}.end, {e}, named_struct('el', {e}.el, 'end', {context}.end, {fields}))"

    return each(found, clip)


def select_sql(elements: str, steps: list[Step] | str, root: str = PAGE_ROOT) -> str:
    """The elements a selector picks, in page order and once each.

    ``steps`` is a list known now, or an expression when selectors are data. ``root`` is the
    element that ``elements`` lie inside of; the page by default.
    """
    base = "0" if root == PAGE_ROOT else f"{root}.idx"
    if not isinstance(steps, str) and len(steps) == 1:
        found = _within(elements, root, steps[0], base)
        return found if root == PAGE_ROOT else _clipped(found, root)

    def advance(contexts: str, step: Step | str) -> str:
        found = each(contexts, lambda c: _clipped(_within(elements, c, step, base), c))
        # nested contexts meet the same element twice
        x, k = fresh(), fresh()
        return let(
            f"array_sort(flatten({found}))",
            lambda s: f"filter({s}, ({x}, {k}) -> {k} = 0 OR {x}.el <> get({s}, {k} - 1).el)",
        )

    begin = f"array(named_struct('el', {root}.el, 'end', {root}.end, 'idx', {root}.idx, 'level', {root}.level, 'name', '', 'open', ''))"
    data = steps if isinstance(steps, str) else f"array({', '.join(map(_step_literal, steps))})"
    return fold(data, f"CAST({begin} AS {ELEMENTS})", lambda contexts, step: f"CAST({advance(contexts, step)} AS {ELEMENTS})")


def _texts_of(texts: str, element: str, base: str = "0") -> str:
    return f"slice({texts}, {element}.el - {base} + 1, {element}.end - {element}.el)"


def text_sql(texts: str, element: str, base: str = "0") -> str:
    """All text nodes of an element, each stripped, joined without a separator."""
    return f"array_join({_texts_of(texts, element, base)}, '')"


def node_list_sql(page: str, element: str) -> str:
    """The text nodes of an element as they stand."""
    return keep(_texts_of(f"{page}.nodes", element), lambda node: f"{node} <> ''")


def matches_sql(page: str, steps: list[Step] | str, inside: str = "false") -> str:
    """Matched elements (:data:`MATCHES`) of a page; ``inside`` tells whether to keep what is in them."""

    def match(e: str) -> str:
        most = f"greatest(least({e}.end - {e}.el - 1, size({page}.elements)), 0)"
        within = f"slice({page}.elements, {e}.idx + 1, {most})"
        content = f"""'inside', CAST(array() AS {ELEMENTS}), 'texts', CAST(array() AS array<string>)"""
        if inside != "false":
            content = f"""'inside', if({inside}, {within}, CAST(array() AS {ELEMENTS})),
                'texts', if({inside}, {_texts_of(f'{page}.texts', e)}, CAST(array() AS array<string>))"""
        return f"""named_struct('el', {e}.el, 'end', {e}.end, 'idx', {e}.idx, 'level', {e}.level,
            'open', {e}.open, 'text', {text_sql(f'{page}.texts', e)}, {content})"""

    return f"CAST({each(select_sql(f'{page}.elements', steps), match)} AS {MATCHES})"


def inner_sql(match: str, steps: list[Step] | str) -> str:
    """The elements that a selector picks inside a match."""
    return select_sql(f"{match}.inside", steps, match)


def link_tags_sql(markup: str) -> str:
    """Every ``<a>`` open tag of prepared markup, in page order."""
    pattern = raw(r"""(?i)<a(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
    return f"regexp_extract_all({markup}, {pattern}, 0)"


def link_tags(markup: str) -> Column:
    return F.expr(link_tags_sql(markup))


def charset_sql(markup: str) -> str:
    """Charset a page declares: ``<meta charset>``, else its content type, else utf-8."""
    pattern = raw(r"""(?i)<meta(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")

    def declared(metas: str) -> str:
        def first_of(value: Body) -> str:
            return first(keep(each(metas, value), lambda v: f"{v} IS NOT NULL"))

        own = first_of(lambda tag: f"nullif({attribute_sql(tag, 'charset')}, '')")
        content = first_of(
            lambda tag: f"if(lower({attribute_sql(tag, 'http-equiv')}) = 'content-type', "
            f"{attribute_sql(tag, 'content')}, NULL)"
        )
        typed = f"regexp_extract(lower({content}), {raw(r'charset=\s*([\w.:\-]+)')}, 1)"
        return f"coalesce({own}, nullif({typed}, ''), 'utf-8')"

    return let(f"regexp_extract_all({markup}, {pattern}, 0)", declared)


def charset_of(markup: str) -> Column:
    return F.expr(charset_sql(markup))
