"""Definitions: the user's declarative query, from JSON to a table of selectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import markup
from gleaner.functions.sqltext import each
from gleaner.functions.urls import registered_domain

# Fields of a level that are read, with the type each must have.
FIELDS = {
    "addr": "string",
    "type": "int",
    "level": "int",
    "parent": "string",
    "wrap": "int",
    "limit": "int",
    "selectors": "array<variant>",
    "pagination.limit": "int",
    "pagination.selector.xpath": "string",
    "yaxisXpath": "string",
    "xaxisXpath": "string",
    "timeXAxis": "boolean",
}
# Fields of a selector.
SELECTOR_FIELDS = {
    "xpath": "string",
    "extract": "int",
    "subselectors": "array<variant>",
    "linkselector.xpath": "string",
}
#: The type whose levels name axes instead of selectors, and the one without a collector.
SERIES_TYPE, NO_COLLECTOR = 4, 5


def _field(body: str, path: str, kind: str) -> str:
    """A field of a variant, NULL where it is missing or has another type."""
    return f"try_variant_get({body}, '$.{path}', '{kind}')"


def _misfit(body: str, path: str, kind: str) -> str:
    """Whether a field is there, is not null and does not have its type."""
    value = f"try_variant_get({body}, '$.{path}', 'variant')"
    present = f"{value} IS NOT NULL AND NOT is_variant_null({value})"
    nested = f"rlike(schema_of_variant({value}), '^(?:OBJECT|ARRAY)')"
    wrong = f"{_field(body, path, kind)} IS NULL" + (f" OR {nested}" if kind == "string" else "")
    return f"({present} AND ({wrong}))"


def _is_object(value: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), 'OBJECT'), false)"


def project_tasks(materials: DataFrame) -> DataFrame:
    """Materials to tasks: type and address out of the definition, domain of the address.

    An address without a known domain ending keeps its row with a NULL domain.
    """
    url = F.get_json_object("definition", "$.addr")
    return materials.select(
        "pid",
        "material_id",
        "uuid",
        F.get_json_object("definition", "$.type").cast("int").alias("type"),
        url.alias("url"),
        registered_domain(url).alias("domain"),
        "definition",
    )


def levels(materials: DataFrame) -> DataFrame:
    """One row per level of each definition: ``material_id, root_type, phase, body`` (a variant).

    A definition is parsed once; its levels are found inside the row, each from the one above
    it, however deep they go. What is no JSON object gives no level.
    """
    child = "try_variant_get(element_at(found, -1), '$.child', 'variant')"
    most = "regexp_count(definition, '\"child\"')"
    listed = f"""aggregate(slice(sequence(0, {most}), 2, {most}), array(whole),
        (found, n) -> if({_is_object(child)}, concat(found, array({child})), found))"""
    whole = materials.select("material_id", "definition", F.expr("try_parse_json(definition)").alias("whole"))
    known = whole.filter(F.expr(_is_object("whole")))
    return known.select(
        "material_id", F.expr(_field("whole", "type", "int")).alias("root_type"), F.posexplode(F.expr(listed)).alias("pos", "body")
    ).select("material_id", "root_type", (F.col("pos") + 1).alias("phase"), "body")


def flatten(materials: DataFrame) -> DataFrame:
    """Nested definitions to one row per (material, phase, selector).

    Children become phases 2, 3, ... to any depth; the selectors of one phase are numbered
    from 1, and a child without a type has that of its definition. Selectors outside the
    supported forms stay, with NULL ``steps``. :func:`rejects` lists those, and whatever else
    of a definition gives no row here. Numbers may be written as text.
    """
    of = lambda path: F.expr(_field("body", path, FIELDS[path]))
    part = lambda path: F.expr(_field("selector", path, SELECTOR_FIELDS[path]))
    rows = levels(materials).select(
        "material_id",
        "phase",
        of("addr").alias("addr"),
        F.coalesce(of("type"), "root_type").alias("type"),
        F.coalesce(of("level"), "phase").alias("level"),
        F.coalesce(of("parent"), F.lit("")).alias("parent"),
        F.coalesce(of("wrap"), F.lit(0)).alias("wrap"),
        F.coalesce(of("limit"), F.lit(-1)).alias("item_limit"),
        of("pagination.limit").alias("page_limit"),
        of("pagination.selector.xpath").alias("next_xpath"),
        F.posexplode(of("selectors")).alias("selector_pos", "selector"),
    )
    subs = f"transform(coalesce({_field('selector', 'subselectors', 'array<variant>')}, array()), s -> {_field('s', 'xpath', 'string')})"
    numbered = rows.withColumns(
        {
            "selector_no": F.col("selector_pos") + 1,
            "xpath": part("xpath"),
            "extract": F.coalesce(part("extract"), F.lit(0)),
            "sub_xpaths": F.expr(subs),
            "link_xpath": part("linkselector.xpath"),
        }
    )
    return numbered.withColumns(
        {
            "steps": markup.step_column("xpath"),
            "sub_steps": F.expr(each("sub_xpaths", markup.step_sql)),
            "link_steps": markup.step_column("link_xpath"),
        }
    ).drop("selector_pos", "selector")


def series(materials: DataFrame) -> DataFrame:
    """Series definitions: selectors of both axes, or a time axis instead of the second."""
    of = lambda path: F.expr(_field("d", path, FIELDS[path]))
    clock = F.coalesce(of("timeXAxis"), F.lit(False))
    return (
        materials.select("material_id", F.expr("try_parse_json(definition)").alias("d"))
        .select("material_id", of("yaxisXpath").alias("y"), of("xaxisXpath").alias("x"), clock.alias("time_axis"))
        .filter("y is not null")
        .select(
            "material_id",
            markup.step_column("y").alias("y_steps"),
            F.when(~F.col("time_axis"), markup.step_column("x")).alias("x_steps"),
            "time_axis",
        )
    )


def is_supported() -> Column:
    """Whether every selector of a flattened row has one of the supported forms."""
    return (
        F.col("steps").isNotNull()
        & F.forall("sub_steps", lambda s: s.isNotNull())
        & (F.col("link_xpath").isNull() | F.col("link_steps").isNotNull())
    )


def rejects(materials: DataFrame) -> DataFrame:
    """What a run cannot use: ``material_id, phase, reason, text``. The other rows go on.

    Each level of each definition either gives a usable selector (or axis) or is here:

    * ``not a definition`` (phase 0): the text is no JSON object;
    * ``unsupported selector``: the text of a selector outside the supported forms;
    * ``bad field``: the path of a field of another type, which counts as missing;
    * ``no selector``, ``no axis``: a level that names none, by the type it has.
    """
    whole = F.expr(_is_object("try_parse_json(definition)"))
    broken = materials.filter(~whole).select(
        "material_id", F.lit(0).alias("phase"), F.lit("not a definition").alias("reason"),
        F.col("definition").alias("text"),
    )
    bad = F.when(F.col("steps").isNull(), F.coalesce("xpath", F.lit(""))).otherwise(
        F.coalesce(F.when(F.col("link_steps").isNull(), F.col("link_xpath")), F.array_join("sub_xpaths", " ", "?"))
    )
    unsupported = flatten(materials).filter(~is_supported()).select(
        "material_id", "phase", F.lit("unsupported selector").alias("reason"), bad.alias("text")
    )
    found = levels(materials)
    child = "try_variant_get(body, '$.child', 'variant')"
    lost_child = f"{child} IS NOT NULL AND NOT is_variant_null({child}) AND NOT {_is_object(child)}"
    paths = [f"if({_misfit('body', path, kind)}, '$.{path}', NULL)" for path, kind in FIELDS.items()]
    paths.append(f"if({lost_child}, '$.child', NULL)")
    inner = [
        f"if({_misfit('s', path, kind)}, concat('$.selectors[', i, '].{path}'), NULL)" for path, kind in SELECTOR_FIELDS.items()
    ]
    selectors = f"coalesce({_field('body', 'selectors', 'array<variant>')}, array())"
    misfits = f"filter(concat(array({', '.join(paths)}), flatten(transform({selectors}, (s, i) -> array({', '.join(inner)})))), x -> x is not null)"
    fields = found.select("material_id", "phase", F.lit("bad field").alias("reason"), F.explode(F.expr(misfits)).alias("text"))
    kind = F.coalesce(F.expr(_field("body", "type", "int")), "root_type", F.lit(0))
    missing = (
        F.when((kind == SERIES_TYPE) & F.expr(_field("body", "yaxisXpath", "string")).isNull(), "no axis")
        .when(~kind.isin(SERIES_TYPE, NO_COLLECTOR) & (F.size(F.expr(selectors)) == 0), "no selector")
    )
    empty = found.select("material_id", "phase", missing.alias("reason"), F.lit(None).cast("string").alias("text"))
    axes = (
        series(materials)
        .join(materials.select("material_id", "definition"), "material_id")
        .filter("y_steps is null or (not time_axis and x_steps is null and get_json_object(definition, '$.xaxisXpath') is not null)")
        .select("material_id", F.lit(1).alias("phase"), F.lit("unsupported selector").alias("reason"),
                F.when(F.col("y_steps").isNull(), F.get_json_object("definition", "$.yaxisXpath")).otherwise(F.get_json_object("definition", "$.xaxisXpath")).alias("text"))
    )
    return broken.unionByName(unsupported).unionByName(fields).unionByName(empty.filter("reason is not null")).unionByName(axes)


def require_supported(selectors: DataFrame) -> DataFrame:
    """The same rows; reading an unsupported selector fails the job and names it."""
    message = F.concat(F.lit("unsupported selector: "), F.coalesce("xpath", F.lit("none")))
    return selectors.withColumn(
        "steps", F.when(is_supported(), F.col("steps")).otherwise(F.raise_error(message))
    )
