"""Small helpers to write nested Spark SQL expressions as text.

An expression over markup nests dozens of lambda functions. Written as text it is
parsed in one call; built from Column objects it would take thousands of calls between
Python and the JVM before any work starts.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

_numbers = itertools.count()

Body = Callable[[str], str]


def raw(pattern: str) -> str:
    """A raw string literal; a single quote is written as its regex escape."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def quoted(value: str | None) -> str:
    """A plain string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: Iterable[str]) -> str:
    return f"CAST(array({', '.join(map(quoted, values))}) AS ARRAY<STRING>)"


def fresh() -> str:
    return f"x_{next(_numbers)}"


def fresh_lambda(body: Body) -> str:
    name = fresh()
    return f"{name} -> {body(name)}"


def let(value: str, body: Body) -> str:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return f"transform(array({value}), {fresh_lambda(body)})[0]"


def each(array: str, body: Body) -> str:
    return f"transform({array}, {fresh_lambda(body)})"


def keep(array: str, body: Body) -> str:
    return f"filter({array}, {fresh_lambda(body)})"


def fold(array: str, zero: str, step: Callable[[str, str], str], finish: Body | None = None) -> str:
    state, item = fresh(), fresh()
    last = f", {fresh_lambda(finish)}" if finish else ""
    return f"aggregate({array}, {zero}, ({state}, {item}) -> {step(state, item)}{last})"


def first(array: str) -> str:
    return f"try_element_at({array}, 1)"
