"""The path language, compiled to columns over VARIANT.

A path is fields, subscripts and wildcards: ``metadata.annotations["a.b/c"]``, ``spec.containers[*].image``,
``status.addresses[0]``. It yields all matches in order; what is missing or of another type yields none, never an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewloom.functions.text import let, number_text

_TOKEN = re.compile(r"(?P<dot>\.)|(?P<name>[A-Za-z_][A-Za-z0-9_-]*)|\[(?P<sub>[^\]]*)\]")
_INTEGER = re.compile(r"\s*([+-]?\d+)")


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class Wildcard:
    pass


Step = Field | Index | Wildcard


def _subscript(text: str, path: str) -> Step:
    text = text.strip()
    if text == "*":
        return Wildcard()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return Field(text[1:-1])
    if number := _INTEGER.match(text):
        return Index(int(number[1]))
    raise ValueError(f"path {path!r}: subscript [{text}] is neither *, a quoted key nor an index")


def parse_path(path: str) -> list[Step]:
    """The steps of a path. Raises ValueError if it has none or is malformed; a dot at the end is allowed."""
    text = path.strip()
    if text.startswith("{") and text.endswith("}"):
        text = text[1:-1].strip()
    text = text.removeprefix(".").removeprefix("$.")
    steps: list[Step] = []
    at, after_dot, may_name = 0, False, True
    while at < len(text):
        token = _TOKEN.match(text, at)
        if not token or (token["dot"] and (after_dot or not steps)) or (token["name"] and not may_name):
            raise ValueError(f"path {path!r} is malformed at {text[at:]!r}")
        if token["dot"]:
            after_dot, may_name = True, True
        else:
            steps.append(Field(token["name"]) if token["name"] else _subscript(token["sub"], path))
            after_dot, may_name = False, token["name"] is None
        at = token.end()
    if not steps:
        raise ValueError(f"path {path!r} is empty")
    return steps


def _quoted(step: Step) -> str:
    if isinstance(step, Index):
        return f"[{step.at}]"
    mark = '"' if "'" in step.name else "'"
    if mark in step.name:
        raise ValueError(f"key {step.name!r} has both kinds of quotes")
    return f"[{mark}{step.name}{mark}]"


def _place(steps: list[Step]) -> str:
    return "$" + "".join(map(_quoted, steps))


def _none(steps: list[Step]) -> bool:
    """Whether steps lead nowhere, since an index is negative."""
    return any(isinstance(s, Index) and s.at < 0 for s in steps)


def _fixed(values: Column, steps: list[Step]) -> Column:
    """Matches of steps without a wildcard, in one lookup."""
    if _none(steps):
        return F.slice(values, 1, 0)
    place = _place(steps)
    found = F.transform(values, lambda v: F.try_variant_get(v, place, "variant"))
    last_is_field = isinstance(steps[-1], Field)
    return F.filter(found, lambda v: v.isNotNull() & ~F.is_variant_null(v) if last_is_field else v.isNotNull())


def _below(value: Column, place: str = "$") -> Column:
    """What stands in the array or object at a place: elements in order, or values in the order of their keys."""
    entries = F.try_variant_get(value, place, "map<string,variant>")
    in_order = F.transform(F.array_sort(F.map_keys(entries)), lambda k: F.element_at(entries, k))
    return F.coalesce(F.try_variant_get(value, place, "array<variant>"), in_order, F.array().cast("array<variant>"))


def _all(values: Column) -> Column:
    """Elements of arrays in order, and values of objects in the order of their keys."""
    return F.flatten(F.transform(values, lambda v: _below(v)))


def matches(value: Column, steps: list[Step]) -> Column:
    """All matches of a path in a VARIANT column, as an array of VARIANT; null if the value is null."""
    found, run = F.when(value.isNotNull(), F.array(value)), []
    first = next((k for k, s in enumerate(steps) if isinstance(s, Wildcard)), None)
    if first is not None and not _none(steps[:first]):  # up to the first wildcard there is one value at most: one lookup finds it
        found, steps = F.when(value.isNotNull(), _below(value, _place(steps[:first]))), steps[first + 1 :]
    for step in steps:
        if isinstance(step, Wildcard):
            found, run = _all(_fixed(found, run) if run else found), []
        else:
            run.append(step)
    return _fixed(found, run) if run else found


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def item_matches(item: Column, steps: list[Step]) -> Column:
    """Matches in an item of an expanded array. One that is no object stands under the key ``_`` of an object."""
    first, rest = steps[0], steps[1:]
    wrapped = F.array().cast("array<variant>")
    if first == Field("_") or isinstance(first, Wildcard):
        wrapped = matches(item, rest) if rest else F.array(item)
    return F.when(is_object(item), matches(item, steps)).otherwise(wrapped)


def text_of(value: Column) -> Column:
    """A scalar's text; objects and arrays are JSON text; null is null."""

    return let(F.try_variant_get(value, "$", "string"), lambda plain: _written(plain, value, F.try_variant_get(value, "$", "double")))


def _written(plain: Column, value: Column, number: Column) -> Column:
    """The text of a value. Only what begins like a number can be one, and only those that have a fraction are written otherwise."""
    fraction = F.substring(plain, 1, 1).between("-", "9") & F.schema_of_variant(value).rlike("^(DOUBLE|FLOAT|DECIMAL)")
    return F.when(fraction, number_text(number)).otherwise(plain)


def first_text(found: Column) -> Column:
    """The first text that is neither missing nor empty."""
    return F.get(F.filter(F.transform(found, text_of), lambda t: t.isNotNull() & (t != "")), F.lit(0))


def first_at(value: Column, steps: list[Step]) -> Column:
    """The first non-empty text of a path. Without a wildcard there is at most one match, which one lookup finds."""
    if any(isinstance(s, Wildcard) for s in steps):
        return first_text(matches(value, steps))
    if _none(steps):
        return F.lit(None).cast("string")
    # no ``let``: generated code computes the plain text once, and the lookups of numbers only where it begins like one
    plain, found, number = (F.try_variant_get(value, _place(steps), t) for t in ("string", "variant", "double"))
    return _written(plain, found, number)


def first_in_item(item: Column, steps: list[Step]) -> Column:
    """The first non-empty text of a path in an item of an expanded array."""
    if isinstance(steps[0], Field) and steps[0].name != "_":
        return first_at(item, steps)  # finds nothing in an item that is no object
    return first_text(item_matches(item, steps))


def first_of(values: list[Column], default: str) -> Column:
    """The first of several texts that is neither missing nor empty, or the default."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(default))


def compiled(path: str) -> Callable[[Column], Column]:
    """The first non-empty text of a path, as a function of the VARIANT column that it is evaluated on."""
    steps = parse_path(path)
    return lambda value: first_at(value, steps)
