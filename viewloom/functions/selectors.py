"""Label and field selectors, compiled to boolean columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewloom.functions.paths import compiled

#: Fields that may be selected by, for each kind (fixed values of the object API).
FIELDS = {"Pod": ("metadata.name", "metadata.namespace", "spec.nodeName", "spec.restartPolicy", "spec.schedulerName", "spec.serviceAccountName", "spec.hostNetwork", "status.phase", "status.podIP", "status.nominatedNodeName"), "Node": ("metadata.name", "spec.unschedulable")}
_OTHER_FIELDS = ("metadata.name", "metadata.namespace")

_SET = re.compile(r"^(\S+)\s+(in|notin)\s*\(([^()]*)\)$")
_EQUALS = re.compile(r"^([^\s=!()]+)\s*(==|=|!=)\s*([^\s=!()]*)$")
_EXISTS = re.compile(r"^(!?)\s*([^\s=!(),]+)$")


def _terms(text: str) -> list[str]:
    """Terms between commas that stand outside parentheses."""
    terms = [t.strip() for t in re.split(r",(?![^()]*\))", text)] if text.strip() else []
    if not all(terms):
        raise ValueError(f"selector {text!r} has an empty term")
    return terms


def label_terms(text: str) -> list[tuple[str, str, list[str]]]:
    """A label selector as (label, test, values), joined by AND; tests are in, notin, there and missing.

    ``!=`` and ``notin`` hold where the label is missing, too.
    """
    found = []
    for term in _terms(text):
        if m := _SET.match(term):
            found.append((m[1], m[2], [v.strip() for v in m[3].split(",")]))
        elif m := _EQUALS.match(term):
            found.append((m[1], "notin" if m[2] == "!=" else "in", [m[3]]))
        elif m := _EXISTS.match(term):
            found.append((m[2], "missing" if m[1] else "there", []))
        else:
            raise ValueError(f"selector {text!r}: cannot read {term!r}")
    return found


def label_selector(text: str, label: Callable[[str], Column]) -> Column:
    """Whether labels fit; ``label`` gives the column of a label, null where there is none."""
    fits = F.lit(True)
    for name, test, values in label_terms(text):
        one_of = F.coalesce(label(name).isin(values), F.lit(False)) if values else label(name).isNotNull()
        fits &= one_of if test in ("in", "there") else ~one_of
    return fits


def field_terms(text: str, kind: str) -> list[tuple[str, bool, str]]:
    """A field selector as (path, whether equal or not, value), joined by AND."""
    found = []
    for term in _terms(text):
        m = _EQUALS.match(term)
        if not m:
            raise ValueError(f"selector {text!r}: cannot read {term!r}")
        if m[1] not in FIELDS.get(kind, _OTHER_FIELDS):
            raise ValueError(f"selector {text!r}: {kind} cannot be selected by {m[1]!r}")
        found.append((m[1], m[2] != "!=", m[3]))
    return found


def field_selector(text: str, kind: str, field: Callable[[str], Column]) -> Column:
    """Whether fields fit; ``field`` gives the column of a field. Missing fields count as empty."""
    fits = F.lit(True)
    for path, equal, value in field_terms(text, kind):
        same = F.coalesce(field(path), F.lit("")) == value
        fits &= same if equal else ~same
    return fits


def object_labels(value: Column) -> Callable[[str], Column]:
    """Labels of a VARIANT object."""
    labels = F.try_variant_get(value, "$.metadata.labels", "map<string,string>")
    return lambda name: F.try_element_at(labels, F.lit(name))


def object_fields(value: Column) -> Callable[[str], Column]:
    """Fields of a VARIANT object."""
    return lambda path: compiled(path)(value)
