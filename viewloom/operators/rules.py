"""Rules compiled to plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.paths import Field, first_at, first_in_item, first_of, matches, parse_path
from viewloom.functions.text import object_key
from viewloom.model import API_VERSIONS, Extract, Rule
from viewloom.operators.resolve import DEFAULT_HOPS, bound, walked


def _text(path: str) -> Column:
    """A path's first text on an object; kind and apiVersion are known even if the object does not say them."""
    steps = parse_path(path)
    found = first_at(F.col("object"), steps)
    if steps == [Field("kind")]:
        return F.coalesce(F.nullif(found, F.lit("")), F.col("kind"))
    if steps == [Field("apiVersion")]:
        versions = F.create_map(*(F.lit(x) for pair in API_VERSIONS.items() for x in pair))
        return F.coalesce(F.nullif(found, F.lit("")), F.try_element_at(versions, F.col("kind")))
    return found


def hops_of(rule: Rule, hops: int) -> int:
    """Rules that read only the anchor and its items need no walk."""
    return 0 if rule.sources() <= {"anchor", "item", rule.anchor} else hops


def paths_of(*rules: Rule) -> list[str]:
    """The paths that rules read of objects, each once."""
    return list(dict.fromkeys(e.path for r in rules for n in r.label_names() for e in r.labels[n].every() if r.resolved(e.source) != "item"))


def texts_of(paths: list[str]) -> Column:
    """What a walk carries of each object: the texts of ``paths``."""
    return F.struct(F.lit(True).alias("here"), *(_text(p).alias(f"t{k}") for k, p in enumerate(paths)))


def payload_of(state: DataFrame, paths: list[str]) -> Column:
    """The texts of ``paths`` on a state's objects: those that it holds ready in a column ``texts``, else read from the objects."""
    return F.col("texts") if "texts" in state.columns else texts_of(paths)


def evaluated(rule: Rule, state: DataFrame, *, hops: int = DEFAULT_HOPS, only: DataFrame | None = None, chains: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """The rule's rows: anchor_key, its labels in order as non-null strings, and value 1; distinct for each anchor.

    An anchor whose array to expand is empty or missing has no row. Each path is read where its object is scanned: the
    walk carries texts, not objects. ``only`` (anchor_key) restricts the anchors. ``chains`` are owners' chains that several
    rules share; they carry the texts of ``paths``.
    """
    paths = paths_of(rule) if paths is None else paths
    items = {"__items": matches(F.col("object"), parse_path(rule.for_each))} if rule.for_each else {}
    rows = walked(state, rule.anchor, hops=hops_of(rule, hops), payload=payload_of(state, paths), only=only, chains=chains, more=items)
    sources = bound(rows)
    used = sorted({rule.resolved(e.source) for n in rule.label_names() for e in rule.labels[n].every()} - {"item"})
    rows = rows.select(object_key(F.col("namespace"), F.col("name")).alias("anchor_key"), *items, *(sources[s].alias(f"__{s}") for s in used))
    if rule.for_each:
        # an outer explode, since a plain one adds a filter on the array, which would find its matches three times over
        rows = rows.select("*", F.posexplode_outer("__items").alias("__at", "__item")).where("__at is not null").drop("__at", "__items")

    def text(extract: Extract) -> Column:
        source = rule.resolved(extract.source)
        if source == "item":
            return first_in_item(F.col("__item"), parse_path(extract.path))
        return F.col(f"__{source}")[f"t{paths.index(extract.path)}"]

    labels = [first_of([text(e) for e in rule.labels[n].every()], rule.labels[n].on_missing).alias(n) for n in rule.label_names()]
    return rows.select("anchor_key", *labels).dropDuplicates(["anchor_key", *rule.label_names()]).withColumn("value", F.lit(1.0))
