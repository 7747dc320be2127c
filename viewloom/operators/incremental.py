"""Keeping views current: dependencies, affected anchors, and replacement of an anchor's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.text import object_key
from viewloom.operators.resolve import DEFAULT_HOPS, parent_uids, unresolved, walked


def dependencies(state: DataFrame, kind: str, *, hops: int = DEFAULT_HOPS, only: DataFrame | None = None, chains: DataFrame | None = None, payload: Column | None = None) -> DataFrame:
    """(anchor_key, anchor_kind, namespace, name, parent_uid, wanted): a row for each object an anchor depends on, and one for a parent not there yet.

    ``chains`` are the owners' chains, if they are there already, and ``payload`` what they carry of each object.
    """
    rows = walked(state, kind, hops=hops, payload=F.lit(True) if payload is None else payload, only=only, chains=chains)
    none = F.lit(None).cast("struct<kind:string,namespace:string,name:string>")
    parents = F.transform(parent_uids(rows), lambda uid: F.struct(uid.alias("parent_uid"), none.alias("wanted")))
    if hops:
        missing = F.struct(F.lit(None).cast("string").alias("parent_uid"), unresolved(rows).alias("wanted"))
        parents = F.concat(parents, F.filter(F.array(missing), lambda p: p["wanted"].isNotNull()))
    # both kinds of parents from one walk; an outer explode, since a plain one adds a filter that would put them together twice
    found = rows.select("namespace", "name", F.explode_outer(parents).alias("parent")).where("parent is not null")
    return found.select(object_key(F.col("namespace"), F.col("name")).alias("anchor_key"), F.lit(kind).alias("anchor_kind"), "namespace", "name", "parent.parent_uid", "parent.wanted")


def affected(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(anchor_kind, anchor_key) of anchors that depend on a changed object, by uid or as the parent they miss.

    ``changed`` has kind, namespace, name and uid.
    """
    by_uid = deps.join(changed.select(F.col("uid").alias("parent_uid")).distinct(), "parent_uid", "left_semi")
    keys = changed.select(F.struct("kind", "namespace", "name").alias("wanted")).distinct()
    by_key = deps.where("wanted is not null").join(keys, "wanted", "left_semi")
    return by_uid.select("anchor_kind", "anchor_key").unionByName(by_key.select("anchor_kind", "anchor_key")).distinct()


def in_scope_of(anchors: DataFrame, parents: DataFrame) -> DataFrame:
    """Anchors in the namespace of a changed parent, or all if some parent has none: the fallback without an index."""
    places = parents.select("namespace").distinct()
    everywhere = places.where("namespace = ''").limit(1)
    if not everywhere.isEmpty():
        return anchors.distinct()
    return anchors.join(places, "namespace", "left_semi").distinct()


def replaced(target: DataFrame, changed: DataFrame, rows: DataFrame, key: str | list[str]) -> DataFrame:
    """``target`` with the rows of changed anchors replaced by theirs in ``rows``; without any there, they are gone."""
    return target.join(changed, key, "left_anti").unionByName(rows.select(*target.columns))


def stale(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``before`` that ``after`` lacks."""
    return before.join(after, keys, "left_anti")


def delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, op): ADDED rows of ``after`` and DELETED rows of ``before``."""
    new = after.join(before, keys, "left_anti").select(*keys, F.lit("ADDED").alias("op"))
    return new.unionByName(before.join(after, keys, "left_anti").select(*keys, F.lit("DELETED").alias("op")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
