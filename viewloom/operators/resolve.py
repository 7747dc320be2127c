"""Ownership: from objects to their controllers, hop by hop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.functions.text import object_key
from viewloom.model import KINDS, TOP_KINDS
from viewloom.sources.places import written

#: The longest chain that is followed (fixed value).
MAX_HOPS = 8
DEFAULT_HOPS = MAX_HOPS
#: Columns that hold the key of an object's controller.
PARENT = ["parent_kind", "parent_ns", "parent_name"]


def controller(refs: Column) -> Column:
    """Of an array of (kind, name, controller): the first that is marked as controller, else the first, else null."""
    marked = F.filter(refs, lambda r: F.coalesce(r["controller"], F.lit(False)))
    return F.coalesce(F.get(marked, F.lit(0)), F.get(refs, F.lit(0)))


def owner_refs(text: Column) -> Column:
    """Owner references of an object's JSON, as an array of (kind, name, controller)."""
    return F.from_json(text, "metadata struct<ownerReferences: array<struct<kind: string, name: string, controller: boolean>>>")["metadata"]["ownerReferences"]


def lookup_namespace(kind: Column, namespace: Column) -> Column:
    """The namespace that an object of a kind is found under: none for nodes."""
    return F.when(kind == "Node", "").otherwise(namespace)


def with_parent(log: DataFrame) -> DataFrame:
    """A change log with the key of each object's controller (PARENT), null where there is none.

    Owners of unsupported kinds end the walk. This comes before versions are reduced to the latest, so that joins and
    their filters meet plain columns and parse nothing.
    """
    found = log.withColumn("__ref", controller(owner_refs(F.col("object"))))
    kind = F.when(F.col("__ref")["kind"].isin(*KINDS), F.col("__ref")["kind"])
    return found.withColumns({"parent_kind": kind, "parent_ns": F.when(kind.isNotNull(), lookup_namespace(kind, F.col("namespace"))), "parent_name": F.when(kind.isNotNull(), F.col("__ref")["name"])}).drop("__ref")


def owner_chains(state: DataFrame, *, hops: int = DEFAULT_HOPS, payload: Column | None = None, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(k, ns, n, chain): for each object that some object names as its controller, the objects from itself upwards, ``hops`` at most.

    Each is a struct (kind, namespace, name, uid, object, parent...); ``payload`` takes the object's place, so that joins
    carry no more than what is read of it. The last one tells where the walk would go on. Chains are doubled: those of
    2^k objects go on with the chain of the object that their last one names. So eight hops take three joins among owners
    at most, fewer if no chain goes on. ``keep`` writes the tables between. One table serves all rules and anchors.
    """
    hops = min(hops, MAX_HOPS)
    named = state.where(F.col("parent_name").isNotNull()).select(F.col("parent_kind").alias("k"), F.col("parent_ns").alias("ns"), F.col("parent_name").alias("n")).distinct()
    own = state.select(F.col("kind").alias("k"), lookup_namespace(F.col("kind"), F.col("namespace")).alias("ns"), F.col("name").alias("n"), F.array(_self(payload)).alias("chain"))
    chains = keep(own.join(named, ["k", "ns", "n"], "left_semi"), "owners")
    length = 1
    while length < hops:
        last = F.element_at("chain", -1)
        # shorter ones have ended already: they name no owner, or one that is not there
        keys = (F.size("chain") == length) & (F.col("__k") == last["parent_kind"]) & (F.col("__ns") == last["parent_ns"]) & (F.col("__n") == last["parent_name"])
        more = chains.select(F.col("k").alias("__k"), F.col("ns").alias("__ns"), F.col("n").alias("__n"), F.col("chain").alias("__more"))
        if chains.join(more.drop("__more"), keys, "left_semi").isEmpty():
            break
        joined = chains.join(more, keys, "left")
        chains = keep(joined.select("k", "ns", "n", F.slice(F.concat("chain", F.coalesce("__more", F.slice("chain", 1, 0))), 1, hops).alias("chain")), "chains")
        length *= 2
    return chains


def _self(payload: Column | None) -> Column:
    return F.struct("kind", "namespace", "name", "uid", (F.col("object") if payload is None else payload).alias("object"), "parent_kind", "parent_ns", "parent_name")


def walked(state: DataFrame, anchor_kind: str, *, hops: int = DEFAULT_HOPS, payload: Column | None = None, only: DataFrame | None = None, chains: DataFrame | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(kind, namespace, name, self, chain, hops, more...): anchors of a kind with the objects that the walk finds, nearest first.

    ``chains`` are those of the owners, with the same ``payload`` and ``hops``; they are made if there are none. Anchors
    that name an owner come to them by one left join, the others by none. ``hops`` bounds cycles, at most MAX_HOPS;
    ``only`` (anchor_key) leaves other anchors out. ``more`` are columns read of the anchors.
    """
    hops = min(hops, MAX_HOPS)
    anchors = state.where(F.col("kind") == anchor_kind)
    if only is not None:
        anchors = anchors.withColumn("anchor_key", object_key(F.col("namespace"), F.col("name"))).join(only, "anchor_key", "left_semi")
    added = {} if more is None else more
    rows = anchors.select("kind", "namespace", "name", _self(payload).alias("self"), *(c.alias(n) for n, c in added.items()))
    none = F.slice(F.array("self"), 1, 0)
    if not hops:
        return rows.select("kind", "namespace", "name", "self", none.alias("chain"), F.lit(0).alias("hops"), *added)
    up = owner_chains(state, hops=hops, payload=payload) if chains is None else chains
    first = F.col("self")
    owned = rows.where(first["parent_name"].isNotNull())
    found = owned.join(up, (F.col("k") == first["parent_kind"]) & (F.col("ns") == first["parent_ns"]) & (F.col("n") == first["parent_name"]), "left").withColumn("chain", F.coalesce(F.slice("chain", 1, hops), none))
    alone = rows.where(first["parent_name"].isNull()).withColumn("chain", none)
    columns = ["kind", "namespace", "name", "self", "chain", *added]
    return found.select(*columns).unionByName(alone.select(*columns)).withColumn("hops", F.lit(hops))


def bound(rows: DataFrame) -> dict[str, Column]:
    """The object (or payload) of each source on walked rows: anchor, ownerController, topController, and one for each kind.

    The top controller is the deepest one of a top kind, the anchor included; a kind's object is the last on the chain.
    """
    chain, own = F.col("chain"), F.col("self")

    def last(kinds: tuple[str, ...]) -> Column:
        above = F.filter(chain, lambda h: h["kind"].isin(*kinds))
        return F.when(F.size(above) > 0, F.element_at(above, -1)["object"]).when(own["kind"].isin(*kinds), own["object"])

    return {"anchor": own["object"], "ownerController": F.get(chain, F.lit(0))["object"], "topController": last(TOP_KINDS)} | {k: last((k,)) for k in KINDS}


def parent_uids(rows: DataFrame) -> Column:
    """Distinct, non-empty uids along the chain, the anchor's own included."""
    return F.array_distinct(F.filter(F.concat(F.array(F.col("self")["uid"]), F.transform("chain", lambda h: h["uid"])), lambda u: u.isNotNull() & (u != "")))


def unresolved(rows: DataFrame) -> Column:
    """The key of the parent at which the walk missed, as (kind, namespace, name); null if it ended, or went as far as it may."""
    top = F.try_element_at("chain", F.lit(-1))
    kind, namespace, name = (F.when(F.size("chain") > 0, top[p]).otherwise(F.col("self")[p]) for p in PARENT)  # by fields, so that no payload is read
    return F.when((F.size("chain") < F.col("hops")) & name.isNotNull(), F.struct(kind.alias("kind"), namespace.alias("namespace"), name.alias("name")))
