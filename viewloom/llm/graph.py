"""Connected components of an edge table, without ever collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import dropped, stored


def _stars(arcs: DataFrame) -> DataFrame:
    """Each arc (u, v) with the least neighbour of u, u itself included, as m."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to its least neighbour."""
    arcs = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(arcs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _stars(down)
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(met.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(u, v): each node of ``edges`` (u, v), but for the least of its component, with that least node.

    Large-star and small-star rounds take turns until the edges are stars; the number of rounds grows with the
    logarithm of the longest path. Each round's edges go to the shared checkpoint folder, so a lost executor costs one
    round. Null ends and loops are ignored. An empty table gives an empty result.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen = state
        nxt = stored(_small(_large(now)), "edges")
        dropped(now)
        now = nxt
    raise RuntimeError(f"no components after {rounds} rounds")
