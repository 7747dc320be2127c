"""Components of similar sets from candidates that meet in buckets.

Rows are (key, node, sketch): a node stands in the bucket of each of its keys, with a short sketch of its set. ``score``
compares sketches, row by row, and is negative where sets cannot be similar.

1. Proposals. In a bucket rows stand in an order that is random for each key, and each proposes the one that looks most
   similar among the ``LAGS`` before it. Buckets are dealt by ranges of that order, so one of any size is spread over
   tasks. Whole sets verify what is proposed, and the links give components. This joins the copies of a group at a cost
   of its size, for a node has many keys and so meets many of its group.
2. Clusters. Only buckets with nodes of several components can hold a link still missing. There, rows outside the
   bucket's most common component are compared with all others of other components, in cells of bounded size. What the
   sketches let through joins components to clusters; a cell passes on a forest, never its pairs.
3. The rest. In a cluster, nodes outside its most common component are compared with all others, again in cells, by
   sketches first and then by whole sets, which travel once for each cell and not for each pair. So no link between components
   is lost, whatever was proposed before, and no pair leaves its cell but one for each two components that are linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import dropped, over_texts, runs, stored
from viewloom.llm.graph import components

#: Rows before a row in its bucket among which it looks for the most similar one.
LAGS = 32
#: Rows of a side of a cell, on average: with sketches, and with whole sets.
CELL, SET_CELL = 1024, 256

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _sketches(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _mixed() -> Column:
    return F.xxhash64("key", "node")


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (key, node) of buckets of more than one node, dealt by ranges; at the edges of tasks some others may stay."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stays = None, True  # the last row of the batch before, and whether it is known to stay
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(0).to_numpy()
            goes_on = held is not None and held.column(0)[0].as_py() == keys[0]
            if held is not None and (stays or goes_on):
                yield held
            same = np.diff(keys) == 0
            before = np.concatenate(([goes_on or held is None], same))
            yield batch.slice(0, n - 1).filter(pa.array(before[:-1] | same))
            held, stays = batch.slice(n - 1), bool(before[-1])
        if held is not None:
            yield held

    return rows.repartitionByRange("key", _mixed()).sortWithinPartitions("key", _mixed()).mapInArrow(several, rows.schema)


def proposed(rows: DataFrame, score: Score) -> DataFrame:
    """(u, v): each row with the most similar of some before it in its bucket."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = 0 if held is None else held.num_rows
            whole = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            keys, nodes, sketch = whole.column("key").to_numpy(), whole.column("node").to_numpy(), _sketches(whole.column("sketch"), whole.num_rows)
            top, partner = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
            for lag in range(1, LAGS + 1):
                at = np.nonzero((keys[lag:] == keys[:-lag]) & (nodes[lag:] != nodes[:-lag]))[0] + lag
                at = at[at >= old]
                if not len(at):
                    break
                for lo in range(0, len(at), 1 << 15):
                    part = at[lo : lo + (1 << 15)]
                    found = score(sketch[part], sketch[part - lag])
                    won = part[found > top[part]]
                    top[won], partner[won] = found[found > top[part]], nodes[won - lag]
            at = np.nonzero(top >= 0)[0]
            yield _edges(nodes[at], partner[at])
            held = whole.slice(max(0, len(keys) - LAGS))

    return rows.repartitionByRange("key", _mixed()).sortWithinPartitions("key", _mixed()).select("key", "node", "sketch").mapInArrow(best, "u long, v long").distinct()


def _dealt(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``rows`` (group, node, root, ...) of groups with several roots, in cells: (cell, side, common, columns...).

    Rows whose root is not the group's most common one are odd. An odd row stands on the left (side 0) in all cells of its
    line, and every row on the right (side 1) in all cells of its column; a side of a cell has about ``size`` rows.
    """
    counts = rows.groupBy(group, "root").agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    here = rows.join(counts, group)
    lines, columns = F.ceil((F.col("n") - F.col("most")) / size).cast("int"), F.ceil(F.col("n") / size).cast("int")
    place = F.xxhash64("node", group)

    def cell(side: int, line: Column, column: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), line.alias("line"), column.alias("column"))

    left = F.when(F.col("root") != F.col("common"), F.transform(F.sequence(F.lit(0), columns - 1), lambda c: cell(0, F.pmod(place, lines).cast("int"), c)))
    right = F.transform(F.sequence(F.lit(0), lines - 1), lambda k: cell(1, k, F.pmod(place, columns).cast("int")))
    at = F.explode(F.concat(F.coalesce(left, F.slice(F.array(cell(0, F.lit(0), F.lit(0))), 1, 0)), right))
    own = [c for c in rows.columns if c != group]
    dealt = here.select(group, *own, "common", at.alias("at")).select(F.xxhash64(group, "at.line", "at.column").alias("cell"), F.col(group).alias("group"), "at.side", "common", *own)
    return dealt.repartition("cell").sortWithinPartitions("cell", "group", "side")


def _cells(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, int]]:
    """Each cell with odd rows, and where its right side begins."""
    for table in runs(batches, "cell", rows):
        cell, group, side = (table.column(c).to_numpy() for c in ("cell", "group", "side"))
        cuts = np.concatenate(([0], np.nonzero((np.diff(cell) != 0) | (np.diff(group) != 0))[0] + 1, [len(cell)]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if mid := int(np.searchsorted(side[lo:hi], 1)):
                yield table.slice(lo, hi - lo), mid


def _others(node: np.ndarray, root: np.ndarray, common: int, mid: int, i: int) -> np.ndarray:
    """Rows on the right that an odd row asks: of other components, and of two odd rows the larger one asks."""
    return mid + np.nonzero((root[mid:] != root[i]) & ((root[mid:] == common) | (node[mid:] < node[i])))[0]


def clusters(rooted: DataFrame, score: Score) -> DataFrame:
    """(u, v): each root of a cluster of several, but for the least, with that least root. ``rooted`` has (key, node, sketch, root)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, mid in _cells(batches, 10_000):
            node, root, common = (table.column(c).to_numpy() for c in ("node", "root", "common"))
            sketch, above = _sketches(table.column("sketch"), len(node)), {}

            def top(x: int, above: dict = above) -> int:
                while (y := above.get(x, x)) != x:
                    above[x] = x = above.get(y, y)
                return x

            us, vs = [], []
            for i in range(mid):
                other = _others(node, root, common[0], mid, i)
                if not len(other):
                    continue
                met = np.unique(root[other[score(np.broadcast_to(sketch[i], (len(other), sketch.shape[1])), sketch[other]) >= 0]])
                for r in met.tolist():
                    if (a := top(int(root[i]))) != (b := top(r)):
                        above[max(a, b)] = min(a, b)
                        us.append(a)
                        vs.append(b)
            if us:
                yield _edges(np.array(us, np.int64), np.array(vs, np.int64))

    return components(_dealt(rooted, "key", CELL).mapInArrow(join, "u long, v long"))


def settled(members: DataFrame, score: Score) -> DataFrame:
    """(u, v): links between components of a cluster, by whole sets. ``members`` has (cluster, node, root, sketch, hs)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, mid in _cells(batches, 2 * SET_CELL):
            node, root, common = (table.column(c).to_numpy() for c in ("node", "root", "common"))
            sketch, sets = _sketches(table.column("sketch"), len(node)), [np.asarray(x.values) for x in table.column("hs")]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            us, vs = [], []
            for i in range(mid):
                other = _others(node, root, common[0], mid, i)
                other = other[(4 * sizes[other] <= 5 * sizes[i]) & (4 * sizes[i] <= 5 * sizes[other])]
                other = other[score(np.broadcast_to(sketch[i], (len(other), sketch.shape[1])), sketch[other]) >= 0] if len(other) else other
                while len(other):  # some at a time; a component that is linked need not be asked again
                    part = other[: max(1, int(np.searchsorted(np.cumsum(sizes[other]), 200_000)))]
                    whole = np.concatenate([sets[j] for j in part.tolist()])
                    at = np.minimum(np.searchsorted(sets[i], whole), sizes[i] - 1)
                    both = np.add.reduceat(sets[i][at] == whole, np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                    near = part[9 * both >= 4 * (sizes[part] + sizes[i])]
                    roots, first = np.unique(root[near], return_index=True)
                    us += [node[i]] * len(first)
                    vs += node[near[first]].tolist()
                    other = other[len(part) :]
                    other = other[~np.isin(root[other], roots)]
            if us:
                yield _edges(np.array(us, np.int64), np.array(vs, np.int64))

    return _dealt(members, "cluster", SET_CELL).mapInArrow(compare, "u long, v long")


def set_nodes(marks: DataFrame) -> DataFrame:
    """A node for each distinct set of ``marks`` (doc_id, name, ...): its number, the least id of its texts, and its other columns."""
    rest = [c for c in marks.columns if c not in ("doc_id", "name")]
    return stored(marks.groupBy("name").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in rest)).withColumn("node", F.monotonically_increasing_id()), "nodes")


class Sets:
    """Whole sets of nodes, made anew from the texts that have them."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, set_of: Callable[[bytes | None], np.ndarray], name_of: Callable[[np.ndarray], bytes]):
        self.texts, self.nodes, self.set_of, self.name_of = texts, nodes, set_of, name_of

    def of(self, some: DataFrame) -> DataFrame:
        """(node, hs) of ``some`` nodes, as a table; hashes are sorted as signed numbers."""
        set_of, name_of = self.set_of, self.name_of

        def sets(ids: list, batch: list) -> list:
            found = [set_of(t) for t in batch]
            return [list(map(name_of, found)), [np.sort(x.view(np.int64)) for x in found]]

        of = self.nodes.join(some.distinct(), "node").select("node", "name", F.col("least").alias("__id"))
        own = self.texts.join(of.select("__id").distinct(), self.texts["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
        return stored(over_texts(own, sets, "name binary, hs array<long>").join(of.select("node", "name"), "name").groupBy("node").agg(F.first("hs").alias("hs")), "sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (u, v) whose sets have a Jaccard similarity of 0.8 or more."""
        pairs = stored(pairs, "pairs")
        whole = self.of(pairs.select(F.explode(F.array("u", "v")).alias("node")))
        both = pairs.join(whole.withColumnsRenamed({"node": "u", "hs": "a"}), "u").join(whole.withColumnsRenamed({"node": "v", "hs": "b"}), "v")
        links = stored(both.where(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "links")
        dropped(whole)
        dropped(pairs)
        return links


def linked(rows: DataFrame, sets: Sets, score: Score) -> DataFrame:
    """(u, v): each node of a component of several, but for the least, with that least node.

    ``rows`` are the buckets; ``sets.nodes`` has each node's own sketch.
    """
    roots = components(sets.verified(proposed(rows, score)))
    named = roots.withColumnsRenamed({"u": "node", "v": "root"})
    root = F.coalesce("root", "node").alias("root")
    rooted = stored(rows.join(named, "node", "left").select("key", "node", "sketch", root), "rooted")
    found = clusters(rooted, score)
    dropped(rooted)
    if found.isEmpty():
        return roots
    of = found.withColumnsRenamed({"u": "root", "v": "cluster"}).unionAll(found.select("v", F.col("v").alias("cluster")).distinct())
    members = stored(sets.nodes.join(named, "node", "left").select("node", root, "sketch").join(of, "root"), "members")
    whole = sets.of(members.select("node"))
    links = stored(settled(members.join(whole, "node").select("cluster", "node", "root", "sketch", "hs"), score), "links")
    dropped(whole)
    dropped(members)
    return components(roots.unionAll(links))


def classes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, component_id) of each set: the least id of its component."""
    rooted = nodes.select("name", "node", "least").join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("name", "component_id")
