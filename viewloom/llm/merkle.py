"""A Merkle manifest of a dataset: a digest for each row, a tree for each language, and a proof for each row.

Digests are 64 lowercase hex digits of SHA-256 and go into the next hash as that text. In a language, leaves stand by id;
while several nodes remain, every ``FANOUT`` consecutive ones become the hash of their digests. What remains are the
subroots, which by language give the root in the same way.

Leaves get their places by a distributed ranking, and are cut into aligned blocks of ``BLOCK``, a power of the fanout, so
that a block is a subtree. In a block the digests of a level are one contiguous matrix, a row for each run of siblings; a
level is hashed row by row, and the siblings of any node are slices whose ends follow from its place. The nodes of all
blocks are nodes of a level above, cut into blocks again, until each language has one. Paths then go down: a block
takes the siblings above it and hands them to its nodes. No task holds more than a block, whatever the size of a language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from viewloom.llm.common import ranked, stored

FANOUT = 8
#: Leaves of a block.
BLOCK = FANOUT**4
HEX = 64

_NODE = "g string, place long, digest string"
_PATH = "g string, place long, path array<struct<left: string, right: string>>"


def field_text(value: Column) -> Column:
    """How a field enters a leaf: ``-`` if null, else the count of its UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def matrix(digests: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of bytes."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, HEX)


def levels(leaves: np.ndarray, least: int = 0) -> list[np.ndarray]:
    """The levels of a block from its leaves up to its one node, at least so many above the leaves."""
    found = [leaves]
    while len(found[-1]) > 1 or len(found) <= least:
        below = found[-1]
        full = len(below) // FANOUT
        runs = below[: full * FANOUT].reshape(full, FANOUT * HEX)
        up = [sha256(r).hexdigest() for r in runs]
        if len(below) % FANOUT:
            up.append(sha256(below[full * FANOUT :].tobytes()).hexdigest())
        found.append(np.frombuffer("".join(up).encode(), np.uint8).reshape(-1, HEX))
    return found


def siblings(tree: list[np.ndarray]) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf, level by level, the digests left and right of its node among the node's run."""
    flat = [level.tobytes() for level in tree[:-1]]
    sizes = [len(level) for level in tree[:-1]]
    for i in range(len(tree[0])):
        path = []
        for data, n in zip(flat, sizes, strict=True):
            first = i - i % FANOUT
            last = min(first + FANOUT, n)
            path.append((data[first * HEX : i * HEX], data[(i + 1) * HEX : last * HEX]))
            i //= FANOUT
        yield path


def folded(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        digest = sha256(left + digest.encode() + right).hexdigest()
    return digest


class Blocks:
    """Nodes (g, place, digest) in aligned blocks of a power of the fanout."""

    def __init__(self, size: int):
        self.size, self.depth = size, round(math.log(size, FANOUT))
        if FANOUT**self.depth != size:
            raise ValueError(f"a block is a power of {FANOUT}")

    def cut(self, nodes: DataFrame) -> GroupedData:
        return nodes.withColumn("block", F.floor(F.col("place") / self.size)).groupBy("g", "block")

    def tree(self, key: tuple, table: pa.Table) -> list[np.ndarray]:
        """The levels of a block; one that others stand before climbs to the end, whatever it holds."""
        return levels(matrix(table.column("digest")), self.depth if key[1].as_py() else 0)

    def climb(self, nodes: DataFrame) -> DataFrame:
        """The nodes of blocks, as nodes of the level above."""

        def climbed(key: tuple, table: pa.Table) -> pa.Table:
            top = self.tree(key, table.sort_by("place"))[-1]
            return pa.table({"g": [key[0].as_py()], "place": [key[1].as_py()], "digest": [top.tobytes().decode()]})

        return self.cut(nodes).applyInArrow(climbed, _NODE)

    def descend(self, nodes: DataFrame, paths: DataFrame) -> DataFrame:
        """(g, place, path) of nodes from the paths of their blocks."""

        def descended(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            over = above.column("path")[0].as_py()
            own = [[{"left": a.decode(), "right": b.decode()} for a, b in path] + over for path in siblings(self.tree(key, table))]
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            return pa.table({"g": table.column("g"), "place": table.column("place"), "path": pa.array(own, kind)})

        return self.cut(nodes).cogroup(paths.withColumnRenamed("place", "block").groupBy("g", "block")).applyInArrow(descended, _PATH)

    def trees(self, nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
        """The tables of nodes by level of blocks, and the one node of each group."""
        held = [nodes]
        while True:
            held.append(stored(self.climb(held[-1]), label))
            if held[-1].where("place > 0").isEmpty():
                return held[:-1], held[-1]

    def paths(self, held: list[DataFrame], above: DataFrame) -> DataFrame:
        """The paths of the lowest of ``held``, levels of blocks, from those of the groups' own nodes."""
        for nodes in reversed(held):
            above = self.descend(nodes, above)
        return above


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampering: bool = True, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, tampered, folded_root, verified), a row for each row of ``docs``.

    ``folded_root`` is recomputed from the leaf and its siblings; with ``tampering`` the leaf is that of a text with A-Z
    in lower case where 3 divides the CRC-32 of the decimal id. A null group is a tree of its own, before all others.
    Null ids come first in their tree and are never tampered with; rows of equal id stand by leaf, so repeated rows are
    neighbours with proofs of their own. Null fields enter a leaf as ``-``; a text may be of any length. A lone leaf is
    its own subroot, and a lone subroot the root. An empty table gives an empty result; other columns are left out.
    """
    own = [docs[c] for c in fields]
    changed = [F.translate(docs[c], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == text_col else docs[c] for c in fields]
    struck = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 3 == 0, F.lit(False)) if tampering else F.lit(False)
    group = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit("")).alias("g")
    leaf = leaf_of(own)
    rows = stored(docs.select(group, docs[id_col].alias("doc_id"), leaf.alias("digest"), F.when(struck, leaf_of(changed)).alias("other")), "leaves")
    leaves = stored(ranked(rows, "g", ["doc_id", "digest"], "ranked"), "placed")
    blocks = Blocks(block)
    levels_below, subroots = blocks.trees(leaves.select("g", "place", "digest"), "nodes")
    tops = stored(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "g", ["of"], "subroots"), "subroots")
    levels_above, root = blocks.trees(tops.select("g", "place", "digest"), "roots")
    above = blocks.paths(levels_above, root.select("g", "place", F.expr("array()").cast("array<struct<left: string, right: string>>").alias("path")))
    start = tops.join(above, ["g", "place"]).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("place"), "path")
    paths = blocks.paths(levels_below[1:], start)
    whole = root.first()  # one row, or none of an empty table
    ends = stored(paths.join(tops.select(F.col("of").alias("g"), F.col("digest").alias("subroot")), "g").withColumn("root", F.lit(whole.digest if whole else None).cast("string")), "paths")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, tampered boolean, folded_root string, verified boolean"

    def proven(key: tuple, table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        upper = [(p["left"].encode(), p["right"].encode()) for p in over.column("path")[0].as_py()]
        subroot, top = over.column("subroot")[0].as_py(), over.column("root")[0].as_py()
        digests, others = table.column("digest").to_pylist(), table.column("other").to_pylist()
        proofs, roots = [], []
        for path, digest, other in zip(siblings(blocks.tree(key, table)), digests, others, strict=True):
            path += upper
            proofs.append(sha256(b"".join([x for pair in path for x in pair])).hexdigest())
            roots.append(folded(other or digest, path))
        n = len(digests)
        return pa.table({"doc_id": table.column("doc_id"), "leaf": digests, "subroot": [subroot] * n, "root": [top] * n, "proof_sha256": proofs, "tampered": [o is not None for o in others], "folded_root": roots, "verified": [r == top for r in roots]})

    return blocks.cut(leaves).cogroup(ends.withColumnRenamed("place", "block").groupBy("g", "block")).applyInArrow(proven, schema)
