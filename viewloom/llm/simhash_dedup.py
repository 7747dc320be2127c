"""SimHash near-duplicates with a pigeonring filter.

1. A pass over the texts gives each a 64-bit fingerprint of its word shingles.
2. Distinct fingerprints are cut into ``PARTS`` segments on a ring. For two fingerprints at most ``radius`` bits apart
   there is a segment from which on every chain of l consecutive segments differs in at most l * radius / PARTS bits
   (the pigeonring principle). With 5 segments and radius 4 the first segment is equal and the first two differ in at
   most one bit; so one half of the second segment is equal as well. Segment and half make the bucket keys: ten for
   each fingerprint, so nothing within the radius is missed.
3. Inside a bucket, chains beyond their budgets are pruned before the full Hamming check. A bucket emits the edges of a
   spanning forest, never all its pairs.
4. Stars over the edges give components; documents get the least id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import over_texts, runs, stored, texts_of
from viewloom.llm.graph import components

#: Segments of a fingerprint, as (first bit, bits).
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: The lower half of a segment has so many bits.
HALF = 6
PARTS = len(SEGMENTS)
#: Buckets with more fingerprints than this are divided by further blocks.
LARGE = 4096


def _bits(first: int, n: int) -> np.uint64:
    return np.uint64(((1 << n) - 1) << first)


def fingerprint_batch(texts: list[bytes | None], shingle: int = 4) -> np.ndarray:
    """Fingerprints of texts, as uint64."""
    hashes: list[int] = []
    counts: list[int] = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space only
        n = len(words)
        if n <= shingle:
            own = [digest(b" ".join(words), 42)] if n else []
        else:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            own = [digest(whole[s:e], 42) for s, e in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        hashes += own
        counts.append(len(own))
    n = np.array(counts, np.int64)
    values = np.array(hashes, "<u8")
    ones = np.zeros((len(texts), 64), np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    for at in range(0, len(values), 1 << 17):  # bounded, however long a text is
        part = values[at : at + (1 << 17)]
        lo = int(np.searchsorted(first, at, "right")) - 1
        hi = int(np.searchsorted(first, at + len(part), "left"))
        rows = np.arange(lo, hi)
        rows = rows[n[rows] > 0]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[rows] += np.add.reduceat(bits, np.maximum(first[rows] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long. A null or wordless text has fingerprint 0."""
    texts = texts_of(docs, id_col, text_col)
    return over_texts(texts, lambda ids, t: [ids, pa.array(fingerprint_batch(t, shingle).view("<i8"))], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, fp long")


def wide_fingerprint(values: np.ndarray) -> tuple[int, int]:
    """A SimHash of 128 bits over distinct 64-bit hashes, as two words: their own bits, and those of a second mixing."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)]
        mixed = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        both = np.stack([part, mixed ^ (mixed >> np.uint64(31))], axis=1)
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(values), bitorder="little").view("<u8").tolist())


def ring_holds(x: np.ndarray, radius: int) -> np.ndarray:
    """For XORed fingerprints of two words, (pairs, 2): whether chains around some segment keep to their budgets, and the whole to ``radius``.

    Eight segments of 16 bits stand on a ring. If at most ``radius`` bits differ in all, there is a segment from which on
    every chain of l segments differs in at most l * radius / 8 bits. Chains of one and two segments are looked at for
    every pair, longer ones and the whole for those that are left.
    """
    diff = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16)).astype(np.int16).reshape(len(x), 8)
    budget = radius * np.arange(1, 9)
    two = diff + np.roll(diff, -1, axis=1)
    ok = ((diff * 8 <= budget[0]) & (two * 8 <= budget[1])).any(axis=1)
    at = np.nonzero(ok)[0]
    ring = np.cumsum(np.concatenate([diff[at], diff[at]], axis=1), axis=1, dtype=np.int16)
    ring = np.concatenate([np.zeros((len(at), 1), np.int16), ring], axis=1)
    holds = np.zeros(len(at), bool)
    for start in range(8):
        holds |= ((ring[:, start + 1 : start + 9] - ring[:, start : start + 1]) * 8 <= budget).all(axis=1)
    ok[at] = holds
    return ok


def chains_hold(x: np.ndarray, radius: int) -> np.ndarray:
    """For XORed fingerprints: whether some segment starts chains that all keep to their budgets."""
    diff = np.stack([np.bitwise_count(x & _bits(*s)) for s in SEGMENTS], axis=-1).astype(np.int16)
    found = np.zeros(x.shape, bool)
    for start in range(PARTS):
        ring = np.cumsum(np.roll(diff, -start, axis=-1), axis=-1)
        found |= (ring * PARTS <= radius * np.arange(1, PARTS + 1)).all(axis=-1)
    return found


def linked(a: np.ndarray, b: np.ndarray, segment: int, radius: int) -> np.ndarray:
    """Whether fingerprints link: the chain from ``segment`` on first, then the full check of those that are left."""
    x = a ^ b
    ok = np.ones(x.shape, bool)
    seen = np.uint64(0)
    for length in range(1, PARTS):
        seen |= _bits(*SEGMENTS[(segment + length - 1) % PARTS])
        ok &= np.bitwise_count(x & seen) * PARTS <= radius * length
    at = np.nonzero(ok)
    ok[at] = np.bitwise_count(x[at]) <= radius
    return ok


def forest(fps: np.ndarray, segment: int, radius: int, depth: int = 0) -> list[tuple[int, int]]:
    """Edges that connect what links in a bucket of distinct fingerprints; fewer than the bucket has, for each call."""
    if len(fps) > LARGE and depth < 2:  # at most `radius` bits differ, so one of radius + 1 blocks is equal
        edges = []
        cuts = np.linspace(0, 64, radius + 2).astype(int) if depth == 0 else np.linspace(5, 64, 2 * radius + 1).astype(int)
        for lo, hi in pairwise(cuts.tolist()):
            block = fps & _bits(lo, hi - lo)
            order = np.argsort(block, kind="stable")
            for part in np.split(fps[order], np.nonzero(np.diff(block[order]))[0] + 1):
                if 1 < len(part):
                    edges += forest(part, segment, radius, depth + 1 if len(part) < len(fps) else 2)
        return edges
    edges, left = [], fps
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            node = todo.pop()
            near = linked(left, node, segment, radius)
            for x in left[near].tolist():
                edges.append((int(node), x))
                todo.append(np.uint64(x))
            left = left[~near]
    return edges


def _link_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "key", 20_000):
            keys = table.column("key").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate(([0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]))
            sizes = np.diff(cuts)
            edges: list[tuple[int, int]] = []
            small = sizes <= 8
            for lag in range(1, 8):  # small buckets, all together
                at = np.nonzero((keys[lag:] == keys[:-lag]) & np.repeat(small, sizes)[lag:])[0]
                if not len(at):
                    break
                segment = keys[at] >> 41
                for s in range(PARTS):
                    own = at[segment == s]
                    near = own[linked(fps[own], fps[own + lag], s, radius)]
                    edges += zip(fps[near].tolist(), fps[near + lag].tolist(), strict=True)
            for k in np.nonzero(~small)[0].tolist():
                edges += forest(fps[cuts[k] : cuts[k + 1]], int(keys[cuts[k]] >> 41), radius)
            if edges:
                pairs = np.array(edges, np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def fingerprint_links(fps: DataFrame, *, radius: int = 4) -> DataFrame:
    """(u, v): edges that connect the same distinct fingerprints (column ``fp``) as all links within ``radius`` do."""
    if radius >= PARTS:
        raise ValueError(f"radius must be below {PARTS}")

    def part(first: int, n: int):
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << n) - 1)

    keys = []
    for i, own in enumerate(SEGMENTS):
        first, n = SEGMENTS[(i + 1) % PARTS]
        for half, (lo, bits) in enumerate(((first, HALF), (first + HALF, n - HALF))):
            keys.append(F.lit((2 * i + half) << 40) + F.shiftleft(part(*own), 8) + part(lo, bits))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_link_buckets(radius), "u long, v long")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows give repeated results.
    A null id never names a component: its row gets the least id reachable, or null if there is none. An empty table
    gives an empty result; other columns are left out.
    """
    marks = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    least = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = components(fingerprint_links(least.select("fp"), radius=radius))
    rooted = least.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document of its least id.

    Rows with a null id stay, for nothing names them; repeated rows stay or go together. All columns pass through,
    whatever their names. An empty table gives an empty result.
    """
    classes = simhash_components(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(gone, docs[id_col] == gone["of"], "left_anti")
