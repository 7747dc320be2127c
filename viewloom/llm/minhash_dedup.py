"""MinHash near-duplicates by SuperMinHash signatures.

1. A pass over the texts gives each its set of shingles and the set's signature. An element throws its values through a
   random permutation of the slots, so that its values in different slots are correlated: the one of its j-th slot lies
   between j and j + 1. A slot keeps the least of all. Signatures so made have less variance than those of independent
   hashes unless sets are much larger than the signature, and no element need go on when all slots hold values below its next one; a text of many shingles stops after
   the first level or two.
2. Signatures are cut into bands. Texts whose signatures agree in a band meet in its bucket; ``BANDS`` bands of ``WIDTH``
   values miss a pair of similarity 0.8 once in twenty million.
3. ``buckets`` finds candidates by signatures, verifies them on whole sets, and groups what is linked: stars contract
   until each component has one name, which is union-find over a table of edges.

A pair is a candidate if its signatures agree in ``AGREED`` of their values. At a similarity of 0.8 that is five
standard deviations below the mean for large sets (0.035 of the values, as of independent hashes), and seven for sets of up
to some hundred shingles (0.025).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.buckets import Sets, classes, linked, set_nodes, shared_keys
from viewloom.llm.common import dropped, over_texts, stored, texts_of
from viewloom.llm.shingles import mixed, set_name, shingle_set

SLOTS, BANDS, WIDTH = 128, 32, 4
#: Agreeing values of two signatures that make a candidate, of SLOTS.
AGREED = 80
#: Elements whose permutations are held together.
TOGETHER = 1 << 16
_LEVEL = np.uint64(48)


def _throws(elements: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, place among the slots not taken yet) of each element's throw at a level."""
    z = mixed(elements + np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    place = ((z & np.uint64(0xFFFF)) * np.uint64(SLOTS - level)) >> np.uint64(16)
    return (z >> np.uint64(16)) | (np.uint64(level) << _LEVEL), place.astype(np.int64) + level


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash signatures, (sets, SLOTS) of 64 bits: the level above 48 bits of the value. Empty sets keep the largest value everywhere."""
    out = np.full((len(sets), SLOTS), np.uint64(2**64 - 1))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = out.reshape(-1)
    lo = 0
    while lo < len(sets):  # some sets together, a very large one by itself
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), TOGETHER, "right")) + lo)
        elements = np.concatenate(sets[lo:hi]) if hi > lo else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        places = np.zeros(len(elements), np.int64)
        for at in range(0, len(elements), TOGETHER):
            part = slice(at, at + TOGETHER)
            value, places[part] = _throws(elements[part], 0)
            np.minimum.at(flat, row[part] * SLOTS + places[part], value)
        order: np.ndarray | None = None
        for level in range(1, SLOTS):
            open_ = (out[lo:hi].max(axis=1) >> _LEVEL) >= np.uint64(level)
            own = open_[row - lo]
            if not own.any():
                break
            if order is None:
                elements, row, first = elements[own], row[own], places[own]
                order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(row), 1))
                order[np.arange(len(row)), first] = 0  # slot 0 has gone where the first throw was
            elif own.sum() < 0.8 * len(row):
                elements, row, order = elements[own], row[own], order[own]
            value, place = _throws(elements, level)
            each = np.arange(len(row))
            slot = order[each, place]
            order[each, place] = order[:, level]
            np.minimum.at(flat, row * SLOTS + slot, value)
        lo = hi
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the buckets."""
    bands = found.reshape(len(found), BANDS, WIDTH)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(found), BANDS))
    for k in range(WIDTH):
        keys = mixed(keys ^ bands[:, :, k]) + np.uint64(k)
    return keys.view(np.int64)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values of two sketches agree, or -1 where that is too few."""
    n = (a == b).sum(axis=1, dtype=np.int64)
    return np.where(n >= AGREED, n, -1)


def minhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Texts link if their sets of ``shingle``-word runs have a Jaccard similarity of 0.8 or more; a text of fewer words is
    one run. Null texts and those without words have empty sets, link with nothing, and are components of their own id. A
    null id never names a component: its row gets the least id reachable, or null if there is none, and ``kept`` is then
    false, or true where nothing is reachable. Repeated rows give equal results. Texts of any length are read whole. An empty table
    gives an empty result; other columns are left out.
    """
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def mark(ids: list, batch: list) -> list:
        sets = [shingle_set(t, shingle) for t in batch]
        found = signatures(sets)
        keys, sketch = band_keys(found), (found & np.uint64(0xFF)).astype(np.uint8)
        return [ids, list(map(set_name, sets)), list(map(len, sets)), [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], [s.tobytes() for s in sketch]]

    marks = stored(over_texts(texts, mark, f"doc_id {kind}, name binary, n long, keys array<long>, sketch binary"), "signatures")
    held = marks.where("n > 0")
    nodes = set_nodes(held)
    rows = shared_keys(nodes.select("node", F.explode("keys").alias("key")).select("key", "node"))
    rows = stored(rows.join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch"), "buckets")
    roots = linked(rows, Sets(texts, nodes, lambda t: shingle_set(t, shingle), set_name), agreement)
    dropped(rows)
    all_ = marks.select("doc_id", "name", "n").join(classes(nodes, roots), "name", "left")
    named_by = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return all_.select("doc_id", F.col("n").alias("n_shingles"), named_by.alias("component_id"), F.col("doc_id").eqNullSafe(named_by).alias("kept"))
