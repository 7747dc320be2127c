"""SimHash near-dedup for texts of a given similarity.

Two texts are near copies if the sets of their runs of five words have a Jaccard similarity of 0.8 or more.

1. A pass over all texts counts shingles that repeat: each task counts blocks of ``BLOCK`` shingles and passes on those that
   come twice in a block. Those most often met come last in the order of all sets.
2. A second pass gives each text the sorted set of its shingles' 64-bit hashes and a SimHash of 128 bits over the set; texts
   of equal sets count as one. Sets of such similarity share an element among the first n // 5 + 1 of each in that order,
   whatever the order, so nothing is missed when these prefixes are brought together by element.
3. In a bucket the places of the element and the sizes of both sets tell some pairs apart, and the pigeonring filter nearly
   all others: chains of consecutive segments of the fingerprints keep to proportional budgets, and then the full Hamming
   distance to ``RADIUS``. ``buckets`` takes candidates from what is left, nearest first, and verifies them on whole sets.
4. Stars over the links give components; documents get the least id.

Sets of similarity 0.8 differ in 19 of 128 bits on average, with a standard deviation of 4 (24 and 4.4 for the smallest sets,
of four and five shingles), so RADIUS leaves more than five standard deviations; of unlike sets one in 400 passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.buckets import Sets, classes, linked, set_nodes, shared_keys
from viewloom.llm.common import dropped, over_texts, stored, texts_of
from viewloom.llm.shingles import set_name, shingle_set
from viewloom.llm.simhash_dedup import ring_holds, wide_fingerprint

SHINGLE = 5
#: Shingles that are counted together in a task.
BLOCK = 1 << 21
#: How often a shingle is met to count as frequent, and how many frequent ones are told to all tasks at most: beyond, the less frequent are left out.
FREQUENT, MOST = 20, 500_000
#: Differing bits of 128 that near copies may have.
RADIUS = 48


def five_words(text: bytes | None) -> np.ndarray:
    return shingle_set(text, SHINGLE)


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that many texts have, counted over all of them. They only order sets; any answer is right."""

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        twice = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(counts[twice].astype(np.int64))], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(five_words(text))
                n += len(held[-1])
                if n >= BLOCK:
                    yield repeated(held)
                    held, n = [], 0
        if held:
            yield repeated(held)

    met = texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    met = stored(met, "frequent")
    left, least = 0, 1 << 62
    for power, n in sorted(map(tuple, met.groupBy(F.floor(F.log2("n"))).count().collect()), reverse=True):  # 63 rows at most
        left += n
        if left > MOST:
            break
        least = 1 << power
    rows = met.where(F.col("n") >= least).select("h").toArrow()
    dropped(met)
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def marked(texts: DataFrame) -> DataFrame:
    """(doc_id, name, keys, sketch) of each text: its set's name, prefix, and fingerprint with the set's size."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def mark(ids: list, batch: list) -> list:
        often = shared.value
        names, prefixes, sketches = [], [], []
        for text in batch:
            own = five_words(text)
            names.append(set_name(own))
            sketches.append(np.array(wide_fingerprint(own), "<u8").tobytes() + len(own).to_bytes(4, "big"))
            last = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(own), bool)
            prefixes.append(np.concatenate((own[~last], own[last]))[: len(own) // 5 + 1].view(np.int64))
        return [ids, names, prefixes, sketches]

    return over_texts(texts, mark, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, name binary, keys array<long>, sketch binary")


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bits of the fingerprints, or -1 for sets that cannot be similar enough: by the places of the element that they share first, their sizes, or the pigeonring filter.

    A sketch is 16 bytes of fingerprint, then the set's size and, in a bucket, the place of the bucket's element in it.
    """
    after = [np.ascontiguousarray(x[:, 16:]).view(">u4").astype(np.int64) for x in (a, b)]
    n, m = after[0][:, 0], after[1][:, 0]
    left = np.minimum(*((x[:, 0] - x[:, 1]) if x.shape[1] > 1 else x[:, 0] for x in after))
    prints = np.ascontiguousarray(a[:, :16] ^ b[:, :16]).view("<u8")
    ok = np.nonzero(9 * left >= 4 * (n + m))[0]
    ok = ok[ring_holds(prints[ok], RADIUS)]
    out = np.full(len(a), -1, np.int64)
    out[ok] = 128 - np.bitwise_count(prints[ok]).sum(axis=1, dtype=np.int64)
    return out


def near_copy_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id), a row for each row of ``docs``.

    Texts are near copies if their sets of five-word runs have a Jaccard similarity of 0.8 or more; components are
    connected by near copies. Texts without words, null ones too, are copies of each other. A null id never names a
    component: its row gets the least id reachable, or null if there is none. Repeated rows give repeated results. An
    empty table gives an empty result; other columns are left out.
    """
    texts = texts_of(docs, id_col, text_col)
    marks = stored(marked(texts), "shingles")
    nodes = set_nodes(marks)
    rows = shared_keys(nodes.select("node", F.posexplode("keys").alias("pos", "key")).select("key", "node", "pos"))
    place = F.unhex(F.lpad(F.hex("pos"), 8, "0"))
    rows = stored(rows.join(nodes.select("node", "sketch"), "node").select("key", "node", F.concat("sketch", place).alias("sketch")), "buckets")
    roots = linked(rows, Sets(texts, nodes, five_words, set_name), nearness)
    dropped(rows)
    return marks.select("doc_id", "name").join(classes(nodes, roots), "name").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document of its least id.

    Rows with a null id stay, for nothing names them; repeated rows stay or go together. All columns pass through,
    whatever their names. An empty table gives an empty result.
    """
    found = near_copy_components(docs, id_col=id_col, text_col=text_col)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(gone, docs[id_col] == gone["of"], "left_anti")
