"""Benchmark decontamination with SimHash over item-sized windows.

For each benchmark item, every window of a document that has as many words as the item (of a shorter document, its whole
text) gets a SimHash fingerprint, unless it shares no word shingle with any item, when its similarity to all is zero. A
multi-index over blocks of the fingerprint finds every item fingerprint within the radius: if two differ in at most
``RADIUS`` bits, some block of 32 bits differs in at most RADIUS // BLOCKS bits, which one pair in ten of unlike ones does
by chance. Candidates that pass the full Hamming check are verified by exact weighted-shingle similarity: the sum of the
smaller over the sum of the larger counts, each shingle weighing as many as it has characters.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from viewloom.llm.common import stored, texts_of

SHINGLE = 5
BITS, BLOCKS = 128, 4
#: Texts that share four fifths of their shingles differ in about 19 of 128 bits, with a deviation of 4; so this leaves more than five.
RADIUS = 41

_workers: dict = {}


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, in lower case."""
    return text.decode("utf-8", "replace").lower().encode().split()


def shingles_of(words: list[bytes]) -> list[bytes]:
    """Runs of five words; a shorter text is one shingle, and one without words has none."""
    if len(words) <= SHINGLE:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    shared = sum(min(n, b[s]) * len(s) for s, n in a.items() if s in b)
    total = sum(n * len(s) for s, n in a.items()) + sum(n * len(s) for s, n in b.items())
    return shared / (total - shared) if total else 0.0


def _signed(shingles: list[bytes]) -> np.ndarray:
    """The vote of each shingle on each bit, (shingles, BITS)."""
    hashes = np.array([xxhash.xxh128_intdigest(s).to_bytes(16, "little") for s in shingles], "V16")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").astype(np.int64)
    return (2 * bits - 1) * np.array([len(s) for s in shingles])[:, None]


def _pack(votes: np.ndarray) -> np.ndarray:
    """Fingerprints as blocks, (texts, BLOCKS)."""
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u4")


class Index:
    """Some benchmark items, with all that is needed to find their near copies in texts."""

    def __init__(self, items: list[tuple[object, bytes]], least: float):
        self.least = least
        self.ids, self.sizes, self.counts, self.fps = [], [], [], []
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[bytes, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text or b"")
            if not words:
                continue
            shingles = shingles_of(words)
            for s in dict.fromkeys(shingles):
                self.owners[s].append(len(self.ids))
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.counts.append(Counter(shingles))
            self.fps.append(_pack(_signed(shingles).sum(0, keepdims=True))[0])
        self.by_size: dict[int, np.ndarray] = {n: np.array([i for i, m in enumerate(self.sizes) if m == n]) for n in set(self.sizes)}
        self.codes: dict[int, np.ndarray] = {}  # sorted codes of shingles, by how many words they have
        for n in {min(m, SHINGLE) for m in self.sizes}:
            own = [np.array([self.vocabulary[w] for w in s.split(b" ")], np.uint64) for s in self.owners if s.count(b" ") + 1 == n]
            self.codes[n] = np.unique(np.concatenate([self.code(ids, n) for ids in own]))

    @staticmethod
    def code(ids: np.ndarray, n: int) -> np.ndarray:
        """A code for each run of ``n`` words; a code of unlike runs only costs a look."""
        code = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
        return code

    def hits(self, words: list[bytes], n: int, ids: np.ndarray) -> list[int]:
        """Places of the runs of ``n`` words that some item has."""
        if n not in self.codes or len(ids) < n:
            return []
        known = ids > 0
        whole = np.lib.stride_tricks.sliding_window_view(known, n).all(axis=1)
        if not whole.any():
            return []
        code = self.code(ids, n)
        at = np.nonzero(whole)[0]
        place = np.searchsorted(self.codes[n], code[at])
        found = at[self.codes[n][np.minimum(place, len(self.codes[n]) - 1)] == code[at]]
        return [i for i in found.tolist() if b" ".join(words[i : i + n]) in self.owners]

    def matches(self, text: bytes) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word of the window, differing bits): the best window for each item that matches."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for run in self.codes:
            hits = self.hits(words, run, ids)
            starts: dict[int, set[int]] = defaultdict(set)  # of windows, by size
            for at in hits:
                for size in {self.sizes[i] for i in self.owners[b" ".join(words[at : at + run])]}:
                    starts[size].update(range(max(0, at - (size - run)), min(at, len(words) - size) + 1) if len(words) > size else (0,))
            for size, places in starts.items():
                for item, score, start, bits in self.verified(words, size, run, np.array(sorted(places), np.int64)):
                    if item not in best or (-score, start) < (-best[item][0], best[item][1]):
                        best[item] = (score, start, bits)
        return [(i, *found) for i, found in sorted(best.items())]

    def verified(self, words: list[bytes], size: int, run: int, starts: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        """Windows of ``size`` words, or the whole of a shorter text, and items of that size that are near by fingerprint and similar enough."""
        span = min(size, len(words))
        items = self.by_size[size]
        fps = np.stack([self.fps[i] for i in items])
        for part in np.split(starts, np.nonzero(np.diff(starts) > 4 * size)[0] + 1):  # windows that lie together
            for at in range(0, len(part), 2048):
                own = part[at : at + 2048]
                if not len(own):
                    continue
                first, last = int(own[0]), int(own[-1]) + span
                local = [b" ".join(words[i : i + run]) for i in range(first, last - run + 1)]
                sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(_signed(local), axis=0)])
                marks = _pack(sums[own - first + span - run + 1] - sums[own - first])
                candidates = np.zeros((len(own), len(items)), bool)
                for b in range(BLOCKS):
                    candidates |= np.bitwise_count(marks[:, b, None] ^ fps[None, :, b]) <= RADIUS // BLOCKS
                w, i = np.nonzero(candidates)
                bits = np.bitwise_count(marks[w] ^ fps[i]).sum(axis=1, dtype=np.int64)
                for a, b, d in zip(w[bits <= RADIUS].tolist(), i[bits <= RADIUS].tolist(), bits[bits <= RADIUS].tolist(), strict=True):
                    start, item = int(own[a]), int(items[b])
                    score = similarity(Counter(local[start - first : start - first + span - run + 1]), self.counts[item])
                    if score >= self.least:
                        yield item, score, start, d


def _blocks(benchmark: DataFrame, rows: int, most_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in blocks of bounded size; a single item may exceed ``most_bytes``."""
    block: list[tuple[object, bytes]] = []
    held = 0
    for item_id, text in benchmark.toLocalIterator():
        text = text.encode()
        if block and (len(block) >= rows or held + len(text) > most_bytes):
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.8, block_rows: int = 4096, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, window_start, window_words, differing_bits): a row for each document and item that it contains.

    The window is the document's most similar one of the item's length, the first of equals; the whole text is the one
    window of a document shorter than the item. ``window_start`` counts words. The benchmark is the stated query set: it is taken in blocks of at most ``block_rows`` items and about
    ``block_bytes`` bytes, each broadcast and held against all whole texts. Null or wordless items and texts match
    nothing. An item of fewer than five words is one shingle and matches where all its words stand in a row. Repeated
    rows of ``docs`` give repeated results, repeated items likewise. Empty tables give an empty result; other columns
    are left out.
    """
    texts = texts_of(docs, id_col, text_col).where(F.col("text").isNotNull())
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].cast("string").alias("text")).where(F.col("text").isNotNull())
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double, window_start long, window_words int, differing_bits int"

    out = to_arrow_schema(StructType.fromDDL(schema))

    def search(block: list) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        mark = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if mark not in _workers:
                _workers.clear()
                _workers[mark] = Index(shared.value, least)
            index = _workers[mark]
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    rows += [(doc_id, index.ids[i], score, start, min(index.sizes[i], len(words_of(text))), bits) for i, score, start, bits in index.matches(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        return texts.mapInArrow(run, schema)

    found = [search(block) for block in _blocks(items, block_rows, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    if len(found) > 1:
        found = [stored(f, "contamination") for f in found]
    return reduce(DataFrame.unionAll, found)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns, whatever their names.

    Rows with a null id stay, and so do null and empty texts; repeated rows stay or go together. An empty table, of
    documents or items, removes nothing.
    """
    found = stored(contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("of")).distinct(), "contaminated")
    return docs.join(found, docs[id_col] == found["of"], "left_anti")
