"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: if the longest previous factor of some
suffix has LENGTH bytes or more. Of all positions that come earlier in the text, the two that stand nearest to a suffix
in suffix order, the previous and the next smaller position, have its longest earlier match; so the array follows from
suffix order, common prefixes of neighbours and these two. Most suffixes match nothing, so it is built where it matters:

1. Every window of LENGTH bytes has an anchor, the least hashed gram of ``GRAM`` bytes in it, so equal windows have
   anchors at equal places. Consecutive windows of one anchor make a block. Hashes of grams only bring blocks together.
2. Grams that only one block has repeat nowhere. Of blocks of the same gram and the same bytes (by a digest with a key
   drawn for each run, so that no text can be made to fool it) all but the first are repeated as a whole.
3. Where a gram has blocks of several contents, the suffixes of the first of each, where a window starts, are sorted by
   their bytes; common prefixes of neighbours and the previous and next smaller positions give the longest previous
   factors.
4. A gram with more than ``CROWD`` block contents is looked up window by window instead, by SHA-256 and with map-side
   partial sums, since no task could sort it.
5. Each document is cut once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from viewloom.llm.common import runs, stored, texts_of

LENGTH = 100
GRAM = 32
#: Grams in a window.
SPAN = LENGTH - GRAM + 1
#: Texts are read in stretches of so many windows; a block is cut there, which changes no result.
STRETCH = 1 << 20
#: Grams with more block contents than this are looked up window by window.
CROWD = 20_000

#: Blocks that a task holds to find copies among them.
COMBINED = 400_000

_BASE = 0x9E3779B97F4A7C15
_workers: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        k = min(size, n - size)
        out[size : size + k] = out[:k] * np.uint64(pow(base, size, 1 << 64))
        size *= 2
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and its inverse, at least ``n`` of them."""
    if _workers.get("n", 0) < n:
        n = max(n, 1 << 18)
        values = np.array([xxhash.xxh64_intdigest(bytes([b]), 17) | 1 for b in range(256)], np.uint64)
        _workers.update(n=n, tables=(values, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)))
    return _workers["tables"]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def blocks(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of joined texts that end at ``ends``: (first window, windows, anchor, hash of the gram)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    values, powers, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[np.frombuffer(data, np.uint8)] * powers[:n], out=sums[1:])
        grams = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1] * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
        least = _least(grams, SPAN)
        inside = np.ones(len(least), bool)  # windows of a single text
        for end in ends.tolist():
            inside[max(0, end - LENGTH + 1) : end] = False
        cut = np.empty(len(least), bool)
        cut[0] = True
        cut[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        first = np.nonzero(cut & inside)[0]
        if not len(first):
            return none, none, none, none
        stops = np.nonzero(np.concatenate([cut | ~inside, [True]]))[0]
        last = stops[np.searchsorted(stops, first, "right")] - 1
        place = np.empty(len(first), np.int64)
        for k in range(0, len(first), 1 << 14):
            own = first[k : k + (1 << 14)]
            place[k : k + len(own)] = own + (np.lib.stride_tricks.sliding_window_view(grams, SPAN)[own] == least[own][:, None]).argmax(axis=1)
        late = np.nonzero(last > place)[0]  # the same gram comes again before the block ends
        if len(late):
            more = []
            for k in late.tolist():
                found = first[k] + np.nonzero(grams[first[k] : last[k] + SPAN] == least[first[k]])[0]
                windows = np.arange(place[k] + 1, last[k] + 1)
                at = found[np.searchsorted(found, windows)]
                starts = windows[np.concatenate(([True], at[1:] != at[:-1]))]
                more.append(np.stack([starts, np.append(starts[1:] - 1, last[k]), at[np.searchsorted(windows, starts)]]))
            last[late] = place[late]
            first, last, place = np.concatenate([np.stack([first, last, place]), *more], axis=1)
        return first, last - first + 1, place, grams[place].view(np.int64)


def digests(data: bytes, first: np.ndarray, n: np.ndarray, key: bytes) -> np.ndarray:
    """Keyed digests of the bytes of blocks."""
    start, view = hashlib.sha256(key), memoryview(data)

    def one(a: int, b: int) -> bytes:
        own = start.copy()
        own.update(view[a:b])
        return own.digest()[:8]

    return np.frombuffer(b"".join(map(one, first.tolist(), (first + n + LENGTH - 1).tolist())), np.int64)


def _marked(docs: DataFrame) -> DataFrame:
    """With 16 bits of a hash of the text, which tell texts that share an id apart."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 16)).alias("version"))


def block_rows(docs: DataFrame, key: bytes) -> DataFrame:
    """(gram, whole, doc_id, at) of (doc_id, text, version).

    ``at`` packs first window, version, windows and the anchor's distance. Of blocks of the same gram and bytes that a
    task meets among COMBINED, all but the first are copies for sure: their ``at`` is inverted, and their gram, which they
    need not meet others by, is exchanged for a spread one. So however common a block is, few of its rows come together.
    """
    schema = StructType([StructField("gram", LongType()), StructField("whole", LongType()), docs.schema["doc_id"], StructField("at", LongType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            texts, versions = batch.column(1).cast(pa.binary()), batch.column(2).to_numpy()
            parts: list[bytes] = []
            owners: list[tuple[int, int]] = []  # (row, first byte)
            size = 0
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                for base in range(0, max(1, len(text) - LENGTH + 1), STRETCH):
                    parts.append(text[base : base + STRETCH + LENGTH - 1])
                    owners.append((row, base))
                    size += len(parts[-1])
                    if size >= 1 << 19:
                        held.append(rows(batch.column(0), parts, owners, versions))
                        parts, owners, size = [], [], 0
            if parts:
                held.append(rows(batch.column(0), parts, owners, versions))
            if sum(len(h[0]) for h in held) >= COMBINED:
                yield combined(held)
                held = []
        if held:
            yield combined(held)

    def rows(ids, parts, owners, versions):
        ends = np.cumsum([len(p) for p in parts])
        data = b"".join(parts)
        first, n, place, gram = blocks(data, ends)
        part = np.searchsorted(ends, first, "right")
        starts = np.concatenate(([0], ends[:-1]))
        row, base = np.array(owners, np.int64).T
        at = ((first - starts[part] + base[part]) << 30) | (versions[row[part]].astype(np.int64) << 14) | ((n - 1) << 7) | (place - first)
        return gram, digests(data, first, n, key), at, ids.take(pa.array(row[part]))

    def combined(held):
        gram, whole, at = (np.concatenate([h[k] for h in held]) for k in range(3))
        ids = pa.chunked_array([h[3] for h in held]).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.lexsort((at, rank, whole, gram))
        same = np.concatenate(([False], _same(gram[order]) & _same(whole[order])))
        again = same & np.concatenate(([False], _same(at[order]) & _same(rank[order])))  # one row of ``docs`` that stands twice
        order, same = order[~again], same[~again]
        spread = np.where(same, at[order] ^ (rank[order] << 8), gram[order])
        return pa.RecordBatch.from_arrays([pa.array(spread), pa.array(np.where(same, 0, whole[order])), ids.take(pa.array(order)), pa.array(np.where(same, ~at[order], at[order]))], schema=out)

    return docs.mapInArrow(run, schema)


def _same(a: np.ndarray) -> np.ndarray:
    return a[1:] == a[:-1]


def sifted(rows: DataFrame) -> DataFrame:
    """(gram, doc_id, at, copy) of block rows: copies but for the first of each block, and firsts whose gram has other blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first block, whose gram may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            marked = table.column("at").to_numpy() < 0
            if marked.any():
                known = table.filter(pa.array(marked)).combine_chunks()
                yield pa.RecordBatch.from_arrays([known.column("gram").chunk(0), known.column("doc_id").chunk(0), pa.array(~known.column("at").to_numpy()), pa.array(np.ones(known.num_rows, bool))], schema=out)
            table = table.filter(pa.array(~marked)).combine_chunks()
            if not table.num_rows:
                continue
            before = held is not None
            if before:
                table = pa.concat_tables([held["last"], held["first"], table]).combine_chunks()
            gram, whole, at = (table.column(c).to_numpy() for c in ("gram", "whole", "at"))
            docs = table.column("doc_id").to_numpy(zero_copy_only=False)
            same = np.concatenate(([False], _same(gram) & _same(whole)))
            equal = same & np.concatenate(([False], _same(at) & _same(docs)))  # one row of ``docs`` that stands twice
            skip = 2 if before else 0
            copies = np.nonzero(same & ~equal)[0]
            copies = copies[copies >= skip]
            firsts = np.nonzero(~same)[0]
            if before:  # row 0 is the last row of all, row 1 the last first block
                firsts = np.concatenate(([1], firsts[firsts >= 2]))
            near = _same(gram[firsts])
            crowd = np.concatenate(([before and held["crowd"]], near)) | np.concatenate((near, [False]))
            shown = firsts[:-1][crowd[:-1]]
            taken = np.concatenate([copies, shown])
            yield table.select(["gram", "doc_id", "at"]).take(pa.array(taken)).append_column("copy", pa.array(np.arange(len(taken)) < len(copies))).combine_chunks().to_batches()[0] if len(taken) else empty
            held = {"last": table.slice(table.num_rows - 1), "first": table.slice(int(firsts[-1]), 1), "crowd": bool(crowd[-1])}
        if held is not None and held["crowd"]:
            yield held["first"].select(["gram", "doc_id", "at"]).append_column("copy", pa.array([False])).combine_chunks().to_batches()[0]

    schema = StructType([*(rows.schema[c] for c in ("gram", "doc_id", "at")), StructField("copy", BooleanType())])
    out = to_arrow_schema(schema)
    empty = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in out], schema=out)
    return rows.repartition("gram").sortWithinPartitions("gram", "whole", "doc_id", "at").mapInArrow(run, schema)


def longest_previous(position: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: ``position`` of each suffix, ``prefix`` that it shares with the one before.

    The nearest smaller position on either side is found by jumps: from a neighbour that is no smaller to the one that
    it has come to itself, with the least common prefix on the way.
    """
    n = len(position)

    def side(position: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        at, low = np.arange(-1, n - 1), prefix.copy()
        left = np.nonzero((at >= 0) & (position[at] > position))[0]
        while len(left):
            over = at[left]
            low[left], at[left] = np.minimum(low[left], low[over]), at[over]
            left = left[(at[left] >= 0) & (position[at[left]] > position[left])]
        return np.where(at >= 0, low, 0)

    back = np.append(prefix[1:], 0)[::-1]  # the same from the other end
    return np.maximum(side(position, prefix), side(position[::-1], back)[::-1])


def later_windows(gram: np.ndarray, texts: list[bytes], n: np.ndarray) -> np.ndarray:
    """(blocks, SPAN) whether each window of the blocks is a later copy of one of another block of the same gram.

    Blocks are sorted by gram, then position; each has ``n`` windows, from its first byte on. Windows whose hash stands
    alone match nothing; the suffixes of all others are sorted as far as LENGTH bytes, equal ones by position.
    """
    size = len(texts)
    ends = np.cumsum(n)
    block = np.repeat(np.arange(size), n)
    offset = np.arange(ends[-1]) - np.repeat(ends - n, n)
    starts = np.cumsum([0, *map(len, texts[:-1])])[block] + offset
    width = LENGTH + (-LENGTH) % 8
    data = np.frombuffer(b"".join(texts) + bytes(width), np.uint8)
    values, powers, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[: len(data)], out=sums[1:])
    hashes = (sums[starts + LENGTH] - sums[starts]) * inverse[starts]
    by_hash = np.argsort(hashes)
    alike = _same(hashes[by_hash])
    several = np.sort(by_hash[np.concatenate((alike, [False])) | np.concatenate(([False], alike))])
    found = np.zeros((size, SPAN), bool)
    if not len(several):
        return found
    block, offset, starts = block[several], offset[several], starts[several]
    suffixes = np.lib.stride_tricks.sliding_window_view(data, width)[starts]
    suffixes[:, LENGTH:] = 0
    order = np.lexsort((*suffixes.view(">u8").astype(np.uint64).T[::-1], gram[block]))  # stable, so equal ones stay by position
    unlike = suffixes[order[1:]] != suffixes[order[:-1]]
    prefix = np.zeros(len(order), np.int64)
    prefix[1:] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), LENGTH)
    prefix[1:][gram[block[order[1:]]] != gram[block[order[:-1]]]] = 0
    late = order[longest_previous(order, prefix) >= LENGTH]
    found[block[late], offset[late]] = True
    return found


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, columns) of the runs of true."""
    wide = np.zeros((found.shape[0], found.shape[1] + 2), np.int8)
    wide[:, 1:-1] = found
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - first


def _crowded(wanted: DataFrame) -> DataFrame:
    """(doc_id, version, start, n) of later windows, of rows (doc_id, version, text, wanted), window by window."""
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py().encode()
                for x in batch.column(3)[row].as_py():
                    first, n = x["at"] >> 30, ((x["at"] >> 7) & 127) + 1
                    marks = [hashlib.sha256(text[s : s + LENGTH]).digest() for s in range(first, first + n)]
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), batch.column(0).slice(row, 1).take(pa.array([0] * n)), batch.column(1).slice(row, 1).take(pa.array([0] * n)), pa.array(range(first, first + n), pa.int64())], names=["mark", "doc_id", "version", "start"])

    windows = stored(wanted.mapInArrow(run, f"mark binary, doc_id {kind}, version long, start long"), "windows")
    first = windows.groupBy("mark").agg(F.min(F.struct("doc_id", "start", "version")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("mark", "first")
    return windows.join(first, "mark").where(F.struct("doc_id", "start", "version") > F.col("first")).select("doc_id", "version", "start", F.lit(1).cast("long").alias("n"))


def _sorted_out(wanted: DataFrame) -> DataFrame:
    """(doc_id, version, start, n) of later windows, of rows (doc_id, version, text, wanted), by sorted suffixes."""
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 64):
                part = batch.slice(base, 64)
                rows, grams, places, parts = [], [], [], []
                for row in range(part.num_rows):
                    text = part.column(2)[row].as_py().encode()
                    for x in part.column(3)[row].as_py():
                        first = x["at"] >> 30
                        rows.append(row)
                        grams.append(x["gram"])
                        places.append(x["at"])
                        parts.append(text[first : first + ((x["at"] >> 7) & 127) + LENGTH])
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int64()), part.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(parts, pa.binary())], names=["gram", "doc_id", "at", "bytes"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "gram", 8_000):
            at = table.column("at").to_numpy()
            row, first, n = _spans(later_windows(table.column("gram").to_numpy(), table.column("bytes").to_pylist(), ((at >> 7) & 127) + 1))
            docs = table.column("doc_id").combine_chunks()
            docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(row)), pa.array((at[row] >> 14) & 0xFFFF), pa.array((at[row] >> 30) + first), pa.array(n)], names=["doc_id", "version", "start", "n"])

    found = wanted.mapInArrow(cut, f"gram long, doc_id {kind}, at long, bytes binary")
    return found.repartition("gram").sortWithinPartitions("gram", "doc_id", "at").mapInArrow(match, f"doc_id {kind}, version long, start long, n long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, start, n): runs of n windows, by first byte, that are later copies; of (doc_id, text, version)."""
    known = docs.where("doc_id is not null and text is not null")
    found = stored(sifted(block_rows(known, os.urandom(16))), "blocks")
    version = F.shiftright("at", 14).bitwiseAND(0xFFFF)
    copies = found.where("copy").select("doc_id", version.alias("version"), F.shiftright("at", 30).alias("start"), (F.shiftright("at", 7).bitwiseAND(127) + 1).alias("n"))
    first = found.where("not copy").select("gram", "doc_id", version.alias("version"), "at")
    crowds = first.groupBy("gram").count().where(F.col("count") > CROWD).select("gram", F.lit(True).alias("crowd"))
    crowds = stored(crowds, "crowds")
    parts = [copies]
    for crowd, way in ((False, _sorted_out), (True, _crowded)):
        own = first.join(crowds, "gram", "left_semi" if crowd else "left_anti")
        if crowd and crowds.isEmpty():
            continue
        lists = own.groupBy("doc_id", "version").agg(F.collect_list(F.struct("gram", "at")).alias("wanted"))
        parts.append(stored(way(known.join(lists.hint("shuffle_hash"), ["doc_id", "version"]).select("doc_id", "version", "text", "wanted")), "later"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if not spans:
        return text, 0, 0
    change = np.zeros(len(text) + 1, np.int64)
    start, n = np.array([(s["start"], s["n"]) for s in spans], np.int64).T
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    left = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return left, int(gone.sum()), int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum())


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of ``docs``; ``kept`` is the bytes left.

    Texts are bytes of UTF-8, so ``kept`` need not be text. Each byte goes that a string of LENGTH bytes covers which
    also starts earlier: in a document of smaller id, or earlier in the same one. Strings overlap, never cross documents,
    and are judged on the input. A null text is empty. Rows with a null id lose nothing and are no sources. Rows that
    share id and text are one document, and get equal results; of texts that share an id, a hash settles which is
    earlier where positions tie. Other columns are left out; an empty table gives an empty result.
    """
    texts = _marked(texts_of(docs, id_col, text_col))
    spans = repeated_windows(texts)
    lists = spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = texts.join(lists.hint("shuffle_hash"), ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 256):
                part = batch.slice(base, 256)
                out = []
                for text, own in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text = text or b""
                    left, removed, runs_ = _cut(text, own or [])
                    out.append((left, len(text), removed, runs_, hashlib.sha256(left).hexdigest()))
                kept, size, removed, count, digest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(cut, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
