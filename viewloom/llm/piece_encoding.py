"""SentencePiece encoding and decoding with seeded merge-dropout.

Pieces come from a public BPE model with byte fallback. As in the model's own encoder, candidate merges wait on an
agenda, best score first and the leftmost of equals; each candidate that comes up is skipped with the chance of dropout.
A skipped candidate returns only when a neighbour has changed. Draws are keyed by the seed, the document's id and the
place in the document, so every occurrence of a word is cut by draws of its own, always the same ones for the same seed.
Without dropout the result is the model's own encoding.

No piece reaches over a space that follows other characters, or holds a line feed, so stretches between them are encoded
on their own. What a stretch becomes depends only on which of its candidates, by order of coming up, are skipped. A draw
tells how many candidates pass before the next one skipped (a geometric number), so an occurrence takes one draw more
than it has skips. Occurrences walk from the stretch without skips to the one with theirs, all of a batch at once: a
stretch with given skips is a row of a bounded table, and rows that are missing are encoded together, a candidate of
each at a time.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from viewloom.llm.common import over_texts, texts_of, tokenizer_file

#: Stands for a space in the vocabulary (fixed value of the format).
SPACE_MARK = "▁"
STRETCHES = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall
#: The agenda of a longer stretch is a heap; that of others is a row of scores, of which the least is looked for.
WIDEST = 256
#: Stretches of a batch that are encoded together.
TOGETHER = 1 << 17

#: The rank of two symbols that no piece joins.
_NONE = np.int32(2**31 - 1)
_workers: dict = {}


class Merges:
    """A hash table from two symbols to the rank of their merge and the symbol that it makes, for many pairs at once."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], made: list[int]):
        self.bits = max(8, (2 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << self.bits, _NONE), np.zeros(1 << self.bits, np.int32)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        rank_, made_ = np.array(rank, np.int32), np.array(made, np.int32)
        slots, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            self.keys[slots[free]] = keys[free]  # of those that share a slot, one stays
            won = free[self.keys[slots[free]] == keys[free]]
            self.ranks[slots[won]], self.made[slots[won]] = rank_[won], made_[won]
            todo = np.setdiff1d(todo, won)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) for neighbours; an empty slot has no rank."""
        keys = (a.astype(np.int64) << 32) | b
        slots = self.slot(keys)
        held = self.keys[slots]
        left = np.nonzero((held != keys) & (held >= 0))[0]
        while len(left):  # slots that hold another pair
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[left]]
            left = left[(held != keys[left]) & (held >= 0)]
        return self.ranks[slots], self.made[slots]


class Codec:
    """Encodes and decodes with one model; keeps encoded stretches up to a bound."""

    def __init__(self, path: str, dropout: float, seed: int, kept: int = 100_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {pieces[i]: i for i in normal}
        self.scores = {pieces[i]: -model.get_score(i) for i in normal}
        raw = [p.replace(SPACE_MARK, " ").encode() for p in pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.large_binary())
        order = {s: k for k, s in enumerate(sorted(set(self.scores.values())))}
        symbols = list(dict.fromkeys([*self.ids, *(c for p in self.ids for c in p)]))
        place = {s: k for k, s in enumerate(symbols)}
        self.id_of = np.array([self.ids.get(s, -1) for s in symbols] + [-1, -1], np.int32)
        self.strange, self.gone = len(symbols), len(symbols) + 1  # a character that no piece holds, and what a merge has swallowed
        self.symbol = np.full(0x110000, self.strange, np.int32)
        for s in symbols:
            if len(s) == 1:
                self.symbol[ord(s)] = place[s]
        self.symbol[ord(" ")], self.symbol[ord(SPACE_MARK)] = place.get(SPACE_MARK, self.strange), self.strange  # a mark in the text itself goes to bytes
        splits = [(place[p[:k]], place[p[k:]], order[self.scores[p]], place[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in place and p[k:] in place]
        self.merges = Merges(*map(list, zip(*splits, strict=True))) if splits else Merges([], [], [], [])
        self.plain: dict[int, int] = {}  # the same for single pairs, if a long stretch asks for it
        self.dropout = dropout
        self.log_pass = math.log1p(-dropout) if 0 < dropout < 1 else -math.inf
        self.seed, self.kept = seed, kept
        self.forget()

    def forget(self) -> None:
        """Empties the table of stretches."""
        self.names: dict[str, int] = {}  # the row of a stretch without skips
        self.next: dict[int, int] = {}  # the row of one skip more, by row and number of the candidate
        self.texts: list[str] = []
        self.candidates, self.first, self.length = (np.zeros(1024, np.int64) for _ in range(3))
        self.pool, self.filled = np.zeros(1 << 14, np.int32), 0

    def passing(self, keys: np.ndarray, places: np.ndarray, turn: int | np.ndarray) -> np.ndarray:
        """How many candidates pass before one is skipped, for the draw ``turn`` at places of the documents with ``keys``."""
        x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + keys + np.asarray(turn, np.uint64) * np.array([0xD6E8FEB86659FD93], np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 1
        return np.minimum(np.log(u * 2.0**-53) / self.log_pass, 1e9).astype(np.int64)

    def cut(self, texts: list[str], skip: np.ndarray, keys: np.ndarray | None = None, places: np.ndarray | None = None, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many candidates of each stretch come up when the one numbered ``skip`` is skipped, how many ids there are, and all ids.

        With ``keys`` and ``places`` ``skip`` is the draw ``turn``, and further draws tell what else is skipped.
        """
        rows, n = len(texts), max(map(len, texts))
        sizes = np.fromiter(map(len, texts), np.int64, rows)
        symbols = self.symbol[np.array(texts, f"<U{n}").view("<u4").reshape(rows, n)]
        symbols[np.arange(n) >= sizes[:, None]] = self.gone
        done = symbols.copy()  # rows whose agenda is empty
        ranks, made = np.full((rows, n), _NONE), np.zeros((rows, n), np.int32)
        if n > 1:
            flat = self.merges.of(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
            ranks[:, :-1], made[:, :-1] = (x.reshape(rows, n - 1) for x in flat)
        after, before = np.tile(np.arange(1, n + 1, dtype=np.int32), (rows, 1)), np.tile(np.arange(-1, n - 1, dtype=np.int32), (rows, 1))
        candidates, own = np.zeros(rows, np.int64), np.arange(rows)
        came, skip, turns = np.zeros(rows, np.int64), skip.copy(), np.full(rows, turn)
        while len(own):
            at = ranks.argmin(axis=1)
            r = np.nonzero(ranks[np.arange(len(own)), at] != _NONE)[0]
            if len(r) < 0.7 * len(own):
                over = np.ones(len(own), bool)
                over[r] = False
                done[own[over]], candidates[own[over]] = symbols[over], came[over]
                own, symbols, ranks, made, after, before, came, skip, turns, at = (x[r] for x in (own, symbols, ranks, made, after, before, came, skip, turns, at))
                r = np.arange(len(own))
            drop = came[r] == skip[r]
            came[r] += 1
            i = at[r]
            if drop.any():
                d = r[drop]
                ranks[d, i[drop]] = _NONE
                if keys is None:
                    skip[d] = -1
                else:
                    turns[d] += 1
                    skip[d] += 1 + self.passing(keys[own[d]], places[own[d]], turns[d])
                r, i = r[~drop], i[~drop]
            j = after[r, i]
            k = after[r, j]
            whole = made[r, i]
            symbols[r, i], symbols[r, j] = whole, self.gone
            ranks[r, j] = _NONE
            after[r, i] = k
            inside = k < n
            before[r[inside], k[inside]] = i[inside]
            ranks[r, i], made[r, i] = self.merges.of(whole, np.where(inside, symbols[r, np.minimum(k, n - 1)], self.gone))
            h = before[r, i]
            has = h >= 0
            r, h, whole = r[has], h[has], whole[has]
            ranks[r, h], made[r, h] = self.merges.of(symbols[r, h], whole)
        stays = done != self.gone
        ids, lengths = self.id_of[done[stays]], stays.sum(axis=1)
        if (ids < 0).any():  # characters that are no piece go to bytes
            row, col = np.nonzero(stays)
            wide = np.ones(len(ids), np.int64)
            strange = np.nonzero(ids < 0)[0]
            parts = [texts[r][c].encode() for r, c in zip(row[strange].tolist(), col[strange].tolist(), strict=True)]
            wide[strange] = list(map(len, parts))
            ends = np.cumsum(wide)
            whole = np.zeros(ends[-1], np.int32)
            whole[ends - wide] = ids
            at = np.repeat((ends - wide)[strange] - np.cumsum(wide[strange]) + wide[strange], wide[strange]) + np.arange(wide[strange].sum())
            whole[at] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(parts), np.uint8)]
            ids, lengths = whole, np.bincount(row, wide, rows).astype(np.int64)
        return candidates, lengths, ids

    def cut_long(self, text: str, key: np.uint64, place: int) -> np.ndarray:
        """Ids of a stretch of any length at a place of a document, with a heap."""
        if not self.plain:
            some = self.merges.keys >= 0
            self.plain = dict(zip(self.merges.keys[some].tolist(), ((self.merges.ranks[some].astype(np.int64) << 32) | self.merges.made[some]).tolist(), strict=True))
        known = self.plain.get
        symbols = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(found >> 32, i, a, b, found & 0xFFFFFFFF) for i, (a, b) in enumerate(pairwise(symbols)) if (found := known(a << 32 | b)) is not None]
        heapq.heapify(agenda)
        keys, places = np.array([key]), np.array([place])
        came, turn = 0, 0
        skip = int(self.passing(keys, places, 0)[0]) if self.dropout else -1
        while agenda:
            _, i, a, b, made = heapq.heappop(agenda)
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue  # one of the two has changed
            came += 1
            if came - 1 == skip:
                turn += 1
                skip += 1 + int(self.passing(keys, places, turn)[0])
                continue
            symbols[i], symbols[j] = made, self.gone
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := known(made << 32 | symbols[k])) is not None:
                    heapq.heappush(agenda, (found >> 32, i, made, symbols[k], found & 0xFFFFFFFF))
            if (h := before[i]) >= 0 and (found := known(symbols[h] << 32 | made)) is not None:
                heapq.heappush(agenda, (found >> 32, h, symbols[h], made, found & 0xFFFFFFFF))
        out: list[int] = []
        for c, s in zip(text, symbols, strict=True):
            if s != self.gone:
                piece = int(self.id_of[s])
                out += [piece] if piece >= 0 else [self.byte_ids[b] for b in c.encode()]
        return np.array(out, np.int32)

    def together(self, texts: list[str], *columns: np.ndarray, **options: int) -> Iterator[tuple[np.ndarray, tuple]]:
        """``cut`` of stretches of about the same length together: (which, what ``cut`` gives)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        groups = np.where(sizes <= 24, -(-sizes // 4) * 4, 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for n in np.unique(groups).tolist():
            own, step = np.nonzero(groups == n)[0], max(16, (1 << 19) // n)
            for lo in range(0, len(own), step):
                part = own[lo : lo + step]
                yield part, self.cut([texts[k] for k in part.tolist()], *(c[part] for c in columns), **options)

    def added(self, texts: list[str], skip: np.ndarray) -> np.ndarray:
        """The rows of stretches with one candidate skipped, or none (-1), which are new to the table."""
        rows = np.arange(len(self.texts), len(self.texts) + len(texts))
        self.texts += texts
        self.grow(len(self.texts))
        for part, (came, lengths, ids) in self.together(texts, skip):
            self.candidates[rows[part]] = came
            self.put(rows[part], lengths, ids)
        return rows

    def grow(self, rows: int) -> None:
        if rows > len(self.first):
            self.candidates, self.first, self.length = (np.concatenate([x, np.zeros(rows, np.int64)]) for x in (self.candidates, self.first, self.length))

    def put(self, rows: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.length[rows] = lengths
        self.first[rows] = self.filled + np.cumsum(lengths) - lengths
        self.filled += len(ids)

    def encode_parts(self, parts: list[str], keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of stretches at places of the documents with ``keys``, and how many each has."""
        if len(self.texts) > self.kept or self.filled > 8 * self.kept:
            self.forget()
        rows = np.fromiter(map(self.names.get, parts, repeat(-1)), np.int64, len(parts))
        new = [t for t in dict.fromkeys([parts[i] for i in np.nonzero(rows < 0)[0].tolist()]) if len(t) <= WIDEST]
        if new:
            self.names.update(zip(new, self.added(new, np.full(len(new), -1)).tolist(), strict=True))
            rows = np.fromiter(map(self.names.get, parts, repeat(-1)), np.int64, len(parts))
        long = np.nonzero(rows < 0)[0]
        if self.dropout:
            first = self.passing(keys, places, 0)
            active = np.nonzero((rows >= 0) & (first < self.candidates[rows]))[0]
            steps = (rows[active] << 20) | first[active]
            known = np.fromiter(map(self.next.get, steps.tolist(), repeat(-1)), np.int64, len(active))
            if (known < 0).any():
                missing = np.unique(steps[known < 0])
                found = self.added([self.texts[s] for s in (missing >> 20).tolist()], missing & 0xFFFFF)
                self.next.update(zip(missing.tolist(), found.tolist(), strict=True))
                known = np.fromiter(map(self.next.get, steps.tolist()), np.int64, len(active))
            rows[active] = known
            second = first[active] + 1 + self.passing(keys[active], places[active], 1)
            more = active[second < self.candidates[known]]
        else:
            more = long[:0]
        kept, base = self.filled, len(self.texts)  # what comes behind serves just these occurrences
        rows[more], rows[long] = base + np.arange(len(more)), base + len(more) + np.arange(len(long))
        self.grow(base + len(more) + len(long))
        if len(more):
            for part, (_, lengths, ids) in self.together([parts[i] for i in more.tolist()], first[more], keys[more], places[more]):
                self.put(base + part, lengths, ids)
        for i in long.tolist():
            ids = self.cut_long(parts[i], keys[i], int(places[i]))
            self.put(rows[i : i + 1], np.array([len(ids)]), ids)
        lengths = self.length[rows]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.first[rows] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        self.filled = kept
        return ids, lengths

    def encode_all(self, texts: list[str], documents: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of whole texts by the draws of ``documents``, and how many each has; none for an empty text."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        parts: list[str] = []
        spans: list[tuple[int, np.uint64, int, int]] = []  # (text, key, first place, stretches)

        def flush() -> None:
            keys, n = np.array([s[1] for s in spans], np.uint64), np.array([s[3] for s in spans], np.int64)
            places = np.arange(len(parts)) + np.repeat(np.array([s[2] for s in spans], np.int64) - np.cumsum(n) + n, n)
            found, lengths = self.encode_parts(parts, np.repeat(keys, n), places)
            ids.append(found)
            np.add.at(counts, np.repeat([s[0] for s in spans], n), lengths)
            parts.clear()
            spans.clear()

        for t, (text, document) in enumerate(zip(texts, documents, strict=True)):
            if not text:
                continue
            own = STRETCHES(" " + text)
            key = np.uint64(xxhash.xxh64_intdigest(str(document), self.seed))
            for at in range(0, len(own), TOGETHER):
                part = own[at : at + TOGETHER]
                parts += part
                spans.append((t, key, at, len(part)))
                if len(parts) >= TOGETHER:
                    flush()
        if parts:
            flush()
        return np.concatenate(ids), counts

    def encode(self, text: str, document: object = 0) -> np.ndarray:
        """Ids of a whole text, by the draws of ``document``; none for an empty one."""
        return self.encode_all([text], [document])[0]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of ids, of which each text has so many, without the space that encoding put before it."""
        whole = self.raw.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(whole.buffers()[1], np.int64)[: len(ids) + 1][np.concatenate(([0], np.cumsum(counts)))] if len(ids) else np.zeros(len(counts) + 1, np.int64)
        data = whole.buffers()[2].to_pybytes() if len(ids) else b""
        texts = [data[a:b] for a, b in pairwise(ends.tolist())]
        return [t[1:] if t.startswith(b" ") else t for t in texts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids."""
        return self.decode_all(ids, np.array([len(ids)]))[0]


def _codec(path: str, dropout: float, seed: int) -> Codec:
    key = (path, dropout, seed)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Codec(path, dropout, seed)
    return _workers[key]


def piece_encoding(docs: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1, seed: int = 7) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless), a row for each row of ``docs``.

    ``lossless`` says that decoding the ids gave back the text byte for byte. A null text has null ids, no tokens and is
    lossless; an empty one has no ids. With ``dropout`` 0 the ids are those of the model's own encoder, but that a space
    mark in the text itself goes to bytes, to come back as it was. Draws are keyed by a document's id (a null id's too)
    and the place in it. Texts of any length are encoded whole. Equal rows get equal results; other columns are left
    out; an empty table gives an empty result.
    """
    path = tokenizer_file(model)

    def encode(ids: list, texts: list) -> list:
        codec = _codec(path, dropout, seed)
        found, counts = codec.encode_all([(t or b"").decode("utf-8", "replace") for t in texts], ids)
        lossless = [back == (t or b"") for back, t in zip(codec.decode_all(found, counts), texts, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(found, pa.int32()), mask=pa.array([t is None for t in texts]))
        return [ids, lists, pa.array(counts, pa.int64()), lossless]

    texts = texts_of(docs, id_col, text_col)
    return over_texts(texts, encode, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, lossless boolean", size=512)


def piece_decoding(encoded: DataFrame, *, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids give a null text. Ids outside the vocabulary raise."""
    path = tokenizer_file(model)
    own = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batches):
        codec = _codec(path, 0.0, 0)
        for batch in batches:
            texts = [None if ids is None else codec.decode(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
