"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all
its segmentations into pieces of the product of their probabilities, which a forward algorithm gives in one sweep; a
text's likelihood is the product over its words. The probabilities are fitted by expectation and maximisation: the
forward and backward sums give how often each piece is expected in the training words.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import held_out, over_texts, texts_of, tokenizer_file

#: Starts a word in the vocabulary (fixed value of the format).
START = "▁"
#: Sums over longer words are kept as logarithms, which no length makes too small.
PLAIN = 40
#: Probability of a character that the vocabulary lacks, alike in all languages.
UNKNOWN = 1e-7
#: Base of the hashes of substrings.
_BASE = 0x9E3779B97F4A7C15
#: Slots of the hash table of pieces.
_SLOTS = 1 << 18

_workers: dict = {}


class Vocabulary:
    """The pieces of a public vocabulary, without control, unknown and byte pieces."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.ids = {p: n for n, p in enumerate(dict.fromkeys(model.id_to_piece(i) for i in normal))}
        self.size = len(self.ids)
        self.longest = max(map(len, self.ids), default=1)
        self.words = regex.compile(r"\p{L}+").findall
        # an open hash table of the pieces' hashes, to look up many substrings at once
        self.powers = self.inverse = np.zeros(0, np.uint64)
        self.reach(max(PLAIN, self.longest) + 1)
        self.keys, self.places = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        for piece, n in self.ids.items():
            key = self.hashes([piece])[0, 0, -1]
            slot = int(key & np.uint64(_SLOTS - 1))
            while self.places[slot] >= 0:
                slot = (slot + 1) % _SLOTS
            self.keys[slot], self.places[slot] = key, n

    def reach(self, n: int) -> None:
        """Sees to powers of the base, and of its inverse, for words of ``n`` letters."""
        if len(self.powers) < n:
            self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(2 * n)], np.uint64)
            self.inverse = np.array([pow(_BASE, -k, 1 << 64) for k in range(2 * n)], np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        """Hashes of the substrings of words of one length: (words, start, length - 1); those beyond the end mean nothing."""
        n = len(words[0])
        self.reach(n)
        codes = np.array(words, f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)
        with np.errstate(over="ignore"):
            codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            sums = np.zeros((len(words), n + 1), np.uint64)
            np.cumsum((codes ^ (codes >> np.uint64(29))) * self.powers[:n], axis=1, out=sums[:, 1:])
            starts = np.arange(n)
            ends = np.minimum(starts[:, None] + np.arange(1, min(n, self.longest) + 1), n)
            found = (sums[:, ends] - sums[:, :n, None]) * self.inverse[:n, None]
            return (found ^ (found >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)

    def words_of(self, text: str) -> list[str]:
        """Lower-cased runs of letters."""
        return self.words(text.lower())

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length, marked with START: piece ids by (end, length); -1 is none, ``size`` unknown."""
        marked = [START + w for w in words]
        n = len(marked[0])
        hashes = self.hashes(marked)
        flat = hashes.ravel()
        slots = (flat & np.uint64(_SLOTS - 1)).astype(np.int32)
        ids = self.places[slots]
        left = np.nonzero((ids >= 0) & (self.keys[slots] != flat))[0]  # slots that hold another piece
        while len(left):
            slots[left] = (slots[left] + 1) % _SLOTS
            ids[left] = self.places[slots[left]]
            left = left[(ids[left] >= 0) & (self.keys[slots[left]] != flat[left])]
        ids = ids.reshape(hashes.shape)
        ids[:, :, 0] = np.where(ids[:, :, 0] < 0, self.size, ids[:, :, 0])
        some = (ids >= 0).any(axis=0)
        arcs = {}
        for end in range(1, n + 1):
            for length in range(1, min(end, self.longest) + 1):
                if some[end - length, length - 1]:
                    arcs[end, length] = ids[:, end - length, length - 1]
        return arcs


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[len(w)].append(i)
    return groups


def _forward(arcs: dict, n: int, probs: np.ndarray, words: int) -> np.ndarray:
    """Sums over the segmentations of each prefix, (n + 1, words, languages). ``probs`` has a last row of zeros."""
    sums = np.zeros((n + 1, words, probs.shape[1]))
    sums[0] = 1
    for (end, length), ids in arcs.items():
        sums[end] += sums[end - length] * probs[ids]
    return sums


def _logs(probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(probs)


def _log_forward(arcs: dict, n: int, logs: np.ndarray, words: int) -> np.ndarray:
    """The same as logarithms."""
    sums = np.full((n + 1, words, logs.shape[1]), -np.inf)
    sums[0] = 0
    for (end, length), ids in arcs.items():
        sums[end] = np.logaddexp(sums[end], sums[end - length] + logs[ids])
    return sums


def _batches(at: list[int], n: int) -> Iterator[list[int]]:
    """Words of ``n`` letters, so many together that tables of their substrings stay small."""
    step = max(1, min(1024, 40_960 // n))
    return (at[k : k + step] for k in range(0, len(at), step))


def word_scores(vocabulary: Vocabulary, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log likelihoods of words, (words, languages)."""
    out = np.zeros((len(words), probs.shape[1]))
    for n, at in _by_length(words).items():
        for own in _batches(at, n):
            arcs = vocabulary.lattice([words[i] for i in own])
            if n <= PLAIN:
                out[own] = np.log(np.maximum(_forward(arcs, n + 1, probs, len(own))[-1], 1e-300))
            else:
                out[own] = _log_forward(arcs, n + 1, _logs(probs), len(own))[-1]
    return out


def fit(vocabulary: Vocabulary, counts: dict[str, dict[str, int]], languages: list[str], rounds: int = 3, backing: float = 500.0) -> np.ndarray:
    """Piece probabilities (size + 2, languages): the row before the last is for unknown characters, the last is zero."""
    words = sorted(set(chain.from_iterable(counts[x] for x in languages)))
    weight = np.array([[counts[x].get(w, 0) for x in languages] for w in words], float)
    lattices = [(own, n + 1, vocabulary.lattice([words[i] for i in own])) for n, at in _by_length(words).items() for own in ([at] if n <= PLAIN else _batches(at, n))]
    size, width = vocabulary.size, len(languages)
    expected = np.zeros((size, width))
    for at, _, arcs in lattices:  # to begin with, each piece counts wherever it fits, longer ones more
        for (_, length), ids in arcs.items():
            known = (ids >= 0) & (ids < size)
            np.add.at(expected, ids[known], weight[at][known] * length)
    for _ in range(rounds + 1):
        shared = (expected.sum(1) + 0.01) / (expected.sum() + 0.01 * size)
        probs = np.vstack([(expected + backing * shared[:, None]) / (expected.sum(0) + backing), np.full((1, width), UNKNOWN), np.zeros((1, width))])
        expected = np.zeros((size, width))
        for at, n, arcs in lattices:
            if n > PLAIN + 1:
                logs = _logs(probs)
                before = _log_forward(arcs, n, logs, len(at))
                after = np.full_like(before, -np.inf)
                after[n] = 0
                for (end, length), ids in reversed(arcs.items()):
                    after[end - length] = np.logaddexp(after[end - length], after[end] + logs[ids])
                for (end, length), ids in arcs.items():
                    known = (ids >= 0) & (ids < size)
                    share = np.exp(before[end - length] + logs[ids] + after[end] - before[n])
                    np.add.at(expected, ids[known], (share * weight[at])[known])
                continue
            before = _forward(arcs, n, probs, len(at))
            after = np.zeros_like(before)
            after[n] = 1
            for (end, length), ids in reversed(arcs.items()):
                after[end - length] += after[end] * probs[ids]
            scale = weight[at] / np.maximum(before[n], 1e-300)
            for (end, length), ids in arcs.items():
                known = (ids >= 0) & (ids < size)
                np.add.at(expected, ids[known], (before[end - length] * probs[ids] * after[end] * scale)[known])
    return probs


def training_counts(docs: DataFrame, path: str, *, id_col: str, text_col: str, lang_col: str, rows_per_language: int) -> tuple[dict[str, dict[str, int]], dict[str, int]]:
    """Counts of words by language, from a sample of about ``rows_per_language`` labelled rows of each; and all rows by language."""
    known = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rows = {lang: n for lang, n in known.groupBy("lang").count().collect()}
    if not rows:
        return {}, {}
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, rows_per_language / n))) for x, n in rows.items()))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(place < F.try_element_at(share, "lang")).select("lang", "text")

    def count(batches):
        vocabulary = Vocabulary(path)
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang].update(vocabulary.words_of(text))
            if sum(map(len, found.values())) > 200_000:
                yield from tables(found)
                found.clear()
        yield from tables(found)

    def tables(found):
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    totals = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {x: {} for x in rows}
    for batch in totals.toArrow().to_batches():  # the words of the sample
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[lang][word] = n
    return counts, rows


class Scorer:
    """Predicts languages of texts; keeps the scores of words seen, up to a bound."""

    def __init__(self, path: str, languages: list[str], probs: np.ndarray, prior: np.ndarray, kept: int = 250_000):
        self.vocabulary, self.languages, self.probs, self.prior, self.kept = Vocabulary(path), languages, probs, prior, kept
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1024, len(languages)))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.places]
        need = len(self.places) + len(new)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((need, len(self.languages)))])
        self.scores[len(self.places) : need] = word_scores(self.vocabulary, new, self.probs)
        self.places.update(zip(new, range(len(self.places), need), strict=True))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        names, scores = [], []
        for at in range(0, len(texts), 64):
            part = [self.vocabulary.words_of((t or b"").decode("utf-8", "replace")) for t in texts[at : at + 64]]
            every = set(chain.from_iterable(part))
            if not every <= self.places.keys():
                if len(self.places) + len(every) > self.kept:
                    self.places = {}
                self.learn(every)
            for words in part:
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                logs = self.prior + self.scores[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].sum(0)
                odds = np.exp(logs - logs.max())
                best = int(odds.argmax())
                names.append(self.languages[best])
                scores.append(float(odds[best] / odds.sum()))
        return names, scores


def language_id(docs: DataFrame, *, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 1_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of ``docs``.

    Learns from a sample of about ``rows_per_language`` rows of each language that ``lang_col`` names (not null), only
    from rows that are not held out. Every whole text is scored, and every word whole, however long. A text that is null or has no letter is ``und`` with score 0, and so is all if nothing can be learned.
    ``score`` is the posterior probability of the prediction; equal ones go to the name that sorts first. Rows with a
    null or repeated id are scored like any other, and a null id is not held out; other columns are left out.
    An empty table gives an empty result.
    """
    path = tokenizer_file(vocabulary)
    counts, rows = training_counts(docs, path, id_col=id_col, text_col=text_col, lang_col=lang_col, rows_per_language=rows_per_language)
    languages = sorted(x for x in counts if counts[x])
    model = None
    if languages:
        prior = np.array([rows[x] for x in languages], float)
        model = (fit(Vocabulary(path), counts, languages), np.log(prior / prior.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = uuid.uuid4().hex  # workers outlive queries

    def predict(ids: list, texts: list) -> list:
        if mark not in _workers:
            _workers.clear()
            _workers[mark] = Scorer(path, languages, *(shared.value or (np.zeros((1, 0)), np.zeros(0))))
        return [ids, *_workers[mark].predict(texts)]

    texts = texts_of(docs, id_col, text_col)
    scored = over_texts(texts, predict, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
