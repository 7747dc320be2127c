"""Token counts of whole texts with a byte-level BPE vocabulary.

Two tiers, both on the map side, so that no pre-token is ever shuffled:

1. a compact hash table ``pre-token -> number of tokens`` of the pre-tokens of the most frequent words, found by bounded
   sketches over all texts, made on the driver and broadcast (``frequent`` words at most);
2. a cache in each Python worker, which outlives tasks and has a bound; its misses are encoded in batches by the
   tokenizer's own library.

Which words are frequent is an estimate that only saves time: lengths always come from the library, so the counts do
not depend on it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import over_texts, texts_of, tokenizer_file

#: The pre-tokens of the byte-level vocabulary (fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens longer than this many characters are encoded, but not kept.
LONGEST_KEPT = 64

#: Groups of tasks whose sketches are merged.
GROUPS = 64

_workers: dict = {}


def special_strings(path: str) -> list[str]:
    """Special strings that the library recognises inside texts, each one token. Raises for a file whose pre-tokens are not those of PRE_TOKEN."""
    with open(path) as file:
        found = json.load(file)
    split = found.get("pre_tokenizer") or {}
    added = found.get("added_tokens") or []
    if found.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is no byte-level vocabulary with the usual pre-tokens")
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has special strings that depend on what stands around them")
    return sorted((t["content"] for t in added), key=len, reverse=True)


class Lengths:
    """Lengths in tokens of pre-tokens: the broadcast table, then a bounded cache, then the library."""

    def __init__(self, path: str, table: dict[str, int], kept: int):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.split = regex.compile(PRE_TOKEN).findall
        special = special_strings(path)
        self.parts = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.table, self.kept = table, kept
        self.cache = dict(table)

    def learn(self, words: set[str]) -> dict[str, int]:
        """Lengths of ``words``, which neither tier has."""
        lengths = {}
        for part in batched(words, 4096):
            lengths.update(zip(part, (len(e.ids) for e in self.encode(list(part), add_special_tokens=False)), strict=True))
        if len(self.cache) + len(lengths) > self.kept:
            self.cache = dict(self.table)
        self.cache.update((w, n) for w, n in lengths.items() if len(w) <= LONGEST_KEPT)
        return lengths

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total = 0
        for at, part in enumerate(self.parts(text)):
            words = self.split(part)
            lengths = list(map(self.cache.get, words))
            if None in lengths:
                missing = {w for w, n in zip(words, lengths, strict=True) if n is None}
                learnt = self.learn(missing)
                total += sum(learnt[w] for w, n in zip(words, lengths, strict=True) if n is None)
                total += sum(n for n in lengths if n is not None)
            else:
                total += sum(lengths)
            total += at > 0
        return total


def frequent_lengths(docs: DataFrame, path: str, frequent: int, tracked: int) -> dict[str, int]:
    """The first tier: lengths of the pre-tokens of about the ``frequent`` most common words of all texts.

    Words are counted by sketches of bounded size, one for each task and then one for each of GROUPS groups of tasks, whose
    most common words are added up here; only sketches are exchanged.
    """
    import regex

    words = docs.select(F.explode(F.split("text", "[ \n]")).alias("word")).where((F.col("word") != "") & (F.length("word") <= LONGEST_KEPT))
    parts = words.groupBy(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part")).agg(F.expr(f"approx_top_k(word, {frequent}, {tracked})").alias("top"))
    counts: Counter = Counter()
    for (top,) in parts.select("top").toLocalIterator():  # GROUPS times ``frequent`` words at most
        counts.update({r["item"]: r["count"] for r in top})
    split = regex.compile(PRE_TOKEN).findall
    found = list({p for word, _ in counts.most_common(frequent) for w in (word, " " + word) for p in split(w)})
    return {w: len(e.ids) for w, e in zip(found, Lengths(path, {}, 0).encode(found, add_special_tokens=False), strict=True)}


def token_counts(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 512, frequent: int = 5_000, tracked: int = 20_000, kept: int = 400_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``.

    ``tokenizer`` is a byte-level vocabulary; a file with other pre-tokens raises. A null text counts as empty: no bytes, no tokens, not over the limit. Rows with a null or repeated id are counted
    like any other; other columns are left out. An empty table gives an empty result. Texts of any length are counted
    whole.
    """
    path = tokenizer_file(tokenizer)
    texts = texts_of(docs, id_col, text_col)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(texts, path, frequent, tracked))
    mark = uuid.uuid4().hex  # workers outlive queries

    def count(ids: list, texts: list) -> list:
        key = (path, kept, mark)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(path, table.value, kept)
        lengths = _workers[key]
        sizes = [len(t or b"") for t in texts]
        tokens = [lengths.count((t or b"").decode("utf-8", "replace")) for t in texts]
        return [ids, sizes, tokens, [n > limit for n in tokens]]

    return over_texts(texts, count, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
