"""Token counts and piece encodings against the libraries."""

import re

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from viewloom.llm.common import tokenizer_file
from viewloom.llm.piece_encoding import Codec, piece_decoding, piece_encoding
from viewloom.llm.token_counts import token_counts

ODD = [None, "", " ", "\n\n\n a", "a<|endoftext|>b<|endoftext|>", "don't 'S 123 ４５ é́ 日本語 \U0001f600​", "▁ a ▁▁b", "\x00\t x", "  two  spaces  ", "x" * 5000, "word " * 30_000, "ﬁ ½ İ", " lead"]


def test_token_counts(docs_of, maker):
    rows = list(enumerate(ODD + [maker.text(200) for _ in range(10)])) + [(2, "again"), (None, "no id")]
    library = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    got = token_counts(docs_of(rows), frequent=50, kept=300).collect()
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(doc_id=i, n_bytes=len((t or "").encode()), n_tokens=size(t), over_limit=size(t) > 512)) for i, t in rows)
    assert token_counts(docs_of([])).count() == 0


def test_other_vocabularies_are_refused(docs_of):
    with pytest.raises(ValueError):
        token_counts(docs_of([(1, "a")]), tokenizer="word_bpe_49k.json")


def test_pieces_without_dropout_equal_the_model(maker):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_file("piece_bpe_32k.model")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path, 0.0, 0)
    for text in [t for t in ODD if t and "▁" not in t] + [maker.text(100) for _ in range(5)]:
        assert codec.encode(text).tolist() == model.encode(text)


def test_pieces_with_dropout(docs_of, maker):
    path = tokenizer_file("piece_bpe_32k.model")
    for seed in (1, 2):
        codec = Codec(path, 0.3, seed, kept=50)
        for text in [t for t in ODD if t] + [maker.text(100) for _ in range(5)]:
            assert codec.decode(codec.encode(text, 1)).decode() == text
    one, two = Codec(path, 0.3, 1), Codec(path, 0.3, 2)
    text = maker.text(200)
    assert one.encode(text).tolist() != two.encode(text).tolist() != Codec(path, 0.0, 0).encode(text).tolist()
    assert one.encode(text, 1).tolist() != one.encode(text, 2).tolist() and one.encode(text).tolist() == Codec(path, 0.3, 1).encode(text).tolist()
    rows = list(enumerate(ODD)) + [(1, "again"), (None, "no id")]
    encoded = piece_encoding(docs_of(rows), dropout=0.2)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all(r.n_tokens == len(r.ids or []) for r in got)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in piece_decoding(encoded).collect()))) == sorted(map(repr, rows))
    assert piece_encoding(docs_of([])).count() == 0


def plain(codec, text, document):
    """Candidate by candidate over a plain list of symbols, each stretch on its own."""
    out = []
    key = np.array([xxhash.xxh64_intdigest(str(document), codec.seed)], np.uint64)
    for place, stretch in enumerate(re.findall(r"\n| +[^ \n]*|[^ \n]+", " " + text)):
        symbols, dropped = [("▁" if c == " " else c, c == "▁") for c in stretch], set()
        came, turn, left = 0, 0, None
        while True:
            if left is None:
                left = int(codec.passing(key, np.array([place]), turn)[0]) if codec.dropout else -1
            pairs = [(codec.scores[a + b], i) for i, ((a, x), (b, y)) in enumerate(zip(symbols, symbols[1:], strict=False)) if not x and not y and a + b in codec.scores and i not in dropped]
            if not pairs:
                break
            _, i = min(pairs)
            if left == 0:
                dropped.add(i)
                turn, left = turn + 1, None
                continue
            left -= 1
            came += 1
            symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], False)]
            dropped = {k if k < i else k - 1 for k in dropped if k not in (i - 1, i, i + 1)}
        for s, literal in symbols:
            out += [codec.ids[s]] if s in codec.ids and not literal else [codec.byte_ids[b] for b in s.encode()]
    return out


def test_dropout_equals_a_plain_agenda(maker):
    path = tokenizer_file("piece_bpe_32k.model")
    rng = maker.rng
    texts = [t for t in ODD if t and len(t) < 2000] + [maker.text(60) for _ in range(4)] + ["".join(rng.choices("abcde éя▁日 \n.,", k=300)) for _ in range(4)] + ["".join(rng.choices("aeinrst", k=n)) for n in (255, 256, 257, 300, 700)]
    for dropout in (0.0, 0.1, 0.5, 0.9):
        codec = Codec(path, dropout, 3, kept=100)
        want = [plain(codec, t, k) for k, t in enumerate(texts)]
        assert [codec.encode(t, k).tolist() for k, t in enumerate(texts)] == want
        found, counts = Codec(path, dropout, 3).encode_all(texts, list(range(len(texts))))
        assert np.split(found, np.cumsum(counts)[:-1])[-1].tolist() == want[-1] and found.tolist() == [x for w in want for x in w]


def test_every_occurrence_has_draws_of_its_own(maker):
    codec = Codec(tokenizer_file("piece_bpe_32k.model"), 0.1, 7)
    rng = maker.rng

    def drawn(text):  # candidate by candidate
        symbols, skipped = list(text.replace(" ", "▁")), set()
        while True:
            found = [(codec.scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in codec.scores and i not in skipped]
            if not found:
                return tuple(symbols)
            _, i = min(found)
            if rng.random() < 0.1:
                skipped.add(i)
            else:
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                skipped = {k if k < i else k - 1 for k in skipped if k not in (i - 1, i, i + 1)}

    n = 8000
    for word in ("of", "the", "house", "(end),"):
        shortest = len(Codec(tokenizer_file("piece_bpe_32k.model"), 0.0, 0).encode(word))
        each = [tuple(codec.raw[x].as_py().decode() for x in codec.encode(word, k).tolist()) for k in range(n)]
        want = [tuple(s.replace("▁", " ") for s in drawn(" " + word)) for _ in range(n)]
        assert abs(sum(len(x) == shortest for x in each) / n - sum(len(x) == shortest for x in want) / n) < 0.03
        for cut in {*each, *want}:
            assert abs(each.count(cut) - want.count(cut)) < 6 * (each.count(cut) + want.count(cut) + 1) ** 0.5, (word, cut)
        inside = codec.encode(" ".join([word] * n)).tolist()  # and within one document
        assert abs(len(inside) / sum(map(len, want)) - 1) < 0.03
