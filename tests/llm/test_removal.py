"""Line and byte deduplication, and quality counts, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from viewloom.llm import suffix_dedup as S
from viewloom.llm.line_dedup import line_dedup
from viewloom.llm.quality import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(maker):
    passage = maker.text(60)
    rows = [(i, maker.text(maker.rng.randint(1, 150))) for i in range(12)]
    rows += [(12 + i, maker.text(20) + "\n" + passage + "\n" + maker.text(20)) for i in range(6)]
    rows += [(20, rows[3][1]), (21, rows[3][1].replace(" ", "\n")), (22, ""), (23, None), (24, " \n\t\n"), (25, "\n".join(["a b c d e f"] * 40)), (26, "x" * 400), (27, "ab" * 150 + "é" * 60)]
    rows += [(28, passage.replace("\n", "\n\n")), (29, "\n" + passage + "\n\nend"), (30, maker.text(5000))]
    return rows


def brute_lines(rows, least):
    seqs = {(i, t): [x for x in t.split("\n") if WORD.search(x)] for i, t in rows if i is not None and t is not None}
    first = {}
    for (i, t), s in sorted(seqs.items()):
        for a in range(len(s)):
            for b in range(a, min(len(s), a + least)):
                first.setdefault(tuple(s[a : b + 1]), (i, a))
    gone = defaultdict(set)
    for (i, t), s in seqs.items():
        for a in range(len(s)):
            for b in range(a, min(len(s), a + least)):
                if sum(len(WORD.findall(x)) for x in s[a : b + 1]) >= least and first[tuple(s[a : b + 1])] < (i, a):
                    gone[i, t].update(range(a, b + 1))
    return seqs, gone


@pytest.mark.parametrize("least", [1, 7, 25])
def test_lines(docs_of, maker, least):
    rows = documents(maker)[:-1] + [(3, documents(maker)[3][1]), (None, documents(maker)[3][1])]
    seqs, gone = brute_lines(rows, least)
    got = line_dedup(docs_of(rows), min_words=least)
    want = []
    for i, t in rows:
        own, k, left = gone.get((i, t), set()), -1, []
        for x in [] if t is None else t.split("\n"):
            k += bool(WORD.search(x))
            if not (WORD.search(x) and k in own):
                left.append(x)
        n = len([x for x in (t or "").split("\n") if WORD.search(x)])
        want.append((i, None if t is None else "\n".join(left), n, len(own)))
    assert sorted(map(repr, ((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()))) == sorted(map(repr, want))
    assert "lang" in got.columns and line_dedup(docs_of([])).count() == 0


def test_lines_of_a_very_long_text_and_clashing_names(spark, maker):
    lines = [f"{a} {k % 7000}" for k, a in enumerate(maker.words(20_000))]
    rows = [(1, "\n".join(lines), 1, "a"), (2, "\n".join(["own", *lines[:9_000], "end"]), 2, "b"), (3, "", 3, "c"), (4, None, 4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, gone string").selectExpr("*", "doc_id as n_lines", "'x' as `row`", "1 as `a.b`")
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert got[1].n_removed == 0 and got[1].n_lines == 20_000 and got[1].text == rows[0][1]
    assert got[2].text == "own\nend" and got[2].n_removed == 9_000 and got[2]["__id"] == 2 and got[2].gone == "b" and got[2]["a.b"] == 1
    assert got[3].text == "" and got[4].text is None and got[4].n_lines == 0


def brute_bytes(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if i is not None and t is not None}):
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - S.LENGTH + 1):
            if data[s : s + S.LENGTH] in seen:
                gone[s : s + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(data[s : s + S.LENGTH])
        left = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out[i, t] = (len(data), sum(gone), sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "stretch", "held"), [(20_000, 1 << 20, 400_000), (1, 700, 50)])
def test_bytes(docs_of, maker, monkeypatch, crowd, stretch, held):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "STRETCH", stretch)
    monkeypatch.setattr(S, "COMBINED", held)
    rows = documents(maker) + [(31, "\0" * 300), (32, "x" * 150 + "y"), (33, ("abc" * 40 + "Z") * 4), (3, documents(maker)[3][1]), (None, "x" * 300)]
    want = brute_bytes(rows)
    got = S.suffix_dedup(docs_of(rows)).drop("kept").collect()
    plain = lambda t: (len((t or "").encode()), 0, 0, hashlib.sha256((t or "").encode()).hexdigest())
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *want.get((i, t), plain(t)))) for i, t in rows)
    assert S.suffix_dedup(docs_of([])).count() == 0


def test_equal_polynomial_hashes_do_not_fool(docs_of):
    tail = "qoubxyvoqgerndydgkwenndkzmsprqinqbmxinfr"
    rows = [(1, "djpibwdlfalemspyslognnkiouwpfarabkybzvrjwdfixxrbuzlyvsonlowz" + tail), (2, "bfuijegabmkhmeeusmgkgnpthxuamkklfjesomijcidgrkvmxoeflojpbrpi" + tail)]
    assert [len(t) for _, t in rows] == [100, 100]
    assert all(r.n_removed == 0 for r in S.suffix_dedup(docs_of(rows)).collect())


def test_longest_previous_factors(maker):
    for k in range(40):
        text = "".join(maker.rng.choices("ab" if k % 2 else "abcd", k=maker.rng.randint(1, 80)))
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def common(i, j, text=text):
            return next((n for n in range(len(text)) if text[i + n : i + n + 1] != text[j + n : j + n + 1] or i + n >= len(text)), len(text))

        prefix = S.np.array([0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)])
        want = [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert S.longest_previous(S.np.array(order), prefix).tolist() == want


def test_quality(docs_of, maker):
    rows = [(i, t, "en") for i, t in documents(maker)] + [(1, None, None), (None, maker.text(30), None), (40, "%%% " * 80 + maker.text(80), "en"), (41, "a b c d e f g " * 3, "de")]
    got = quality(docs_of(rows)).collect()
    want = []
    for i, t, _ in rows:
        words, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))
    kept = {r.doc_id: r.kept for r in got}
    assert kept[30] and kept[12], kept
    assert not kept[40] and not kept[41] and all(not r.kept for r in got if r.base_failed)
    assert quality(docs_of([])).count() == 0
