"""MinHash components against all pairs, and SuperMinHash against its definition."""

import numpy as np

from viewloom.llm import buckets as B
from viewloom.llm import minhash_dedup as M
from viewloom.llm.shingles import shingle_set


def plain(rows):
    """(doc_id, n_shingles, component_id, kept) by all pairs."""

    def own(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()

    sets = [own(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 80 * len(a | sets[j]):
                links += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return links, sorted(((i, len(sets[k]), c := least.get(find(k)), i == c) for k, (i, _) in enumerate(rows)), key=repr)


def test_against_all_pairs(docs_of, maker):
    def changed(text, share):
        return " ".join(w if maker.rng.random() > share else "changed" for w in text.split(" "))

    line = maker.text(30)
    texts = [maker.text(maker.rng.randint(1, 80)) + "\n" + line for _ in range(40)]
    bases = [maker.text(n) for n in (12, 40, 150, 600)]
    texts += [changed(b, share) for b in bases for share in (0.01, 0.02, 0.025, 0.03, 0.04, 0.06) for _ in range(5)]
    texts += [*bases, bases[2].upper(), "", " \n", "One two", "ONE\ttwo", "one three", "É b", "é b", maker.text(20_000)]
    texts += [" ".join(f"w{k}" for k in range(start, start + 43)) for start in range(0, 40, 4)]  # each like the next only: 36 of 44
    rows = list(enumerate(texts)) + [(900, None), (None, bases[1]), (3, texts[3]), (None, "nothing like it at all"), (None, None)]
    links, want = plain(rows)
    assert links > 80
    assert sorted(map(tuple, M.minhash_components(docs_of(rows)).collect()), key=repr) == want
    assert M.minhash_components(docs_of([])).count() == 0


def test_a_signature_is_the_least_throw_of_each_slot():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 3, 40, 300)]
    for own, got in zip(sets, M.signatures(sets), strict=True):
        best = np.full(M.SLOTS, np.uint64(2**64 - 1))
        for x in own:
            order = list(range(M.SLOTS))
            for level in range(M.SLOTS):
                value, place = M._throws(np.array([x], np.uint64), level)
                order[level], order[place[0]] = order[place[0]], order[level]
                best[order[level]] = min(best[order[level]], value[0])
        assert (best == got).all()
    many = [np.unique(rng.integers(0, 1 << 63, 70_000, dtype=np.uint64)), *sets]
    assert (M.signatures(many)[1:] == M.signatures(sets)).all()


def test_signatures_tell_the_similarity():
    rng = np.random.default_rng(2)
    for n, most in ((20, 0.03), (200, 0.031), (2000, 0.04)):  # independent hashes: 0.035
        sets, same = [], n * 8 // 10
        for _ in range(300):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            sets += [both[: same + (n - same) // 2], np.concatenate((both[:same], both[same + (n - same) // 2 :]))]
        found = M.signatures(sets)
        gaps = (found[0::2] == found[1::2]).mean(axis=1) - same / n
        assert abs(gaps.mean()) < 0.006 and gaps.std() < most


def test_links_that_proposals_miss_are_found(docs_of, maker, monkeypatch):
    """Chains of texts that are like the next only, in cells of a few rows, without any proposal."""
    monkeypatch.setattr(B, "LAGS", 0)
    monkeypatch.setattr(B, "CELL", 3)
    monkeypatch.setattr(B, "SET_CELL", 2)
    rows = [(100 * chain + at, " ".join(f"c{chain}w{k}" for k in range(at, at + 43))) for chain in range(3) for at in range(0, 60, 4)] + [(1000 + k, maker.text(40)) for k in range(20)]
    links, want = plain(rows)
    assert links == 42
    assert sorted(map(tuple, M.minhash_components(docs_of(rows)).collect()), key=repr) == want


def test_buckets_of_one_are_left_out(spark):
    rows = spark.createDataFrame([(k, n) for k in range(200) for n in range(1 + k % 2)], "key long, node long")
    got = [r.key for r in B.shared_keys(rows).collect()]
    assert {k for k in range(200) if k % 2} <= set(got) and len(got) < 230 and got.count(7) == 2


def test_sets_of_words():
    assert len(shingle_set(b"a b c", 4)) == 1 and len(shingle_set(b"a a a a a a", 4)) == 1 and len(shingle_set(None, 4)) == 0
