"""Near copies by similarity against all pairs."""

import corpus_pipeline
from viewloom.llm import near_copies as N
from viewloom.llm.simhash_dedup import fingerprint_batch


def similarity(a, b):
    a, b = (set(N.five_words(x.encode()).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_all_pairs(docs_of, maker, monkeypatch):
    def changed(text, share):
        return " ".join(w if maker.rng.random() > share else "changed" for w in text.split())

    line = maker.text(12)
    texts = [maker.text(maker.rng.randint(1, 120)) + "\n" + line for _ in range(60)]
    bases = [maker.text(n) for n in (30, 80, 300, 1000)]
    texts += [changed(b, share) for b in bases for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.05) for _ in range(3)]
    texts += [*bases, bases[2], bases[2].upper(), bases[2] + " " + maker.text(70), bases[2] + " " + maker.text(85), "", " \n", "One two", "ONE  two", "one three"]
    rows = list(enumerate(texts)) + [(500, None), (None, bases[1]), (3, texts[3]), (None, "nothing like it")]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(rows[i][1] or "", rows[j][1] or "") >= 0.8]
    for i, j in links:
        parent[find(i)] = find(j)
    fps = fingerprint_batch([(t or "").encode() for _, t in rows])
    assert sum((int(fps[i]) ^ int(fps[j])).bit_count() > 4 for i, j in links) > 20  # what the fingerprints of op9 do not link
    names = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    want = sorted(repr((i, names.get(find(k)))) for k, (i, _) in enumerate(rows))
    for frequent in (20, 10**9):
        monkeypatch.setattr(N, "FREQUENT", frequent)
        got = N.near_copy_components(docs_of(rows)).collect()
        assert sorted(repr(tuple(r)) for r in got) == want
    assert sorted(repr(r.doc_id) for r in corpus_pipeline.drop_near_copies(None, docs_of(rows), "").collect()) == sorted(repr(i) for k, (i, _) in enumerate(rows) if i is None or i == names[find(k)])
    assert N.near_copy_components(docs_of([])).count() == 0


def test_ring_filter_is_the_hamming_radius(maker):
    rng = N.np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, (20_000, 2), dtype=N.np.uint64)
    for _ in range(2):  # sparser and sparser
        x &= rng.integers(0, 1 << 63, x.shape, dtype=N.np.uint64)
        whole = N.np.bitwise_count(x).sum(axis=1)
        for radius in (12, 24, 48):
            assert (N.ring_holds(x, radius) == (whole <= radius)).all()
        assert 0 < (whole <= 24).sum()


def test_similar_sets_stay_within_the_radius(maker):
    rng = N.np.random.default_rng(6)
    for n in (4, 8, 40, 400):
        for _ in range(200):
            both = rng.integers(0, 1 << 63, 2 * n, dtype=N.np.uint64)
            a, b = both[: n + n // 4], both[:n]  # similarity of 0.8 at least
            x = N.np.array([N.wide_fingerprint(a)], N.np.uint64) ^ N.np.array([N.wide_fingerprint(b)], N.np.uint64)
            assert N.ring_holds(x, N.RADIUS)[0]
