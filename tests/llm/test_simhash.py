"""SimHash near-duplicates against all pairs."""

import re

import numpy as np
import xxhash

from viewloom.llm import simhash_dedup as M
from viewloom.llm.graph import components


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


def test_against_all_pairs(docs_of, maker):
    base = maker.text(300)
    near = [" ".join(w if maker.rng.random() > 0.004 else "changed" for w in base.split(" ")) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate([maker.text(maker.rng.randint(1, 60)) for _ in range(60)] + [base] * 5 + near + ["", None, " \t\n", "One two", "ONE  two", "ÀB one two three four", maker.text(20_000)])]
    rows += [(3, rows[3][1]), (None, base), (None, "nothing like it at all here")]
    got = M.simhash_components(docs_of(rows)).collect()
    assert len(got) == len(rows)
    fp = {(i, t): brute_fp(t) for i, t in rows}
    groups = brute_classes(set(fp.values()))
    least = {f: min((i for (i, t), x in fp.items() if x in g and i is not None), default=None) for g in groups for f in g}
    want = sorted((repr(i), f"{fp[i, t]:016x}", repr(least[fp[i, t]])) for i, t in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    assert M.simhash_components(docs_of([])).count() == 0
    assert sorted(r.doc_id for r in M.one_of_each(docs_of(rows[60:70])).collect()) == sorted({least[fp[r]] for r in rows[60:70]} | set())


def test_pigeonring_never_prunes_a_link():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 20_000, dtype=np.int64).view(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    assert M.chains_hold(a ^ b, 4).all()
    assert np.logical_or.reduce([M.linked(a, b, s, 4) for s in range(M.PARTS)]).all()


def test_large_buckets_link_alike(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 30, dtype=np.int64).view(np.uint64) & ~np.uint64(0x1FFF)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(13, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(13, 64, 40).astype(np.uint64)) for c in centres]))

    def classes(edges):
        parent = {int(f): int(f) for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for u, v in edges:
            parent[find(u)] = find(v)
        groups = {}
        for f in parent:
            groups.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in groups.values()}

    plain = M.forest(fps, 0, 4)
    assert len(plain) < len(fps)
    monkeypatch.setattr(M, "LARGE", 16)
    divided = M.forest(fps, 0, 4)
    want = brute_classes([int(f) for f in fps])
    near = lambda groups: {g for g in groups if len(g) > 1}
    # chains from segment 0 alone need not see every link; what they see must not depend on the division
    assert all(any(g <= w for w in want) for g in classes(plain))
    assert near(classes(plain)) == near(classes(divided)) and max(map(len, classes(divided))) > 16


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 200) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in [*range(101, 130), 200]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
