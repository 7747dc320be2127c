"""The Merkle manifest against a plain tree."""

import zlib
from hashlib import sha256

import pytest

from viewloom.llm import merkle as M


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return levels


def around(levels, i):
    for level in levels[:-1]:
        first = i // 8 * 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climb([leaf(r) for r in by[g]])
    top = climb([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(by[g]):
            path = [*around(trees[g], i), *around(top, k)]
            at = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                at = h(a + at + b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), at, at == top[-1][0]))
    return sorted(out, key=repr)


def found(docs, block=4096):
    return sorted(map(tuple, M.manifest(docs, block=block).drop("tampered").collect()), key=repr)


@pytest.mark.parametrize("block", [8, 64])
def test_against_a_plain_tree(docs_of, maker, block):
    rows = [(i, maker.text(20).title(), ("en", "en", "en", "é", "", None)[i % 6], "s" if i % 5 else None, i * 7) for i in range(300)]
    rows += [(400, "Lone", "zz"), (401, None, "en"), (402, "", "en"), (None, "No id", "en"), (7, "Twice", "en"), (7, "Twice", "en"), (403, "Ünï " * 30_000, None)]
    filled = [(i, t, *(m + [None] * 3)[:3]) for i, t, *m in rows]
    want = plain([(i, source, lang, n, t) for i, t, lang, source, n in filled])
    got = found(docs_of(rows), block)
    assert got == want
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_small_tables(docs_of):
    assert found(docs_of([])) == []
    for n in (1, 8, 9):
        rows = [(i, "A b", "en", "s", 3) for i in range(n)]
        assert found(docs_of(rows)) == plain([(i, "s", "en", 3, "A b") for i in range(n)])


def test_an_aligned_block_climbs_all_its_levels():
    leaves = M.np.frombuffer("".join(h(str(i)) for i in range(9)).encode(), M.np.uint8).reshape(-1, 64)
    assert [len(x) for x in M.levels(leaves)] == [9, 2, 1]
    assert [len(x) for x in M.levels(leaves, 4)] == [9, 2, 1, 1, 1]
