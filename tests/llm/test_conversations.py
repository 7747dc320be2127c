"""Conversation repair against a search over all scripts."""

import heapq
import random
import zlib
from hashlib import sha256

from viewloom.llm import conversation_repair as C

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit) by best-first search over (cost, script): rows are (initial, must go, truncated)."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, i, shape = heapq.heappop(heap)
        if (i, shape[-1:], edits) in seen or len(edits) > 2 * len(rows) + 4:
            continue
        seen.add((i, shape[-1:], edits))
        body = shape.removeprefix("s")
        if i == len(rows) and (not shape or (body and body == "ua" * (len(body) // 2))):
            return cost, edits
        due = "u" if shape[-1:] != "u" else "a"
        heapq.heappush(heap, (cost + 2, edits + "I", i, shape + due))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, shape))
            if not gone:
                if initial == due or (initial == "s" and not shape):
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, shape + initial))
                if initial != due:
                    heapq.heappush(heap, (cost + 2 + cut, edits + "R", i + 1, shape + due))


def plain(table, planted):
    ids, by = [], {}
    for conv, turn, role, text in table:
        if conv not in by:
            ids.append(conv)
            by[conv] = []
        role, text = role if role is not None else " ", text if text is not None else " "
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if planted else 9
        text = "" if draw == 1 else text.translate(str.maketrans("", "", ".!?")) if draw == 2 else text
        row = (turn, "user" if draw == 4 else role, text)
        by[conv] += [] if draw == 0 else [row, row] if draw == 3 else [row]
    out = []
    for conv in ids:
        rows = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in rows:
            last = text.rstrip(WHITE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)])
        done, i = [], 0
        for edit in audit:
            due = "assistant" if done and done[-1][0][:1] == "u" else "user"
            if edit == "I":
                done.append((due, ""))
                continue
            _, role, text = rows[i]
            i += 1
            if edit != "D":
                done.append((role if edit == "K" else due, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, g string, place int")


def some(rng, convs, longest=6):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "well", " \t", "", None, "Why?\n", "ok. then"])))
    return rows


def test_against_all_scripts(spark, monkeypatch):
    rng = random.Random(3)
    rows = some(rng, 60) + [(None, 0, "user", "Hm."), (None, 1, "assistant", "Yes."), (99, 0, "user", "One."), (99, 0, "user", "One.")]
    for planted in (False, True):
        want = plain(rows, planted)
        for chunk in (4096, 2):
            monkeypatch.setattr(C, "CHUNK", chunk)
            got = sorted(map(tuple, C.repairs(table_of(spark, rows), planted=planted).collect()), key=repr)
            assert got == want
    assert C.repairs(table_of(spark, [])).count() == 0


def test_scripts_are_the_cheapest_and_least():
    rng = random.Random(4)
    for _ in range(400):
        symbols = "".join(rng.choices("xsuaoSUAO", k=rng.randint(0, 7)))
        assert C.repaired(symbols) == cheapest([("?" if c.lower() == "o" else c.lower(), c == "x", c.isupper()) for c in symbols])


def test_prefixes_are_searched_once(spark):
    trie = C.Trie((C.NOTHING,))
    for signature in sorted(["ua" * 50, "ua" * 50 + "s", "ua" * 50 + "ua", "ua" * 49 + "uu"]):
        trie.move_to(signature)
        assert C.script(trie.stacks[C.NOTHING], C.closed(trie.stacks[C.NOTHING][-1])[1]) in C.repaired(signature)[1]
    assert trie.computed < 110


def test_a_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 50)
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('. ?')}") for t in range(2000)]
    got = C.repairs(table_of(spark, rows)).first()
    symbols = "".join(r[2][0] if r[3][-1] != " " else r[2][0].upper() for r in rows)
    assert (got.cost, got.audit) == C.repaired(symbols)
