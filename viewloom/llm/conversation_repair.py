"""Repair of the structure of conversations by cheapest edits.

Each row of a conversation has a fault (blank, duplicate, truncated) or none. Edits keep a row, give it another role,
delete it, or insert an empty one, so that the roles read: perhaps a system row, then user and assistant in turn; or
nothing at all. Of the cheapest edit scripts the least in ASCII is taken.

1. Rows get their places by a distributed ranking, and their faults by aggregation. A row's symbol says all that the
   search needs of it: its role, and whether it must go or is truncated.
2. Symbols of up to ``CHUNK`` rows make a signature. Signatures are dealt by range and sorted, so that a walk over them is
   a walk over their prefix trie in depth-first order: the stack holds one layer of the search for each symbol of the
   prefix that a signature shares with the one before, and only the rest is computed. Equal signatures share a terminal
   node, wherever their conversations come from.
3. A layer holds, for each state at the chunk's start and each state now, the least cost, the order of the least scripts,
   and where they come from. Longer conversations compose their chunks, so no task searches an unbounded one.
4. A last pass streams each conversation's rows in order through its script, and hashes what the repair gives.

Scripts of one start that have consumed the same rows are never proper prefixes of each other, since what follows the
last row is not looked at; so their order stays whatever comes behind, and ranks are all that a layer needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewloom.llm.common import SPACE, ranked, stored

#: Rows of a signature.
CHUNK = 4096
#: What edits cost (fixed values of the contract).
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States between rows: nothing yet, after a system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
INITIALS = "?sua"

#: What inserting does to a state.
_INSERTED = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _after_inserts(state: int, n: int) -> int:
    for _ in range(n):
        state = _INSERTED[state]
    return state


def _moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row's symbol: up to two inserts, then what is done with the row.

    A third insert leads where one does. Symbols: ``x`` must go; else the role's initial, ``o`` for another role, in upper
    case if the row is truncated.
    """
    found = []
    for start, n in product(range(4), range(3)):
        at, price = _after_inserts(start, n), INSERT * n
        found.append((start, at, price + DELETE, "I" * n + "D"))
        if symbol == "x":
            continue
        extra = TRUNCATED * symbol.isupper()
        role = symbol.lower()
        due = _INSERTED[at]
        if role == "s" and at == NOTHING:
            found.append((start, SYSTEM, price + extra, "I" * n + "K"))
        if role == INITIALS[due]:
            found.append((start, due, price + extra, "I" * n + "K"))
        else:
            found.append((start, due, price + extra + REROLE, "I" * n + "R"))
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, to, price, edits in found:
        best[start, to] = min(best.get((start, to), (price, edits)), (price, edits))
    return [(a, b, price, edits) for (a, b), (price, edits) in sorted(best.items())]


MOVES = {s: _moves(s) for s in "xsuaoSUAO"}
#: For each symbol and target state, the moves that lead there.
INTO = {s: [[m for m in moves if m[1] == to] for to in range(4)] for s, moves in MOVES.items()}
#: The cheapest way from a state to an end: cost, edits.
CLOSING = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

#: A layer for one start: for each state (cost, rank of the script, state before, edits), or None.
Layer = list[tuple[int, int, int, str] | None]


def first_layer(start: int) -> Layer:
    return [(0, 0, -1, "") if s == start else None for s in range(4)]


def next_layer(layer: Layer, symbol: str) -> Layer:
    """The layer after one row more."""
    chosen: list[tuple[int, int, str, int] | None] = []
    for into in INTO[symbol]:
        best = None
        for before, _, price, edits in into:
            if (held := layer[before]) is not None:
                new = (held[0] + price, held[1], edits, before)
                if best is None or new < best:
                    best = new
        chosen.append(best)
    order = {key: k for k, key in enumerate(sorted({(c[1], c[2]) for c in chosen if c}))}
    return [(c[0], order[c[1], c[2]], c[3], c[2]) if c else None for c in chosen]


def script(stack: list[Layer], end: int) -> str:
    """The edits that lead through a stack of layers to a state."""
    out = []
    for layer in reversed(stack[1:]):
        _, _, before, edits = layer[end]
        out.append(edits)
        end = before
    return "".join(reversed(out))


def closed(layer: Layer) -> tuple[int, int]:
    """(cost, state) of the best end of a search: ties by script, closing inserts included."""
    found = [(layer[s][0] + CLOSING[s][0], layer[s][1], CLOSING[s][1], s) for s in range(4) if layer[s]]
    best = min(found)
    return best[0], best[3]


class Trie:
    """The layers of the signature met last, for each start asked for; signatures come in order."""

    def __init__(self, starts: tuple[int, ...]):
        self.starts, self.signature = starts, ""
        self.stacks: dict[int, list[Layer]] = {s: [first_layer(s)] for s in starts}
        self.computed = 0

    def move_to(self, signature: str) -> None:
        """Pops what the signature does not share with the one before, and computes the rest."""
        shared, most = 0, min(len(signature), len(self.signature))
        while shared < most and signature[shared] == self.signature[shared]:
            shared += 1
        for stack in self.stacks.values():
            del stack[shared + 1 :]
            for symbol in signature[shared:]:
                stack.append(next_layer(stack[-1], symbol))
        self.computed += len(signature) - shared
        self.signature = signature


def repaired(signature: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation's signature."""
    trie = Trie((NOTHING,))
    trie.move_to(signature)
    cost, end = closed(trie.stacks[NOTHING][-1])
    return cost, script(trie.stacks[NOTHING], end) + CLOSING[end][1]


_ANSWER = "g string, chunk long, cost long, audit string, costs array<int>, ranks array<int>, audits array<string>"


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminal nodes of sorted signatures (g, chunk, n_chunks, signature): of a whole conversation its cost and script; of a chunk those from each state to each."""
    tries = {True: Trie((NOTHING,)), False: Trie((NOTHING, SYSTEM, USER, ASSISTANT))}
    held: dict[bool, tuple] = {}
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("g", "chunk", "cost", "audit", "costs", "ranks", "audits")}
        for g, chunk, n, signature in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = n == 1
            trie = tries[whole]
            if whole not in held or held[whole][0] != signature:
                trie.move_to(signature)
                if whole:
                    stack = trie.stacks[NOTHING]
                    cost, end = closed(stack[-1])
                    held[whole] = (signature, cost, script(stack, end) + CLOSING[end][1], None, None, None)
                else:
                    cells = [trie.stacks[s][-1][e] for s in range(4) for e in range(4)]
                    audits = [script(trie.stacks[s], e) if trie.stacks[s][-1][e] else None for s in range(4) for e in range(4)]
                    held[whole] = (signature, None, None, [c[0] if c else None for c in cells], [c[1] if c else None for c in cells], audits)
            out["g"].append(g)
            out["chunk"].append(chunk)
            for name, value in zip(("cost", "audit", "costs", "ranks", "audits"), held[whole][1:], strict=True):
                out[name].append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def composed(costs: list[list], ranks: list[list]) -> tuple[int, list[tuple[int, int]], int]:
    """(cost, start and end of each chunk, last state) of the best way through chunks in order."""
    layer: Layer = first_layer(NOTHING)
    stack = [layer]
    for cost, rank in zip(costs, ranks, strict=True):
        chosen = []
        for e in range(4):
            ways = [(layer[m][0] + cost[4 * m + e], layer[m][1], rank[4 * m + e], m) for m in range(4) if layer[m] and cost[4 * m + e] is not None]
            chosen.append(min(ways) if ways else None)
        order = {key: k for k, key in enumerate(sorted({c[1:3] for c in chosen if c}))}
        layer = [(c[0], order[c[1:3]], c[3], "") if c else None for c in chosen]
        stack.append(layer)
    total, last = closed(layer)
    ways, at = [], last
    for own in reversed(stack[1:]):
        ways.append((own[at][2], at))
        at = own[at][2]
    return total, ways[::-1], last


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    """The chosen scripts of a long conversation's chunks."""
    table = table.sort_by("chunk")
    total, ways, last = composed(table.column("costs").to_pylist(), table.column("ranks").to_pylist())
    n = table.num_rows
    audits = [table.column("audits")[k].as_py()[4 * s + e] for k, (s, e) in enumerate(ways)]
    audits[-1] += CLOSING[last][1]
    return pa.table({"g": table.column("g"), "chunk": table.column("chunk"), "cost": pa.array([total] + [None] * (n - 1), pa.int64()), "audit": audits})


_HELD = "g string, place long, part long, turn long, role string, text string, fault int, cost long"
_REPAIR = "g string, audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long, repaired_sha256 string"


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from its scripts (place null, in parts) followed by its rows in order; only the script is held."""
    now: dict = {}

    def begun(g: str) -> dict:
        return {"g": g, "audit": [], "cost": 0, "script": None, "at": 0, "hash": sha256(), "first": True, "state": NOTHING, "faults": [0, 0, 0, 0], "illegal": 0, "before": None, "turns": 0, "low": None, "high": None}

    def emit(role: str, text: str) -> None:
        now["hash"].update((("" if now["first"] else "\n") + role + ":" + text).encode())
        now["first"] = False

    def inserts() -> None:
        while now["at"] < len(now["script"]) and now["script"][now["at"]] == "I":
            now["state"] = _INSERTED[now["state"]]
            emit("user" if now["state"] == USER else "assistant", "")
            now["at"] += 1

    def row(turn, role: str, text: str, fault: int) -> None:
        inserts()
        edit = now["script"][now["at"]]
        now["at"] += 1
        if edit != "D":
            now["state"] = SYSTEM if edit == "K" and role[:1] == "s" else _INSERTED[now["state"]]
            emit(role if edit == "K" else "user" if now["state"] == USER else "assistant", text)
        now["faults"][fault] += 1
        if now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au"):
            now["illegal"] += 1
        now["before"] = role[:1]
        if turn is not None:
            now["turns"] += turn != now["high"]
            now["low"] = turn if now["low"] is None else now["low"]
            now["high"] = turn

    def ended() -> list:
        now["script"] = "".join(now["audit"]) if now["script"] is None else now["script"]
        inserts()
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        return [now["g"], now["script"], now["cost"], gaps, *now["faults"][1:], now["illegal"], now["hash"].hexdigest()]

    def table(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _REPAIR.split(", ")])

    for batch in batches:
        done = []
        for g, place, part, turn, role, text, fault, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not now or now["g"] != g:
                if now:
                    done.append(ended())
                now.clear()
                now.update(begun(g))
            if place is None:
                now["audit"].append(text)
                now["cost"] += cost or 0
            else:
                if now["script"] is None:
                    now["script"] = "".join(now["audit"])
                row(turn, role, text, fault)
        if done:
            yield table(done)
    if now:
        yield table([ended()])


def conversation_key(value: Column) -> Column:
    """A conversation's name: a null id is one space."""
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by the CRC-32 of ``conv_id:turn``: gone, empty, without full stops, repeated, or of role user."""
    draw = F.crc32(F.concat(conversation_key(F.col("conv_id")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    held = rows.withColumn("__draw", draw).where("__draw <> 0")
    text = F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    held = held.withColumns({"text": text, "role": F.when(F.col("__draw") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("__draw") == 3, F.sequence(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.lit(0)))
    return held.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def repairs(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", planted: bool = False) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation of ``rows``.

    With ``planted`` the rows are damaged first (``damaged``); a conversation that loses all its rows has zeros, an empty
    audit and the hash of nothing. Rows with a null id are one conversation (with those of an id of one space). Null turns
    come first; rows of one turn stand by a digest of role and text, so repeated rows are neighbours, and all but the
    first are duplicates. A null role or text is one space: such a text is blank, and such a role, like any whose initial is not
    s, u or a, can only be changed or deleted. An empty table gives an empty result; other columns are left out. Texts may
    be of any length. Each conversation is hashed as one stream, as SHA-256 asks; nothing else of it stands in one task.
    """
    own = rows.select(rows[conv_col].alias("conv_id"), rows[turn_col].cast("long").alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit(" ")).alias("role"), F.coalesce(rows[text_col].cast("string"), F.lit(" ")).alias("text"))
    everyone = own.select("conv_id", conversation_key(F.col("conv_id")).alias("g")).groupBy("g").agg(F.max("conv_id").alias("conv_id"))
    held = (damaged(own) if planted else own).select(conversation_key(F.col("conv_id")).alias("g"), "turn", "role", "text", F.sha2(F.concat("role", F.lit(":"), "text"), 256).alias("same"))
    placed = stored(ranked(held, "g", ["turn", "same"], "turns"), "placed")
    firsts = placed.groupBy("g", "same").agg(F.min("place").alias("first"))
    last = F.rtrim("text", F.lit(SPACE))
    blank = F.length(last) == 0
    fault = F.when(blank, 1).when(F.col("place") > F.col("first"), 2).when(~F.substring(last, -1, 1).isin(*".!?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin(1, 2), "x").when(F.col("fault") == 3, F.upper(letter)).otherwise(letter)
    marked = stored(placed.join(firsts, ["g", "same"]).select("g", "place", "turn", "role", "text", fault.alias("fault")), "marked")
    chunks = marked.select("g", F.floor(F.col("place") / CHUNK).alias("chunk"), F.struct("place", symbol.alias("symbol")).alias("at")).groupBy("g", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["symbol"]), "").alias("signature"))
    chunks = chunks.join(marked.groupBy("g").agg((F.floor(F.max("place") / CHUNK) + 1).alias("n_chunks")), "g").select("g", "chunk", "n_chunks", "signature")
    chunks = stored(chunks, "signatures")
    found = stored(chunks.repartitionByRange("signature", "g", "chunk").sortWithinPartitions("signature", "g", "chunk").mapInArrow(answers, _ANSWER), "answers")
    long = found.where("costs is not null").groupBy("g").applyInArrow(_joined, "g string, chunk long, cost long, audit string")
    scripts = found.where("costs is null").select("g", "chunk", "cost", "audit").unionAll(long)
    none = F.lit(None)
    stream = scripts.select("g", none.cast("long").alias("place"), F.col("chunk").alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("int").alias("fault"), "cost")
    stream = stream.unionAll(marked.select("g", "place", none.cast("long"), "turn", "role", "text", "fault", none.cast("long")))
    done = stream.repartition("g").sortWithinPartitions("g", "place", "part").mapInArrow(applied, _REPAIR)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return everyone.join(done, "g", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
