"""Toxicity by weak supervision.

1. Voters: seed lexicons in four languages, patterns, and many small lexicons of words, of word beginnings, and of
   beginnings shared by several words of a text, that labelled rows suggest. Each says of a text whether it speaks for toxic.
2. A generative label model takes the votes as views of a hidden truth. Its parameters are, for each voter, how often it
   fires on toxic and on other texts (its accuracies), and how that changes with the vote of the voter that it is most
   correlated with, given the truth (a tree over all voters). Expectation and maximisation fits them on votes alone; given labels
   calibrate where it starts and how common toxic texts are, but they cast no vote.
3. A linear classifier learns the posterior labels from which features and patterns a text has; it scores all texts.
   Nothing but the text enters a score.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import dropped, held_out, over_texts, stored, texts_of

#: Seed lexicons in the four languages of the corpus.
SEEDS = {
    "insults": "idiot idiots moron morons imbecile stupid dumb loser losers clown clowns fool fools crétin imbécile connard abruti dummkopf trottel depp idiota imbécil estúpido tonto".split(),
    "contempt": "worthless pathetic disgusting useless despicable contemptible minable pitoyable dégoûtant méprisable wertlos erbärmlich widerlich inútil patético asqueroso despreciable".split(),
    "dehumanising": "scum trash vermin garbage filth parasite parasites ordure vermine racaille abschaum ungeziefer dreck basura escoria alimaña".split(),
    "threats": "kill murder die hang burn tuer crever töten umbringen verrecke matar morir".split(),
    "obscenity": "fuck fucking shit bastard asshole bitch crap merde salope putain scheiße arschloch hurensohn mierda puta cabrón".split(),
}
#: Patterns over the whole text.
PATTERNS = {
    "second person insult": re.compile(r"\b(?:you|you're|u|tu es|du bist|eres)(?: are| so| such)*(?: an?| une?| ein| una?)? (?:idiot|moron|loser|clown|fool|stupid|dumb|pathetic|worthless|disgusting|trash|scum)\w*", re.I),
    "shut up": re.compile(r"\b(?:shut up|get lost|go to hell|ta gueule|halt die klappe|cállate)\b", re.I),
    "shouting": re.compile(r"(?:\b[A-Z]{4,}\b[^\w\n]+){4}"),
    "exclamation": re.compile(r"!{4,}"),
}
WORDS = re.compile(r"[^\W\d_]+").findall
#: Ids of sampled rows that are sent to all executors; beyond, texts are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Lengths of word beginnings that serve as features.
BEGINNINGS = range(4, 11)
#: What a likelihood ratio test must say for a feature to count as speaking for toxic: about five standard deviations.
SURE = 24.0
#: How many times as common in toxic texts as in others such a feature must be.
CLEAR = 20

_workers: dict = {}


def beginnings(words: Iterable[str]) -> Counter:
    """How many of different words go on after each beginning."""
    return Counter([w[:n] for w in words for n in BEGINNINGS if len(w) > n])


def features(text: str) -> set[str]:
    """Words as they are, beginnings marked with a star, and with two those that several different words have."""
    words = set(WORDS(text.lower()))
    begun = beginnings(words)
    return words | {b + "*" for b in begun} | {b + "**" for b, n in begun.items() if n > 1}


@dataclass
class Model:
    """A linear classifier over features and pattern voters."""

    weights: dict[str, float] = field(default_factory=dict)
    pattern_weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def __post_init__(self):
        self.plain = {f: w for f, w in self.weights.items() if not f.endswith("*")}
        self.once = {f[:-1]: w for f, w in self.weights.items() if f.endswith("*") and not f.endswith("**")}
        self.twice = {f[:-2]: w for f, w in self.weights.items() if f.endswith("**")}
        self.least = min(BEGINNINGS)
        self.heads = {b[: self.least] for b in (*self.once, *self.twice)}

    def score(self, text: str) -> float:
        words = set(WORDS(text.lower()))
        total = self.bias + sum(self.plain[w] for w in self.plain.keys() & words)
        begun = beginnings([w for w in words if w[: self.least] in self.heads])
        total += sum(self.once[b] for b in self.once.keys() & begun.keys())
        total += sum(self.twice[b] for b in self.twice.keys() & begun.keys() if begun[b] > 1)
        total += sum(w for name, w in self.pattern_weights.items() if PATTERNS[name].search(text))
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


@dataclass
class LabelModel:
    """A tree-structured generative model of votes: ``fires[j, y, v]`` is the chance that voter j fires on texts of truth y when its parent voted v."""

    prior: float
    parent: np.ndarray
    fires: np.ndarray

    def log_likelihoods(self, votes: np.ndarray) -> np.ndarray:
        """(rows, 2) log probability of votes and truth."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        own = np.arange(votes.shape[1])
        out = np.log([1 - self.prior, self.prior])
        each = [np.where(votes > 0, p, 1 - p) for p in (self.fires[own, y, above] for y in (0, 1))]
        return np.stack([np.log(p).sum(axis=1) for p in each], axis=1) + out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        both = self.log_likelihoods(votes)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))


def correlated(votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree of most mutual information given the truth; -1 for the first."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    x = votes.astype(float)
    for w in (weight * posterior, weight * (1 - posterior)):
        n = w.sum() + 1e-9
        both = (x * w[:, None]).T @ x / n
        one = np.diag(both).copy()
        for a, pa in ((1, one), (0, 1 - one)):
            for b, pb in ((1, one), (0, 1 - one)):
                joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}[a, b]
                joint, apart = np.clip(joint, 1e-12, 1), np.clip(pa[:, None] * pb[None, :], 1e-12, 1)
                gain += n * joint * np.log(joint / apart)
    parent, best = np.full(m, -1), np.full(m, -np.inf)
    left = set(range(1, m))
    at = 0
    while left:  # the next voter is the one most correlated with those in the tree
        others = np.array(sorted(left))
        better = others[gain[at, others] > best[others]]
        best[better], parent[better] = gain[at, better], at
        at = int(others[best[others].argmax()])
        left.remove(at)
    return parent


def fitted(votes: np.ndarray, weight: np.ndarray, posterior: np.ndarray, parent: np.ndarray, prior: float | None, backing: float = 5.0) -> LabelModel:
    """The most likely parameters when the truth is known as far as ``posterior``; rare cases lean on the voter's rate without its parent."""
    m = votes.shape[1]
    above = np.where(parent >= 0, votes[:, parent], 0)
    fires = np.zeros((m, 2, 2))
    for y, w in enumerate((weight * (1 - posterior), weight * posterior)):
        rate = (w @ votes + 0.5) / (w.sum() + 1)
        for v in (0, 1):
            own = (above == v) * w[:, None]
            fires[:, y, v] = ((own * votes).sum(axis=0) + (backing + 1e-9) * rate) / (own.sum(axis=0) + backing + 1e-9)
    share = float((weight * posterior).sum() / weight.sum()) if prior is None else prior
    return LabelModel(float(np.clip(share, 1e-3, 1 - 1e-3)), parent, np.clip(fires, 1e-5, 1 - 1e-5))


def label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, prior: float | None = None, rounds: int = 25) -> tuple[np.ndarray, LabelModel]:
    """The posterior probability of toxic for rows of ``votes`` (rows, voters) of 0 and 1, and the model.

    ``start`` is a first guess of the truth, which only the first round reads. With ``prior`` the share of toxic texts
    is known. The tree settles in the first rounds.
    """
    votes = votes.astype(np.int64)
    posterior, parent = start.astype(float), None
    for k in range(rounds):
        if k < 5:
            parent = correlated(votes, weight, posterior)
        model = fitted(votes, weight, posterior, parent, prior)
        posterior = model.posterior(votes)
    return posterior, model


class Marks:
    """A sparse matrix of 0 and 1, by the row and column of each 1."""

    def __init__(self, rows: int, columns: int, own: list[list[int]]):
        self.shape = rows, columns
        self.row = np.repeat(np.arange(rows), list(map(len, own)))
        self.column = np.array([c for x in own for c in x], np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.shape[1])


def linear(x: Marks, target: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    n = weight.sum()
    v, size = np.ones(x.shape[1]), 1.0
    for _ in range(15):  # the largest curvature bounds the step
        v = x.back(weight * x.times(v)) / n
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-12)
    step = 1 / (0.3 * size + 0.3 + ridge)
    w = np.zeros(x.shape[1])
    rate = np.clip((weight @ target) / n, 1e-3, 1 - 1e-3)
    b = float(np.log(rate / (1 - rate)))
    look, look_b, before, before_b = w.copy(), b, w.copy(), b
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(look) + look_b, -30, 30)))
        gap = weight * (p - target)
        w = look - step * (x.back(gap) / n + ridge * look)
        b = look_b - step * float(gap.sum() / n)
        t = (k - 1) / (k + 2)
        look, look_b = w + t * (w - before), b + t * (b - before_b)
        before, before_b = w, b
    return w, b


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame | None:
    """(doc_id, text, toxic, weight) of about ``rows`` labelled rows that are not held out, half of each label if there are so many."""
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    share = [min(1.0, rows / 2 / n[t]) for t in (0, 1)]
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    own = F.when(F.col("toxic") == 1, F.lit(share[1])).otherwise(F.lit(share[0]))
    chosen = known.where(place < own).withColumn("weight", 1 / own)
    if chosen.count() <= BROADCAST_ROWS:  # three numbers each, or a short id
        chosen = F.broadcast(chosen)
    return stored(texts_of(docs, id_col, text_col).where(F.col("text").isNotNull()).join(chosen, "doc_id"), "toxicity-sample")


def induce(sample: DataFrame, most: int = 4000) -> list[str]:
    """Features that speak for toxic, surest first: in five toxic rows or more, ``CLEAR`` times as common there as in others, and sure by a likelihood ratio test, which also suits features of few texts."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for f in features(text):
                    found[f, toxic] += 1
            if len(found) > 400_000:
                yield table(found)
                found.clear()
        yield table(found)

    def table(found):
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["feature", "toxic", "n"])

    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    both = [F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0)) for t in (1, 0)]
    sums = sample.select("text", "toxic").mapInArrow(count, "feature string, toxic int, n long").groupBy("feature").agg(both[0].alias("pos"), both[1].alias("neg")).where("pos >= 5")
    n1, n0 = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    r1, r0 = F.col("pos") / n1, F.col("neg") / n0
    both_n = n1 + n0
    share = (F.col("pos") + F.col("neg")) / both_n

    def gain(seen: Column, n: int) -> Column:
        rest = n - seen
        return F.when(seen > 0, seen * F.log(seen / (n * share))).otherwise(0) + F.when(rest > 0, rest * F.log(rest / (n * (1 - share)))).otherwise(0)

    sums = sums.withColumn("sure", 2 * (gain(F.col("pos"), n1) + gain(F.col("neg"), n0))).where((r1 > CLEAR * r0) & (F.col("sure") > SURE))
    return [r.feature for r in sums.orderBy(F.desc("sure"), "feature").limit(most).select("feature").collect()]


def voters_of(names: list[str], induced: list[str]) -> dict[str, list[int]]:
    """The columns of each voter: seed words of a topic dealt into four lexicons, patterns, and induced features of each kind dealt into lexicons of about four."""
    place = {f: i for i, f in enumerate(names)}
    voters = {f"{topic} {k + 1}": [place[w] for w in words[k::4]] for topic, words in SEEDS.items() for k in range(4)}
    voters |= {name: [len(place) + k] for k, name in enumerate(PATTERNS)}
    for stars, kind in enumerate(("words", "beginnings", "repeated beginnings")):
        own = [f for f in induced if len(f) - len(f.rstrip("*")) == stars]
        lexicons = min(16, -(-len(own) // 4))
        voters |= {f"induced {kind} {k + 1}": [place[f] for f in own[k::lexicons]] for k in range(lexicons)}
    return voters


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 16_000) -> tuple[Model, dict]:
    """The classifier, and for each voter that ever fires how often it does on toxic and on other texts, by the label model."""
    sample = training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows)
    if sample is None:
        return Model(), {}
    induced = induce(sample)
    names = list(dict.fromkeys([*induced, *(w for words in SEEDS.values() for w in words)]))
    place = {f: i for i, f in enumerate(names)}
    patterns = list(PATTERNS)

    def marks(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            own = [sorted([place[f] for f in place.keys() & features(t)] + [len(place) + k for k, p in enumerate(patterns) if PATTERNS[p].search(t)]) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["at", "toxic", "weight"])

    got = sample.select("text", "toxic", "weight").mapInArrow(marks, "at array<int>, toxic int, weight double").collect()  # about `rows` rows
    dropped(sample)
    if len({r["toxic"] for r in got}) < 2:
        return Model(), {}
    x = Marks(len(got), len(names) + len(patterns), [r["at"] for r in got])
    toxic, weight = np.array([r["toxic"] for r in got], float), np.array([r["weight"] for r in got], float)
    voters = voters_of(names, induced)
    votes = {}
    for name, own in voters.items():
        column = np.zeros(len(names) + len(patterns))
        column[own] = 1
        if (fired := x.times(column) > 0).any():
            votes[name] = fired
    if not votes:
        return Model(), {}
    posterior, found = label_model(np.column_stack(list(votes.values())), toxic, weight, prior=float((weight @ toxic) / weight.sum()))
    w, b = linear(x, posterior, weight)
    rates = fitted(np.column_stack(list(votes.values())).astype(np.int64), weight, posterior, np.full(len(votes), -1), None).fires
    report = {name: (float(rates[k, 1, 0]), float(rates[k, 0, 0]), list(votes)[p] if (p := found.parent[k]) >= 0 else None) for k, name in enumerate(votes)}
    keep = {f: float(v) for f, v in zip(names, w[: len(names)], strict=True) if abs(v) > 1e-4}
    return Model(keep, dict(zip(patterns, map(float, w[len(names) :]), strict=True)), b), report


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, rows: int = 16_000) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``.

    The classifier is fitted on a sample of about ``rows`` labelled rows (``labels``, joined by id) that are not held
    out. Every whole text is scored, however long; a null or empty text gets the score of no feature. Rows with a null
    or repeated id are scored like any other. Labels that are null, not 0 or 1, or of an id that ``docs`` lacks are
    ignored; of differing labels for an id, toxic wins. Without labels of both kinds the score is a constant below
    ``threshold``. Other columns are left out, whatever their names; an empty table of documents gives an empty result.
    """
    model, _ = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, rows=rows)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.pattern_weights, model.bias))
    mark = uuid.uuid4().hex

    def score(ids: list, texts: list) -> list:
        if mark not in _workers:
            _workers.clear()
            _workers[mark] = Model(*shared.value)
        scores = [_workers[mark].score((t or b"").decode("utf-8", "replace")) for t in texts]
        return [ids, scores, [int(s >= threshold) for s in scores]]

    texts = texts_of(docs, id_col, text_col)
    scored = over_texts(texts, score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def not_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns, whatever their names.

    Null and empty texts stay, and so do rows with a null id unless their text is rejected; repeated rows stay or go
    together. An empty table gives an empty result.
    """
    model, _ = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.pattern_weights, model.bias))
    place = docs.columns.index(text_col)

    def keep(batches):
        own = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "") < threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
