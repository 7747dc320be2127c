"""Line deduplication by a suffix array over line-ID sequences.

A document is the sequence of its lines that have a word. Prefix doubling ranks the suffixes of all documents: a line's rank
is the place of its ID among all that come more than once, and the rank of the 2^(k+1) lines from a position on is the
place of the pair of ranks of their halves. Each round sorts the distinct pairs over all machines. Suffixes of the same
rank are an interval of the suffix array, whose longest common prefix has 2^k lines at least; one that stands alone in its
interval shares no more lines with any other and takes part in no further round. Ranks grow until 2^k lines are enough
for any run of ``min_words`` words.

The interval of a run of n lines is that of the ranks of its first and last 2^k lines, 2^k being the largest power within n.
Looked up are, for each line, the shortest runs of ``min_words`` words that begin or end with it. Those whose interval
has a smaller position cover exactly the lines of all maximal repeated runs of so many words, but for their first copies.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import SPACE, WORD, dropped, stored

#: A position in the corpus; texts that share an id are told apart by ``version``.
PLACE = ["doc_id", "version", "at"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _doubled(first: Column, levels: int, join: Callable[[Column, Column], Column], none: Column) -> Column:
    """Arrays for runs of 1, 2, 4, ... lines, from the one for single lines; ``none`` where a document ends before."""

    def step(found: Column, half: Column) -> Column:
        return _let(F.element_at(found, -1), lambda last: F.concat(found, F.array(F.transform(last, lambda x, i: F.coalesce(join(x, F.get(last, i + half)), none)))))

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(levels))), F.array(first), step) if levels else F.array(first)


def _shortest(sums: Column, i: Column, min_words: int, levels: int, sign: int) -> Column:
    """Lines of the shortest run of ``min_words`` words from line i on (sign 1) or up to it (sign -1); null if there are too few."""

    def step(state: Column, k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("int")
        first = i + state["n"] if sign > 0 else i - state["n"] - size + 1
        more = F.when(first >= 0, F.get(F.get(sums, k), first))
        return _let(state["words"] + more, lambda words: F.when(words < min_words, F.struct((state["n"] + size).alias("n"), words.alias("words"))).otherwise(state))

    def whole(below: Column) -> Column:
        last = i + below["n"] * sign
        full = F.when(last >= 0, F.get(F.get(sums, F.lit(0)), last)) + below["words"] >= min_words
        return F.when(full, (below["n"] + 1).cast("int"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("words"))
    return _let(F.aggregate(F.array(*map(F.lit, range(levels, -1, -1))), start, step), whole)


def line_table(docs: DataFrame, *, min_words: int, levels: int) -> DataFrame:
    """(doc_id, version, at, line, ahead, back): each line with a word, by its ID, and the lines of the shortest runs of ``min_words`` words from it on and up to it."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    own = own.select("doc_id", F.xxhash64("text").alias("version"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    words = F.transform("lines", lambda x: F.size(F.split(F.btrim(x, F.lit(SPACE)), r"[\x20\x09-\x0D]+")).cast("long"))
    own = own.select("doc_id", "version", "lines", _doubled(words, levels, lambda a, b: a + b, F.lit(1 << 50)).alias("sums"))
    sums = F.col("sums")
    each = F.transform("lines", lambda x, i: F.struct(F.unhex(F.md5(x)).alias("line"), _shortest(sums, i, min_words, levels, 1).alias("ahead"), _shortest(sums, i, min_words, levels, -1).alias("back")))
    return own.select("doc_id", "version", F.posexplode(each).alias("at", "of")).select("doc_id", "version", "at", "of.*")


def _ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """``rows`` whose values of ``by`` come more than once, with the place of these among all such values as ``rank``."""
    several = rows.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1").select(*by)
    # ids that grow along the sorted partitions; gaps do no harm, and what is written stays as it is
    ranks = stored(several.orderBy(*by).select(*by, F.monotonically_increasing_id().alias("rank")), "ranks")
    found = stored(rows.join(ranks, by).drop(*by), label)
    dropped(ranks)
    return found


def suffix_ranks(lines: DataFrame, levels: int) -> Iterator[DataFrame]:
    """(doc_id, version, at, rank) of suffixes that share their first 1, 2, 4, ... lines with others, level by level.

    Each table lives until the next one is asked for.
    """
    now = _ranked(lines.select(*PLACE, "line"), ["line"], "suffixes")
    yield now
    for level in range(levels):
        later = now.select("doc_id", "version", (F.col("at") - (1 << level)).alias("at"), F.col("rank").alias("second"))
        pairs = now.withColumnRenamed("rank", "first").join(later, PLACE)
        nxt = _ranked(pairs, ["first", "second"], "suffixes")
        dropped(now)
        now = nxt
        yield now
    dropped(now)


def repeated_runs(docs: DataFrame, *, min_words: int) -> DataFrame:
    """(doc_id, version, start, n) of the runs that also start earlier, in lines that have a word, from (doc_id, text)."""
    levels = max(0, min_words.bit_length() - 1)  # each line has a word, so a run has at most min_words lines
    lines = stored(line_table(docs, min_words=min_words, levels=levels), "lines")
    ends = lines.where("back > 0").select("doc_id", "version", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("n"))
    runs = lines.where("ahead > 0").select(*PLACE, F.col("ahead").alias("n")).unionByName(ends)
    found = None
    for level, ranks in enumerate(suffix_ranks(lines, levels)):
        size = 1 << level
        own = runs.where(F.col("n").between(size, 2 * size - 1))
        first = own.join(ranks.withColumnRenamed("rank", "first"), PLACE)
        last = ranks.select("doc_id", "version", F.col("at").alias("end"), F.col("rank").alias("last"))
        interval = first.withColumn("end", F.col("at") + F.col("n") - size).join(last, ["doc_id", "version", "end"])
        interval = stored(interval.select(*PLACE, "n", "first", "last"), "intervals")
        # map-side partial sums keep a common run from meeting in one task
        least = interval.groupBy("n", "first", "last").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.max(F.struct("doc_id", "at")).alias("most")).where("least < most").drop("most")
        later = interval.join(least, ["n", "first", "last"]).where(F.struct("doc_id", "at") > F.col("least"))
        later = stored(later.select("doc_id", "version", F.col("at").alias("start"), "n"), "later")
        dropped(interval)
        found = later if found is None else found.unionByName(later)
    dropped(lines)
    return found


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted, and n_lines, n_removed (lines that have a word) added.

    A run is a sequence of lines of one document, leaving out lines without a word; it is repeated if the same sequence
    starts earlier: in a document of smaller id, or earlier in the same one. Lines of repeated runs of at least
    ``min_words`` words are deleted, but for the first copy, judged on the input. Lines without a word stay where they
    are. Lines are compared by MD5 of their bytes; matches never cross documents.

    A null text has no lines and stays null; an empty one stays empty. Very long texts are read whole, at a cost that
    grows with their lines. Rows with a null id stay as they are and are no sources. Rows that share an id are one place
    in the corpus: none is earlier than the other, and equal rows get equal results. Extra columns pass through, whatever
    their names; columns named n_lines or n_removed are replaced. An empty table gives an empty result.
    """
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    lost = repeated_runs(rows.select("doc_id", "text"), min_words=min_words)
    lost = lost.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "n")).alias("runs")).withColumnsRenamed({"doc_id": "of", "version": "of_version"})
    joined = rows.join(lost, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("of_version")), "left")
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
    lines = joined.select("row", "text", gone.alias("gone"), F.split("text", "\n", -1).alias("lines"))
    lines = lines.withColumn("own", F.filter(F.transform("lines", lambda x, p: F.when(x.rlike(WORD), p)), lambda p: p.isNotNull()))
    out = F.transform("gone", lambda j: F.get("own", j))
    kept = F.array_join(F.transform(F.array_except(F.transform("lines", lambda _, p: p), out), lambda p: F.get("lines", p)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    same = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    counts = [F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long").alias(n) for n, x in (("n_lines", "own"), ("n_removed", "gone"))]
    return lines.select(*same, *counts)
