"""Quality rules: base counts, and how far a document's histograms are from its language's.

Two histograms are compared with the language's reference by Jensen-Shannon distance: characters by class, and common
words. References are sums over all documents of the language that are long enough and keep the base rules. Short
documents are not judged by distance, and of common words those of few words may be further away, by what chance alone brings:
a text that draws n words from the reference is about sqrt(cells / (8 ln 2 n)) away from it. Everything is DataFrame
and SQL functions, within rows but for the references.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.llm.common import SPACE, stored

#: Common words of English, French, German and Spanish, whose shares make a histogram; all other words share one place.
COMMON = "the of and to in a is that for on as with le la de des et les un une que qui dans pour der die das und von den mit ist zu nicht el los las en por con del es no".split()
#: Windows of so many words count as repeated.
WINDOW = 5
#: Cells of the histogram of common words that a single language fills.
CELLS = 10


def _hits(text: Column, pattern: str) -> Column:
    """How many characters match a class."""
    return F.size(F.split(text, pattern, -1)) - 1


def measured(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common) of whole texts."""
    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(docs[id_col].alias("doc_id"), lang.alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACE))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    rows = rows.withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    each = F.col("each")
    rows = rows.withColumn("windows", F.transform(F.slice("each", 1, F.greatest(F.size("each") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(each, i + k) for k in range(1, WINDOW)))))
    # only texts with a repeated window need to know where they are
    sorted_ = F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), sorted_))
    near = F.col("sorted")
    repeated = F.array_sort(F.transform(F.filter("sorted", lambda e, j: (F.get(near, j - 1)["x"] == e["x"]) | (F.get(near, j + 1)["x"] == e["x"])), lambda e: e["i"]))
    rows = rows.withColumn("repeated", repeated)
    places = F.col("repeated")
    steps = F.transform("repeated", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    letters = F.length(F.array_join("words", ""))
    symbols = _hits(F.col("text"), r"[#*$%&|<>]")
    lists = F.filter("words", lambda w: w.isin(COMMON))
    rows = rows.select(
        "doc_id", "lang", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
        _hits(F.col("text"), "[A-Z]").alias("upper"), _hits(F.col("text"), "[0-9]").alias("digits"), _hits(F.col("text"), r"[.,;:!?'\"()\-]").alias("marks"), _hits(F.col("text"), r"[^\x00-\x7F]").alias("wide"),
        lists.alias("known"),
    )
    spaces = F.length("text") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("upper") - F.col("digits") - F.col("marks") - F.col("wide")
    counts = F.transform(F.array(*map(F.lit, COMMON)), lambda c: F.size(F.filter("known", lambda w: w == c)).cast("double"))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*(x.cast("double") for x in (spaces, rest, F.col("upper"), F.col("wide"), F.col("marks"), F.col("digits"), F.col("n_symbols")))).alias("chars"),
        F.concat(counts, F.array((F.col("n_words") - F.size("known")).cast("double"))).alias("common"),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, y: a + y)
    return _let(F.nullif(total, F.lit(0.0)), lambda t: F.transform(counts, lambda x: x / t))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to base 2, of two histograms (arrays of counts); null if one is empty."""

    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def halves(s: Column) -> Column:
        return _let((s["x"] + s["y"]) / 2, lambda m: (term(s["x"], m) + term(s["y"], m)) / 2)

    shares = F.zip_with(_shares(p), _shares(q), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda a, s: a + halves(s))))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", min_words: int = 50, most_chars: float = 0.25, most_common: float = 0.2) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, common_distance).

    ``kept`` is false if a base rule fails, or if the text has at least ``min_words`` words and one of its histograms
    is further from its language's reference than ``most_chars``, or ``most_common`` and what chance adds. Texts without
    any common word are about 0.3 away, and texts of another language 0.26 to 0.4. A null language is a language of
    its own; one without a reference judges nothing. A null or empty text has counts of zero and fails the base rules.
    Very long texts are read whole. Rows with null or repeated ids are judged like any other; other columns are left
    out. An empty table gives an empty result.
    """
    rows = stored(measured(docs, id_col=id_col, text_col=text_col, lang_col=lang_col).withColumn("lang", F.coalesce("lang", F.lit(""))), "quality")
    n = {"chars": 7, "common": len(COMMON) + 1}
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    long = rows.where((F.col("n_words") >= min_words) & ~base)
    sums = long.groupBy("lang").agg(*(F.sum(F.get(h, F.lit(i))).alias(f"{h}{i}") for h, size in n.items() for i in range(size)))
    reference = sums.select("lang", *(F.array(*(f"{h}{i}" for i in range(size))).alias(f"of_{h}") for h, size in n.items()))
    judged = rows.join(reference, "lang", "left").withColumns({f"{h}_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col(h), F.col(f"of_{h}"))) for h in n})
    chance = F.sqrt(F.lit(CELLS) / (8 * math.log(2) * F.col("n_words")))
    far = F.coalesce(F.col("chars_distance") > most_chars, F.lit(False)) | F.coalesce(F.col("common_distance") > most_common + chance, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~far).alias("kept"), "chars_distance", "common_distance")
