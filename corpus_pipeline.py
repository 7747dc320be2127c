"""From raw documents to encoded training text, stage by stage.

Every stage takes any rows: null and empty texts stay until the encoding, which gives them no tokens, but that texts without
words are near copies of each other. Rows with a null id stay in every stage unless their text is toxic. Repeated rows
stay or go together. Extra columns pass through all stages but the last, whatever their names. An empty table gives an
empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.llm.common import read_table, stored
from viewloom.llm.decontamination import decontaminated
from viewloom.llm.line_dedup import line_dedup
from viewloom.llm.near_copies import without_near_copies
from viewloom.llm.piece_encoding import piece_encoding
from viewloom.llm.toxicity import not_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return not_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those that lose all their lines go."""
    cut = line_dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*(f"`{c}`" for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies: five-word sets of similarity 0.8 or more, found by SimHash with the pigeonring filter."""
    return without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) of each document."""
    return piece_encoding(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]

#: SQL does not express the classifier, the fingerprints and the encoding; tests/llm/test_pipeline.py has planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each stage reads what the one before has written."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
