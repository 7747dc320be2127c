"""From a change log to current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["kind", "namespace", "name"]


#: Stands before every known place in a log.
FIRST = -(1 << 63)
#: What tells rows of a change log apart that have the same place and version.
TIE = ["uid", "rv", "op", "seq", "object"]


def order_of(columns: list[str], seq: str, version: str | None = None, digest: Column | None = None) -> Column:
    """What puts the rows of a key in order: a known ``seq`` after an unknown one, then the version, then a digest of ``columns``.

    So the last row of a key is the same one however the log is read, even if places in it are repeated or missing.
    """
    known = F.coalesce(F.col(seq).cast("bigint"), F.lit(FIRST))
    text = F.coalesce(F.col(version).cast("string"), F.lit("")) if version else F.lit("")
    return F.struct(known.alias("seq"), text.alias("version"), (F.xxhash64(*columns) if digest is None else digest).alias("digest"))


def latest(log: DataFrame, keys: list[str], seq: str, version: str | None = None, tie: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order_of``, ties by all other columns or those in ``tie``; a row's columns stay together.

    Map-side partial aggregation drops all but one row of a key in each task, so older bodies are never shuffled.
    """
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order_of(rest if tie is None else tie, seq, version)).alias("__last"))
    return last.select(*keys, *(F.col("__last")[c].alias(c) for c in rest)).select(*log.columns)


def live(log: DataFrame, keys: list[str], seq: str, gone: Column, fits: Column | None = None) -> DataFrame:
    """Current state: latest first, then without deleted keys, then what the selector lets through.

    In that order: a key whose last version no longer fits is absent, it does not fall back to an older version.
    """
    state = latest(log, keys, seq).where(~F.coalesce(gone, F.lit(False)))
    return state if fits is None else state.where(fits)


def versions(log: DataFrame, keys: list[str], seq: str, columns: list[str]) -> DataFrame:
    """Each row with the values of ``columns`` in its key's row before, as ``old_<column>``."""
    order = Window.partitionBy(*keys).orderBy(seq)
    return log.withColumns({f"old_{c}": F.lag(c).over(order) for c in columns})


def admitted(log: DataFrame, keys: list[str], seq: str, version: str) -> DataFrame:
    """Rows that change something: the first of a key, and those of another version than the one before.

    Versions are opaque: they are compared for equality only. An unknown version is always admitted.
    """
    order = Window.partitionBy(*keys).orderBy(seq)
    old = F.lag(version).over(order)
    return log.withColumn("__old", old).where(F.col("__old").isNull() | F.col(version).isNull() | (F.col("__old") != F.col(version))).drop("__old")


def coalesced(work: DataFrame, keys: list[str]) -> DataFrame:
    """One item for each key, however often it was added."""
    return work.select(*keys).distinct()
