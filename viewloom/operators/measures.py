"""Measures of the engine itself, and checks over metric samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of duration histograms, in seconds (fixed values of the metrics format).
DURATIONS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def exponential(start: float, factor: float, count: int) -> tuple[float, ...]:
    """Bounds that grow by a factor."""
    return tuple(start * factor**k for k in range(count))


#: Upper bounds of client latencies: 14 from a millisecond on, doubling.
LATENCIES = exponential(0.001, 2, 14)


def counts(events: DataFrame, by: list[str], alias: str = "n") -> DataFrame:
    """A counter for each combination of labels."""
    return events.groupBy(*by).agg(F.count("*").alias(alias))


def histogram(events: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = DURATIONS) -> DataFrame:
    """(by, le, n): how many values are at most each bound, infinity last; one pass over the events."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = events.groupBy(*by).agg(*sums, F.count("*").alias("all"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return wide.select(*by, F.inline(cells))


def totals(events: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, total, n): the sum and count that go with a histogram."""
    return events.groupBy(*by).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def requests(calls: DataFrame, code: str, method: str, host: str) -> DataFrame:
    """(code, method, host, n): a counter of requests by normalised status."""
    return counts(calls.select(status_code(F.col(code)).alias("code"), F.col(method).alias("method"), F.col(host).alias("host")), ["code", "method", "host"])


def latencies(calls: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """(by, le, n): latencies of requests in buckets that double."""
    return histogram(calls, by, seconds, LATENCIES)


def elapsed(began: Column, ended: Column) -> Column:
    """Seconds between two times, with fractions."""
    return (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 1e6


def stamp(time: Column) -> Column:
    """A time as RFC 3339 text in UTC, with nanoseconds; trailing zeros are left out."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(utc, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def queue_depth(added: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """(depth): keys that were added and not taken yet, each once."""
    return added.select(*keys).distinct().join(taken.select(*keys), keys, "left_anti").agg(F.count("*").alias("depth"))


def index_lookups(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """(indexed, fallback): how many changed objects (column uid) the index knows as parents, and how many it does not."""
    known = changed.select("uid").distinct().join(deps.select(F.col("parent_uid").alias("uid"), F.lit(1).alias("known")).distinct(), "uid", "left")
    return known.agg(F.count("known").alias("indexed"), F.count_if(F.col("known").isNull()).alias("fallback"))


def index_size(deps: DataFrame) -> DataFrame:
    """(by_parent, by_anchor): distinct parents and anchors of an index."""
    return deps.agg(F.countDistinct("parent_uid").alias("by_parent"), F.countDistinct("anchor_key").alias("by_anchor"))


def status_code(code: Column) -> Column:
    """An HTTP status as a label: 0 if there is none, invalid if it is no integer of 64 bits."""
    whole = code.rlike(r"\A[+-]?[0-9]+\z") & code.try_cast("bigint").isNotNull()
    return F.when(code.isNull() | (code == ""), "0").when(whole, code).otherwise("invalid")


def with_labels(labels: Column, **want: str | list[str]) -> Column:
    """Whether a map of labels has all these values; a list holds any of its values."""
    fits = F.lit(True)
    for name, value in want.items():
        own = F.try_element_at(labels, F.lit(name))
        fits &= F.coalesce(own.isin(*value) if isinstance(value, list) else own == value, F.lit(False))
    return fits


def first_gauge(samples: DataFrame, metric: str, fits: Column, order: str) -> DataFrame:
    """(value): that of the first matching sample of a metric by ``order``; no row if none matches."""
    return samples.where((F.col("metric") == metric) & fits).orderBy(order).limit(1).select("value")


def matching(samples: DataFrame, metric: str, fits: Column) -> DataFrame:
    """(n): how many samples of a metric match."""
    return samples.where((F.col("metric") == metric) & fits).agg(F.count("*").alias("n"))


#: Methods that change something, in upper case (fixed values).
WRITES = ("POST", "PUT", "PATCH", "DELETE")


def writes(calls: DataFrame, method: str, value: str) -> DataFrame:
    """(total): the sum over requests that write, whatever the case of their methods."""
    return total(calls, F.upper(method).isin(*WRITES), value)


def total(samples: DataFrame, fits: Column, value: str) -> DataFrame:
    """The sum of matching samples; 0 if there is none."""
    return samples.where(fits).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def all_match(rows: DataFrame, by: list[str], holds: Column, least: int) -> DataFrame:
    """(by, ok): whether a group has at least ``least`` rows and all of them hold."""
    return rows.groupBy(*by).agg((F.bool_and(F.coalesce(holds, F.lit(False))) & (F.count("*") >= least)).alias("ok"))


def deltas(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, delta): the growth of each counter; one that is missing before counts as 0."""
    joined = after.join(before.select(*by, F.col(value).alias("__before")), by, "left")
    return joined.select(*by, (F.col(value) - F.coalesce("__before", F.lit(0))).alias("delta"))


def max_delta(before: DataFrame, after: DataFrame, by: str, value: str) -> DataFrame:
    """The largest growth of a counter."""
    return deltas(before, after, [by], value).agg(F.max("delta").alias("max_delta"))


def exists_in(rows: DataFrame, others: DataFrame, on: list[str], fits: Column) -> DataFrame:
    """Rows with a match of the same key among the ``others`` that fit."""
    return rows.join(others.where(fits).select(*on), on, "left_semi")
