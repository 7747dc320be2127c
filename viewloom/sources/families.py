"""Metrics text with types: families over files of any size, and histograms and summaries put together from their samples.

A TYPE line holds for the lines after it, up to the next one. Files are read in blocks by many tasks, so the last TYPE line is
carried twice: over the lines of each block, and from block to block of a file, by a table with a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewloom.functions.text import metric_line, number_text
from viewloom.sources.objects import samples
from viewloom.sources.places import written

_TYPE = r"^#[ \t]+TYPE[ \t]+([A-Za-z_:][A-Za-z0-9_:]*)[ \t]+([a-z]+)$"
#: Endings of the samples of a family, by its type (fixed values of the metrics format).
ENDINGS = {"histogram": ("_bucket", "_sum", "_count"), "summary": ("_sum", "_count")}
_BLOCK = ["file", "block"]


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, value): lines of text files; ``at`` is their order in the block that a task reads."""
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    return spark.read.text(path).select(*(v.alias(k) for k, v in place.items()), "value")


def typed(lines: DataFrame) -> DataFrame:
    """Rows of ``text_lines`` that are no TYPE lines, with the last TYPE line before them in the file: ``type_of`` (name, type), null before any."""
    line = F.trim(F.col("value"), F.lit(" \t\r"))
    name = F.regexp_extract(line, _TYPE, 1)
    kept = lines.where((line != "") & (~line.startswith("#") | line.rlike(_TYPE))).withColumn("mark", F.when(name != "", F.struct(name.alias("name"), F.regexp_extract(line, _TYPE, 2).alias("type"))))
    marked = written(kept, "lines")  # read once: blocks that two scans of the files cut differently would not fit together
    ends = marked.groupBy(*_BLOCK).agg(F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("at"))).alias("end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*_BLOCK, F.last("end", True).over(before).alias("carried"))
    inside = Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.withColumn("own", F.last("mark", True).over(inside)).where("mark is null").join(carried, _BLOCK, "left")
    return rows.select(*lines.columns, F.coalesce("own", "carried").alias("type_of"))


def families(lines: DataFrame) -> DataFrame:
    """(file, family, type, metric, labels, value, time) of the samples in rows of ``text_lines``.

    A sample is of the family whose TYPE line is the last before it if it has its name, or its name and an ending of its
    type; else it is a family of its own, ``untyped``. Comments, blank and null lines are left out, and so is what is no sample.
    """
    rows = samples(typed(lines), keep=["file", "type_of"])
    name, kind = F.col("type_of.name"), F.col("type_of.type")
    own = F.col("metric") == name
    for of, endings in ENDINGS.items():
        own |= (kind == of) & F.col("metric").isin(*(F.concat(name, F.lit(e)) for e in endings))
    own = F.coalesce(own, F.lit(False))
    return rows.select("file", F.when(own, name).otherwise(F.col("metric")).alias("family"), F.when(own, kind).otherwise("untyped").alias("type"), "metric", "labels", "value", "time")


def _series(rows: DataFrame, kind: str, label: str, part: Column) -> DataFrame:
    others = F.array_sort(F.map_entries(F.map_filter("labels", lambda k, _: k != label)))
    at = F.element_at("labels", F.lit(label))
    place = F.when(F.lower(at).isin("+inf", "inf"), F.lit(float("inf"))).otherwise(at.try_cast("double"))
    cell = F.when(part & place.isNotNull(), F.struct(place.alias("at"), F.col("value").alias("n")))
    ends = {e: F.max(F.when(F.col("metric") == F.concat("family", F.lit(f"_{e}")), F.col("value"))).alias(e) for e in ("sum", "count")}
    found = rows.where(F.col("type") == kind).groupBy("file", "family", others.alias("others"), "time").agg(F.sort_array(F.collect_set(cell)).alias("cells"), *ends.values())
    return found.select("file", "family", F.map_from_entries("others").alias("labels"), "time", "cells", "sum", "count")


def histograms(rows: DataFrame) -> DataFrame:
    """(file, family, labels, time, cells, sum, count, whole) of rows of ``families``: each series of a histogram.

    ``cells`` are (at, n) by rising bounds, as many as the series has buckets; samples that stand twice count once. ``whole``
    tells whether the last bound is infinity, its count that of the series, and no count less than the one before.
    """
    found = _series(rows, "histogram", "le", F.col("metric") == F.concat("family", F.lit("_bucket")))
    n, last = F.col("cells.n"), F.element_at("cells", -1)
    whole = (F.size("cells") > 0) & (F.array_sort(n) == n) & (F.size(F.array_distinct(F.col("cells.at"))) == F.size("cells"))
    return found.withColumn("whole", F.coalesce(whole & (F.try_element_at("cells", F.lit(-1))["at"] == float("inf")) & (F.when(F.size("cells") > 0, last["n"]) == F.col("count")), F.lit(False)))


def summaries(rows: DataFrame) -> DataFrame:
    """(file, family, labels, time, cells, sum, count) of rows of ``families``: each series of a summary, ``cells`` its quantiles and their values."""
    return _series(rows, "summary", "quantile", F.col("metric") == F.col("family"))


def histogram_lines(cells: DataFrame, sums: DataFrame, family: str, by: list[str]) -> DataFrame:
    """(by, line): samples of a histogram in metrics text, from ``measures.histogram`` (by, le, n) and ``measures.totals`` (by, total, n)."""
    labels = {c: F.col(c).cast("string") for c in by}
    text = lambda c: number_text(F.col(c).cast("double"))
    buckets = cells.select(*by, metric_line(f"{family}_bucket", {**labels, "le": F.col("le")}, text("n")).alias("line"))
    ends = sums.select(*by, F.explode(F.array(metric_line(f"{family}_sum", labels, text("total")), metric_line(f"{family}_count", labels, text("n")))).alias("line"))
    return buckets.unionByName(ends)
