"""Where series go: in memory, as versioned tables, as metrics text."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions.text import metric_line
from viewloom.operators.incremental import replaced
from viewloom.sources.layers import Layers, Version, Versions
from viewloom.sources.places import Folder


class SeriesSink(ABC):
    """Series by metric: rows (anchor_key, labels..., value). Metrics are registered once; unknown ones raise."""

    def __init__(self) -> None:
        self.labels: dict[str, list[str]] = {}
        self.help: dict[str, str] = {}

    def register(self, metric: str, labels: list[str], help_text: str = "") -> None:
        if metric in self.labels:
            raise ValueError(f"{metric} is registered already")
        self.labels[metric], self.help[metric] = sorted(labels), help_text

    def fixed(self, metric: str, rows: DataFrame) -> DataFrame:
        """Just the metric's columns; a missing label is empty, others are left out."""
        if metric not in self.labels:
            raise KeyError(f"{metric} is not registered")
        own = [(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit("")).alias(n) for n in self.labels[metric]]
        return rows.select("anchor_key", *own, F.lit(1.0).alias("value"))

    @abstractmethod
    def read(self, metric: str) -> DataFrame:
        """All series of a metric."""

    @abstractmethod
    def write(self, metric: str, rows: DataFrame) -> None:
        """Puts rows in place of all series of a metric."""

    def replace(self, metric: str, anchors: DataFrame, rows: DataFrame) -> None:
        """Puts rows in place of those of ``anchors`` (anchor_key); anchors without rows lose theirs."""
        self.write(metric, replaced(self.read(metric), anchors.select("anchor_key").distinct(), self.fixed(metric, rows), "anchor_key"))

    def upsert(self, metric: str, rows: DataFrame) -> None:
        """Adds series, each once."""
        self.write(metric, self.read(metric).unionByName(self.fixed(metric, rows)).distinct())

    def delete(self, metric: str, rows: DataFrame) -> None:
        """Removes series."""
        keys = ["anchor_key", *self.labels[metric]]
        self.write(metric, self.read(metric).join(self.fixed(metric, rows).select(*keys), keys, "left_anti"))


class MemorySink(SeriesSink):
    """Keeps plans; they run when they are read."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark
        self.rows: dict[str, DataFrame] = {}

    def read(self, metric: str) -> DataFrame:
        schema = ", ".join(["anchor_key string", *(f"`{n}` string" for n in self.labels[metric]), "value double"])
        return self.rows.get(metric, self.spark.createDataFrame([], schema))

    def write(self, metric: str, rows: DataFrame) -> None:
        self.rows[metric] = self.fixed(metric, rows)


class TableSink(SeriesSink):
    """Keeps series as tables that change by layers: replacing an anchor writes its own rows, whatever the metric's size.

    Each change is a version, published by compare-and-swap; of two writers the slower one makes its change again on top of
    the other's, so none is lost. Reads merge the layers. A folder keeps its last two versions, and a sink opened on it goes on
    from the last.
    """

    def __init__(self, spark: SparkSession, folder: str, *, buckets: int = 16):
        super().__init__()
        self.spark, self.folder, self.buckets = spark, Folder(spark, folder), buckets
        self.versions = Versions(self.folder)

    def table(self, metric: str) -> Layers:
        schema = ", ".join(["anchor_key string", *(f"`{n}` string" for n in self.labels[metric]), "value double"])
        return Layers(self.spark, self.folder, f"series-{metric}", schema, ["anchor_key"], self.buckets)

    def version(self) -> int:
        """The last published version; 0 before any."""
        return self.versions.now().number

    def read(self, metric: str) -> DataFrame:
        return self.table(metric).read(self.versions.now())

    def write(self, metric: str, rows: DataFrame) -> None:
        own = self.fixed(metric, rows)
        self._change(lambda version: self.table(metric).fill(version, own))

    def replace(self, metric: str, anchors: DataFrame, rows: DataFrame) -> None:
        """As in SeriesSink; ``rows`` of other anchors are added to the replaced ones, so their anchors lose what they had."""
        own = self.fixed(metric, rows)
        touched = anchors.select("anchor_key").unionByName(own.select("anchor_key"))
        self._change(lambda version: self.table(metric).put(version, own, touched))

    def upsert(self, metric: str, rows: DataFrame) -> None:
        own = self.fixed(metric, rows)
        self._change(lambda version: self.table(metric).put(version, self.table(metric).at(version, own).unionByName(own).distinct(), own))

    def delete(self, metric: str, rows: DataFrame) -> None:
        own = self.fixed(metric, rows)
        keys = ["anchor_key", *self.labels[metric]]
        self._change(lambda version: self.table(metric).put(version, self.table(metric).at(version, own).join(own.select(*keys), keys, "left_anti"), own))

    def _change(self, put: Callable[[Version], None]) -> None:
        def write(version: Version) -> bool:
            put(version)
            return True

        self.versions.commit(write)


def exposition(rows: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """(line): each distinct label set as a sample of 1, in metrics text."""
    return rows.select(metric_line(metric, {n: F.col(n) for n in labels}).alias("line")).distinct()


def header(metric: str, help_text: str) -> list[str]:
    """The comment lines before a metric's samples."""
    text = help_text.replace("\\", "\\\\").replace("\n", "\\n")
    return [f"# HELP {metric} {text}", f"# TYPE {metric} gauge"]


def page(rows: DataFrame, metric: str, labels: list[str], help_text: str) -> DataFrame:
    """(line): a metric's comment lines and samples, in the order that metrics text has them."""
    top = rows.sparkSession.createDataFrame([(k, x) for k, x in enumerate(header(metric, help_text))], "part int, line string")
    return top.unionByName(exposition(rows, metric, labels).withColumn("part", F.lit(2))).orderBy("part", "line").select("line")


def snapshot_lines(lines: DataFrame, allowed: list[str], column: str = "value") -> DataFrame:
    """(metric, line): the sample lines of metrics text whose metric is allowed, for printing."""
    line = F.trim(column)
    own = lines.where((line != "") & ~line.startswith("#")).select(F.regexp_extract(line, r"^([^{\s]+)", 1).alias("metric"), line.alias("line"))
    return own.where(F.col("metric").isin(*allowed))
