"""Tables in buckets that change by layers, under versions that are published by compare-and-swap.

A layer holds, for the groups that a change touches, all their new rows, or a marker for a group that has none any more.
So a change writes what it touches and nothing else, and reading merges: of each group the rows of its last layer count.
Only layers over a bucket's base are looked through for that, and readers open the buckets that they ask for. A bucket with
more than ``DEEPEST`` layers is written anew as one.

A version is one small file that names the layers of every bucket. Writers add files under names of their own and then
publish the version after the one they have read; if another writer was first, nothing of theirs counts and they begin again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from viewloom.sources.places import Folder

#: Layers of a bucket before it is written anew.
DEEPEST = 6


@dataclass
class Version:
    """Which layers, oldest first, each bucket of each table has, and notes that go with the version."""

    number: int = 0
    layers: dict[tuple[str, int], list[str]] = field(default_factory=dict)
    notes: list = field(default_factory=list)

    def next(self) -> Version:
        """The version to write: numbered one higher, with copies of all lists."""
        return Version(self.number + 1, {k: [*v] for k, v in self.layers.items()}, [*self.notes])

    def names(self) -> set[tuple[str, int, str]]:
        return {(what, bucket, name) for (what, bucket), own in self.layers.items() for name in own}


class Versions:
    """The published versions in a folder; the last two are kept."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("version") if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int) -> Version:
        found = json.loads(self.folder.text(f"version/{number}.json"))
        return Version(number, {(what, bucket): own for what, bucket, own in found["layers"]}, found["notes"])

    def now(self) -> Version:
        """The last published version; an empty one before any."""
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else Version()

    def publish(self, version: Version) -> bool:
        """Makes a version the current one, unless another of its number is there. Then layers that only versions before the last two had are deleted."""
        text = json.dumps({"layers": [[what, bucket, own] for (what, bucket), own in sorted(version.layers.items())], "notes": version.notes})
        if not self.folder.publish(f"version/{version.number}.json", text):
            return False
        old = [n for n in self.numbers() if n < version.number - 1]
        if old:
            used = version.names() | (self.read(version.number - 1).names() if version.number - 1 in self.numbers() else set())
            for number in old:
                for what, bucket, name in self.read(number).names() - used:
                    self.folder.delete(f"{what}/{name}/bucket={bucket}")
                self.folder.delete(f"version/{number}.json")
        return True

    def commit(self, write: Callable[[Version], bool], tries: int = 5) -> bool:
        """Calls ``write`` with the version to fill, and publishes it; again on top of the newer version if another writer was first. False if ``write`` has nothing to say."""
        for _ in range(tries):
            version = self.now().next()
            if not write(version):
                return False
            if self.publish(version):
                return True
        raise RuntimeError(f"other writers were first {tries} times")


class Layers:
    """One table: rows of ``schema``, replaced by ``group``, in buckets by the columns ``by``."""

    def __init__(self, spark: SparkSession, folder: Folder, what: str, schema: str, group: list[str], buckets: int, by: dict[str, Column] | None = None):
        self.spark, self.folder, self.what, self.group, self.buckets = spark, folder, what, group, buckets
        self.fields = StructType.fromDDL(schema)
        self.stored = StructType.fromDDL(schema + ", __layer bigint, __gone boolean")
        self.by = by or {c: F.col(f"`{c}`") for c in group}

    def bucket(self, columns: Iterable[Column] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(self.by.values() if columns is None else columns)), F.lit(self.buckets)).cast("int")

    def asked(self, rows: DataFrame, columns: Iterable[Column] | None = None) -> list[int]:
        """The buckets that rows fall into; no more numbers than there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket(columns)).distinct().collect())

    def _paths(self, version: Version, only: list[int] | None) -> tuple[list[str], list[str]]:
        base, over = [], []
        for (what, bucket), own in version.layers.items():
            if what == self.what and (only is None or bucket in only):
                paths = [self.folder.path(f"{what}/{name}/bucket={bucket}") for name in own]
                base.append(paths[0])
                over += paths[1:]
        return base, over

    def read(self, version: Version, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        base, over = self._paths(version, only)
        columns = [f"`{f.name}`" for f in self.fields]
        if not base:
            return self.spark.createDataFrame([], self.fields)
        rows = self.spark.read.schema(self.stored).parquet(*base).where("not __gone")
        if not over:
            return rows.select(*columns)
        layers = self.spark.read.schema(self.stored).parquet(*over)
        tops = layers.groupBy(*self.group).agg(F.max("__layer").alias("__top"))
        fresh = layers.join(tops, self.group).where("__layer = __top and not __gone")
        return rows.join(tops, self.group, "left_anti").select(*columns).unionByName(fresh.select(*columns))

    def at(self, version: Version, keys: DataFrame, use: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows whose columns ``by`` stand in ``keys`` (the same names); only their buckets are opened.

        ``use`` makes of them what is wanted and keeps the columns that ``by`` reads. An inner join with distinct keys is
        not pushed below it, as a semi join is; so what a large look-up shuffles is what is wanted, not whole rows.
        """
        keys = keys.select(*self.by).distinct()
        rows = self.read(version, self.asked(keys, [F.col(f"`{c}`") for c in self.by]))
        rows = rows if use is None else use(rows)
        found = rows.withColumns({f"__by_{c}": v for c, v in self.by.items()})
        return found.join(keys.withColumnsRenamed({c: f"__by_{c}" for c in self.by}), [f"__by_{c}" for c in self.by], "left_semi" if use is None else "inner").select(*(f"`{c}`" for c in rows.columns))

    def put(self, version: Version, rows: DataFrame, touched: DataFrame) -> None:
        """Puts ``rows`` in place of those of the groups in ``touched``, as a layer; groups without rows are gone."""
        own = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields), F.lit(False).alias("__gone"))
        groups = touched.select(*self.group).distinct()
        lost = groups.join(rows.select(*self.group), self.group, "left_anti")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in self.fields if f.name not in self.group}
        own = own.unionByName(lost.withColumns({**empty, "__gone": F.lit(True)}))
        self._write(version, own, self.asked(groups.withColumns(empty)), over=True)
        deep = [b for (what, b), names in version.layers.items() if what == self.what and len(names) > DEEPEST]
        if deep:
            self._write(version, self.read(version, deep).withColumn("__gone", F.lit(False)), deep, over=False)

    def fill(self, version: Version, rows: DataFrame) -> None:
        """Puts ``rows`` in place of all there are."""
        own = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields)).withColumn("__gone", F.lit(False))
        self._write(version, own, list(range(self.buckets)), over=False)

    def _write(self, version: Version, rows: DataFrame, touched: list[int], over: bool) -> None:
        if not touched:
            return
        name = f"{version.number}-{uuid.uuid4().hex}"
        spread = rows.withColumns({"__layer": F.lit(version.number).cast("bigint"), "bucket": self.bucket()})
        # a large bucket is written by several tasks, small ones by one
        spread.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(self.folder.path(f"{self.what}/{name}"))
        there = {int(n.removeprefix("bucket=")) for n in self.folder.names(f"{self.what}/{name}") if n.startswith("bucket=")}
        if not there:
            self.folder.delete(f"{self.what}/{name}")
        for bucket in touched:
            before = version.layers.pop((self.what, bucket), []) if not over else version.layers.get((self.what, bucket), [])
            if bucket in there:
                version.layers[self.what, bucket] = [*before, name] if over else [name]
