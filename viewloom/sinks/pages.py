"""Metrics text as a set of pages that many tasks write and one commit publishes: a data source for batches and streams.

Each task writes its lines, in order, to a folder of its own, ``runs/<run>-<task>/``, a file for each stretch of a metric, and
tells the driver their names. Only the commit makes them a page: a small file ``pages/<number>.json`` that names, metric by metric in
the order of registration, the comment lines and the files. So lines are never sorted as a whole or gathered anywhere, a run
that fails leaves no page and no files, and a reader keeps the page that it has begun with as long as that is kept.
"""

from __future__ import annotations

import heapq
import json
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from viewloom.sinks.series import header
from viewloom.sources.served import Store

#: Pages that are kept; older ones go with their files.
KEPT = 2
LINES = "metric string, line string"


@dataclass
class Wrote(WriterCommitMessage):
    """(metric, file, lines) of what a task has written, in its order."""

    files: list[tuple[str, str, int]]


class Pages:
    """The folder of a page set: what is published, and its files."""

    def __init__(self, root: str):
        self.store = Store(root)

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names("pages") if n.removesuffix(".json").isdigit() and n.endswith(".json"))

    def page(self, number: int | None = None) -> list[dict]:
        """The metrics of a page, the last one if none is named: [{metric, header, files, lines}]; nothing before any."""
        number = max(self.numbers(), default=None) if number is None else number
        return [] if number is None else json.loads("".join(self.store.lines(f"{self.store.root}/pages/{number}.json")))

    def path(self, inside: str) -> str:
        return f"{self.store.root}/{inside}"

    def _runs(self, *numbers: int) -> set[str]:
        return {f.split("/")[1] for n in numbers for own in self.page(n) for f in own["files"]}

    def sweep(self, folders: Iterable[str]) -> None:
        """Deletes folders of tasks that no page which is kept names."""
        for name in set(folders) - self._runs(*self.numbers()):
            with suppress(FileNotFoundError):
                self.store.files.delete_dir(self.path(f"runs/{name}"))

    def of_run(self, run: str) -> list[str]:
        return [n for n in self.store.names("runs") if n.startswith(f"{run}-")]

    def publish(self, number: int, run: str, metrics: list[tuple[str, str]], messages: Iterable[Wrote | None]) -> None:
        """Makes the files of a run a page; what attempts that do not count have left goes, and so do pages that are too old."""
        found: dict[str, list[tuple[str, int]]] = {m: [] for m, _ in metrics}
        for message in messages:
            for metric, file, n in message.files if message else ():
                found[metric].append((file, n))
        page = [{"metric": m, "header": header(m, text), "files": [f for f, _ in found[m]], "lines": sum(n for _, n in found[m])} for m, text in metrics]
        self.store.files.create_dir(self.path("pages"))
        staged = self.path(f"pages/{uuid.uuid4().hex}.staged")
        with self.store.files.open_output_stream(staged) as out:
            out.write(json.dumps(page).encode())
        old = self.numbers()[:-KEPT] if number in self.numbers() else self.numbers()[: 1 - KEPT]
        left = self._runs(*old, *({number} & {*self.numbers()}))
        self.store.files.move(staged, self.path(f"pages/{number}.json"))
        for n in old:
            self.store.files.delete_file(self.path(f"pages/{n}.json"))
        self.sweep([*left, *self.of_run(run)])


class _Task:
    """What batches and streams share: each task's files, and what becomes of them."""

    def __init__(self, options: dict[str, str]):
        self.root, self.run = options["path"], uuid.uuid4().hex
        self.metrics = [tuple(m) for m in json.loads(options["metrics"])]

    def write(self, iterator: Iterator[Row]) -> Wrote:
        pages, known = Pages(self.root), {m for m, _ in self.metrics}
        folder = f"runs/{self.run}-{uuid.uuid4().hex}"
        wrote = []
        try:
            for metric, rows in groupby(iterator, lambda row: row.metric):
                if metric not in known:
                    raise KeyError(f"{metric} is not registered")
                if not wrote:
                    pages.store.files.create_dir(pages.path(folder))
                file, n = f"{folder}/{len(wrote)}", 0
                with pages.store.files.open_output_stream(pages.path(file), buffer_size=1 << 16) as out:
                    for n, row in enumerate(rows, 1):
                        if "\n" in row.line:
                            raise ValueError(f"a line of {metric} holds a line break")
                        out.write(row.line.encode() + b"\n")
                wrote.append((metric, file, n))
        except BaseException:
            pages.sweep([folder.removeprefix("runs/")])
            raise
        return Wrote(wrote)


class Writer(_Task, DataSourceWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pages = Pages(self.root)
        pages.publish(max([time.time_ns(), *(n + 1 for n in pages.numbers())]), self.run, self.metrics, messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Pages(self.root).sweep(Pages(self.root).of_run(self.run))


class StreamWriter(_Task, DataSourceStreamWriter):
    """Each batch is a page, numbered by the batch: one that is done again takes the place of its first try."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        Pages(self.root).publish(batchId + 1, self.run, self.metrics, messages)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        Pages(self.root).sweep(Pages(self.root).of_run(self.run))


class PageSet(DataSource):
    """Format ``pages``: rows (metric, line); options ``path``, and ``metrics``, a JSON list of (metric, help) in order."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return LINES

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def page_options(spark: SparkSession, path: str, metrics: list[tuple[str, str]]) -> dict[str, str]:
    """Options of the format ``pages`` for ``metrics`` (name, help), which is registered with the session."""
    spark.dataSource.register(PageSet)
    return {"path": path, "metrics": json.dumps(metrics)}


def write_pages(lines: DataFrame, path: str, metrics: list[tuple[str, str]]) -> None:
    """Publishes ``lines`` (metric, line; each once) as the page of ``metrics`` (name, help). An unknown metric fails the run, and nothing is published.

    Equal lines are brought together by hash, and each task sorts its own; a null line is left out.
    """
    rows = lines.where("line is not null").select("metric", "line").distinct().sortWithinPartitions("metric", "line")
    rows.write.format("pages").options(**page_options(lines.sparkSession, path, metrics)).mode("append").save()


def read_page(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(metric, line): the samples of a page, the last one if none is named."""
    pages = Pages(path)
    parts = [spark.read.text([f"{path.rstrip('/')}/{f}" for f in own["files"]]).select(F.lit(own["metric"]).alias("metric"), F.col("value").alias("line")) for own in pages.page(number) if own["files"]]
    found = spark.createDataFrame([], LINES)
    for part in parts:
        found = found.unionByName(part)
    return found


def page_text(path: str, number: int | None = None) -> Iterator[str]:
    """The lines of a page for serving: comment lines and samples, metric by metric, each in order; files are merged as they are read."""
    pages = Pages(path)
    for own in pages.page(number):
        yield from own["header"]
        yield from heapq.merge(*(pages.store.lines(pages.path(f)) for f in own["files"]))
