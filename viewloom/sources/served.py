"""Objects served as lists and watches: a data source that lists, then watches, and lists anew where changes have gone.

A folder serves objects as an API does, by versions that only grow::

    lists/<version>/kind=Pod/namespace=shop/...         lines of objects, as they stood at that version
    watches/<first>-<last>/kind=Pod/namespace=shop/...  lines {"type": "MODIFIED", "object": {...}}, changes of these versions

A folder inside counts when it is complete (``_SUCCESS``). Old lists and watches may be taken away at any time. ``served``
reads what stands now, ``watched`` follows it; the offset of the stream is a version. A batch of the stream holds the changes
after the last version, if all are still there. At the start, and after a gap, it holds the newest list and the changes after
that. Each file is a task of its own, read line by line, so neither a list nor a watch is ever held whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, replace
from itertools import islice
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition

from viewloom.functions.selectors import field_terms, label_terms
from viewloom.model import CLUSTER, KINDS, NAMESPACED, Config, Watched
from viewloom.operators.state import KEY

#: Columns of what is read: those of a change log, and for an object out of a list the version of the list.
SERVED = "kind string, namespace string, name string, uid string, rv string, op string, seq bigint, object string, listed bigint"
_COLUMNS = [c.split()[0] for c in SERVED.split(", ")]
#: ``op`` of a row that says: of this kind (and namespace, unless null) all that is older than ``listed`` and not in that list has gone.
LISTED = "LISTED"
#: ``op`` of a line that cannot be read; ``object`` is the line.
UNREADABLE = "UNREADABLE"
#: Types of changes that a watch tells (fixed values).
_CHANGES = ("ADDED", "MODIFIED", "DELETED")
_EVENT = re.compile(r'\{"type":"([A-Z]+)","object":(\{.*\})\}')
#: Rows that a task hands over at once.
BATCH = 2048
_NO_NAMESPACE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Part(InputPartition):
    """A file and what of it counts; or, without a path, the row that says what was listed (of all namespaces if there is none)."""

    path: str | None
    kind: str = ""
    namespace: str | None = None
    low: int = 0
    high: int = 0
    listed: int | None = None


class Store:
    """The folder, read by names and lines."""

    def __init__(self, root: str):
        from pyarrow.fs import FileSystem

        self.files, self.root = FileSystem.from_uri(root if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", root) else Path(root).absolute().as_uri())

    def names(self, inside: str) -> list[str]:
        from pyarrow.fs import FileSelector

        return sorted(f.base_name for f in self.files.get_file_info(FileSelector(f"{self.root}/{inside}", allow_not_found=True)))

    def complete(self, what: str) -> list[str]:
        from pyarrow.fs import FileType

        names = [n for n in self.names(what) if re.fullmatch(r"[0-9]+(-[0-9]+)?", n)]
        marks = self.files.get_file_info([f"{self.root}/{what}/{n}/_SUCCESS" for n in names]) if names else []
        return [n for n, mark in zip(names, marks, strict=True) if mark.type == FileType.File]

    def lists(self) -> list[int]:
        return sorted(map(int, self.complete("lists")))

    def watches(self) -> list[tuple[int, int]]:
        return sorted(tuple(map(int, n.split("-"))) for n in self.complete("watches") if "-" in n)

    def lines(self, path: str) -> Iterator[str]:
        with self.files.open_input_stream(path) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from (w.decode("utf-8", "replace") for w in whole)
            if rest:
                yield rest.decode("utf-8", "replace")


def reach(watches: Iterable[tuple[int, int]], start: int) -> int:
    """The last version up to which watches tell every change after ``start``."""
    for first, last in sorted(watches):
        if first <= start + 1:
            start = max(start, last)
    return start


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value)


def _fits(body: dict, labels: list, fields: list) -> bool:
    meta = body.get("metadata") or {}
    own = meta.get("labels") or {}
    for name, test, values in labels:
        there = own.get(name) in values if values else own.get(name) is not None
        if there != (test in ("in", "there")):
            return False
    for path, equal, wanted in fields:
        value = body
        for step in path.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        if (_text(value) == wanted) != equal:
            return False
    return True


class Scopes:
    """Which kinds, namespaces and objects are asked for; this decides which files are opened, and which lines count."""

    def __init__(self, watched: list[Watched], root: str):
        self.root = root
        self.watched = {w.kind: w for w in watched}
        self.terms = {w.kind: (label_terms(w.label_selector), field_terms(w.field_selector, w.kind)) for w in watched}

    def narrowed(self, kinds: set[str] | None, namespaces: set[str] | None) -> None:
        left = {k: w for k, w in self.watched.items() if kinds is None or k in kinds}
        if namespaces is not None:
            left = {k: replace(w, namespaces=tuple(sorted(namespaces & set(w.namespaces) if w.namespaces else namespaces))) for k, w in left.items()}
            left = {k: w for k, w in left.items() if w.namespaces}
        self.watched = left

    def files(self, store: Store, inside: str) -> Iterator[tuple[str, str, str]]:
        """(path, kind, namespace) of the files that are asked for; no other folder is looked into."""
        kinds = [n.removeprefix("kind=") for n in store.names(inside) if n.startswith("kind=")]
        for kind in kinds:
            if kind in self.watched:
                for name in store.names(f"{inside}/kind={kind}"):
                    namespace = "" if name == f"namespace={_NO_NAMESPACE}" else unquote(name.removeprefix("namespace="))
                    if name.startswith("namespace=") and (not self.watched[kind].namespaces or namespace in self.watched[kind].namespaces):
                        for file in store.names(f"{inside}/kind={kind}/{name}"):
                            if not file.startswith(("_", ".")):
                                yield f"{store.root}/{inside}/kind={kind}/{name}/{file}", kind, namespace

    def parts(self, store: Store, start: int, end: int) -> list[Part]:
        """What to read for the versions after ``start`` up to ``end``: watches, or a list and the watches after it."""
        watches, found = store.watches(), []
        if not start or reach(watches, start) < end:
            version = max((v for v in store.lists() if reach(watches, v) >= end), default=None)
            if version is None:
                raise FileNotFoundError(f"{self.root}: no list from which watches lead to version {end}")
            found = [Part(None, w.kind, namespace, listed=version) for w in self.watched.values() for namespace in (w.namespaces or (None,))]
            found += [Part(*file, listed=version) for file in self.files(store, f"lists/{version}")]
            start = version
        for first, last in watches:
            if last > start and first <= end:
                found += [Part(*file, low=start, high=end) for file in self.files(store, f"watches/{first}-{last}")]
        return found

    def rows(self, part: Part) -> Iterator[tuple]:
        if part.path is None:
            yield part.kind, part.namespace, None, None, str(part.listed), LISTED, part.listed, None, part.listed
            return
        labels, fields = self.terms[part.kind]
        for line in Store(self.root).lines(part.path):
            if not line.strip():
                continue
            try:
                op, text = "ADDED", line
                if part.listed is None:
                    m = _EVENT.fullmatch(line)
                    event = None if m else json.loads(line)
                    op, text = (m[1], m[2]) if m else (event["type"], json.dumps(event["object"]))
                    if op == "BOOKMARK":
                        continue
                    if op not in _CHANGES:
                        raise ValueError(op)
                body = json.loads(text)
                meta = body["metadata"]
                name, uid, rv = meta["name"], meta.get("uid") or "", str(meta["resourceVersion"])
                seq = int(rv)
                if not isinstance(name, str) or not isinstance(uid, str):
                    raise TypeError(name)
                fits = _fits(body, labels, fields)
            except (ValueError, KeyError, TypeError, AttributeError):
                yield part.kind, part.namespace, None, None, None, UNREADABLE, None, line, None
                continue
            if part.listed is None and not part.low < seq <= part.high:
                continue
            if fits:
                yield part.kind, part.namespace, name, uid, rv, op, seq, text, part.listed
            elif part.listed is None:  # it may have left the selector
                yield part.kind, part.namespace, name, uid, rv, "DELETED", seq, None, None

    def batches(self, part: Part) -> Iterator:
        import pyarrow as pa

        types = {"seq": pa.int64(), "listed": pa.int64()}
        schema = pa.schema([(c, types.get(c, pa.string())) for c in _COLUMNS])
        rows = self.rows(part)
        while batch := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), schema.types, strict=True)], schema=schema)


def _newest(store: Store) -> int:
    """The last version that a list and the watches after it lead to; 0 if nothing is served yet."""
    watches = store.watches()
    return max((reach(watches, v) for v in store.lists()), default=0)


class Reader(DataSourceReader):
    def __init__(self, scopes: Scopes):
        self.scopes = scopes

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Kinds and namespaces that are asked for by value; all other filters are left to Spark."""
        asked: dict[str, set] = {}
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute in (("kind",), ("namespace",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                asked[f.attribute[0]] = asked.get(f.attribute[0], values) & values
            yield f  # rows that say what was listed may stand for more than one namespace, so Spark looks once more
        self.scopes.narrowed(asked.get("kind"), asked.get("namespace"))

    def partitions(self) -> list[Part]:
        store = Store(self.scopes.root)
        end = _newest(store)
        return self.scopes.parts(store, 0, end) if end and self.scopes.watched else [Part("")]

    def read(self, partition: Part) -> Iterator:
        return self.scopes.batches(partition) if partition.path != "" else iter(())


class Follower(DataSourceStreamReader):
    """Offsets are {"version": n}; 0 is before the first list."""

    def __init__(self, scopes: Scopes):
        self.scopes = scopes

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": _newest(Store(self.scopes.root))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["version"] <= start["version"]:
            return []
        return self.scopes.parts(Store(self.scopes.root), start["version"], end["version"])

    def read(self, partition: Part) -> Iterator:
        return self.scopes.batches(partition)


class Served(DataSource):
    """Format ``served``; options ``path``, and ``watched``, a JSON list of what is asked for (all kinds if it is left out)."""

    @classmethod
    def name(cls) -> str:
        return "served"

    def schema(self) -> str:
        return SERVED

    def _scopes(self) -> Scopes:
        asked = json.loads(self.options.get("watched") or "[]")
        found = [Watched(**{**w, "namespaces": tuple(w.get("namespaces", ()))}) for w in asked] or [Watched(k, CLUSTER if k == "Node" else NAMESPACED) for k in KINDS]
        return Scopes(found, self.options["path"])

    def reader(self, schema) -> Reader:
        return Reader(self._scopes())

    def streamReader(self, schema) -> Follower:
        return Follower(self._scopes())


def _options(spark: SparkSession, path: str, config: Config | None) -> dict[str, str]:
    spark.dataSource.register(Served)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return {"path": path, "watched": json.dumps([asdict(w) for w in config.watched()] if config else [])}


def served(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """What a folder serves now (columns SERVED): its newest list and all changes after it.

    Kinds, namespaces and selectors of ``config`` are applied where files are read, and so are filters by kind and namespace
    that follow: other files are not opened. A change to an object that a selector leaves out is read as its deletion. A line
    that cannot be read, or an object without name or version, becomes a row UNREADABLE. A folder that serves nothing yet is
    empty. The session's ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    return spark.read.format("served").options(**_options(spark, path, config)).load()


def watched(spark: SparkSession, path: str, config: Config | None = None) -> DataFrame:
    """The same as a stream: at first and after a gap the newest list with the changes after it, else the changes since.

    A batch that is done again after a failure may find a newer list, and so tell of changes that the next batch tells again;
    readers go by ``seq``, as upkeep does.
    """
    return spark.readStream.format("served").options(**_options(spark, path, config)).load()


def marks(rows: DataFrame) -> DataFrame:
    """(kind, namespace, last): the last list of each scope; ``namespace`` is null for all. No more rows than scopes."""
    return rows.where(F.col("op") == LISTED).groupBy("kind", "namespace").agg(F.max("listed").alias("last"))


def with_last_list(rows: DataFrame, lists: DataFrame, column: str = "__last") -> DataFrame:
    """``rows`` with the last list of ``marks`` that covers them, null where none does. Rows stay where they are: by kind, one task would get all."""
    own = F.map_from_entries(F.collect_list(F.when(F.col("namespace").isNotNull(), F.struct("namespace", "last"))))
    scopes = lists.groupBy("kind").agg(F.max(F.when(F.col("namespace").isNull(), F.col("last"))).alias("__whole"), own.alias("__own"))
    found = rows.join(F.broadcast(scopes), "kind", "left")
    return found.withColumn(column, F.greatest("__whole", F.try_element_at("__own", F.col("namespace")))).drop("__whole", "__own")


def since_lists(rows: DataFrame) -> DataFrame:
    """A change log (columns LOG) out of SERVED rows of any number of batches: what the last list of a scope passed over is left out.

    An object's place is its own version, so one that is listed again unchanged is an exact repetition. Unreadable lines
    are left out; ``unreadable`` has them.
    """
    kept = with_last_list(rows.where(~F.col("op").isin(LISTED, UNREADABLE)), marks(rows))
    fresh = F.col("__last").isNull() | (F.col("seq") > F.col("__last")) | F.col("listed").eqNullSafe(F.col("__last"))
    return kept.where(fresh).select(*_COLUMNS[:-1])


def unreadable(rows: DataFrame) -> DataFrame:
    """(kind, namespace, line) of the lines that could not be read."""
    return rows.where(F.col("op") == UNREADABLE).select("kind", "namespace", F.col("object").alias("line"))


def gone(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Deletions (columns LOG) that the lists in ``rows`` imply: objects of ``state`` that a later list of their scope lacks."""
    listed = rows.where(F.col("listed").isNotNull() & F.col("name").isNotNull()).select(*KEY, "listed")
    left = with_last_list(state, marks(rows)).where(F.col("seq") <= F.col("__last"))
    left = left.join(listed.withColumnRenamed("listed", "__last"), [*KEY, "__last"], "left_anti")
    return left.select(*KEY, "uid", F.col("__last").cast("string").alias("rv"), F.lit("DELETED").alias("op"), F.col("__last").alias("seq"), F.lit(None).cast("string").alias("object"))


def serve_list(objects: DataFrame, path: str, version: int, per_file: int = 100_000) -> None:
    """Serves ``objects`` (kind, namespace, object as JSON text) as the list at a version."""
    objects.select("kind", "namespace", F.col("object").alias("value")).write.partitionBy("kind", "namespace").option("maxRecordsPerFile", per_file).text(f"{path}/lists/{version}")


def serve_changes(log: DataFrame, path: str, first: int, last: int, per_file: int = 100_000) -> None:
    """Serves the rows of a change log whose ``seq`` is in a range as the changes of these versions."""
    line = F.concat(F.lit('{"type":"'), "op", F.lit('","object":'), "object", F.lit("}"))
    log.where(F.col("seq").between(first, last)).select("kind", "namespace", line.alias("value")).write.partitionBy("kind", "namespace").option("maxRecordsPerFile", per_file).text(f"{path}/watches/{first}-{last}")
