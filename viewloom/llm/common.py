"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: ASCII white space: what separates words in every contract of this package.
SPACE = " \t\n\x0b\x0c\r"
#: A word, as a pattern that Java and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_folder: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints.

    Only a session on one machine, as in tests, may lack the setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="viewloom-"))
    return f"file://{_own_folder[0]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/viewloom/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # once the table is written, nothing needs the shuffle files of its making
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` made and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def ranked(df: DataFrame, group: str, order: list[str], label: str, name: str = "place") -> DataFrame:
    """``df``, written to the shared folder, with the place of each row in its group, from 0, by ``order``; the group has no nulls.

    Rows are dealt by ranges of group and order, so a group of any size is spread; a task numbers its own rows. Only a
    group that goes on from one task to the next needs an offset: at most one for each task, so they are broadcast.
    """
    out = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__own", LongType())])
    arrow, at = to_arrow_schema(out), df.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at)
            new = np.concatenate(([True], pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            own = np.arange(n) - first
            if keys[0].as_py() == last:
                own[first == 0] += seen
            last, seen = keys[n - 1].as_py(), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(own)], schema=arrow)

    held = stored(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(number, out), label)
    sizes = held.groupBy(group, "__part").agg((F.max("__own") + 1).alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__skip", F.sum("__n").over(before)).where("__skip is not null").select(group, "__part", "__skip")
    return held.join(F.broadcast(offsets), [group, "__part"], "left").withColumn(name, F.col("__own") + F.coalesce("__skip", F.lit(0))).select(*df.columns, name)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text): other columns, whatever their names, cannot clash with what operators add."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def over_texts(docs: DataFrame, fn: Callable[[list, list], list], schema: str, *, size: int = 512) -> DataFrame:
    """``fn(ids, texts as bytes)`` over small batches of (doc_id, text); it returns the columns of ``schema``.

    Null texts arrive as None. A batch has at most ``size`` rows, so memory follows the longest texts only.
    """
    ddl = StructType.fromDDL(schema)
    out = to_arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column(0).to_pylist()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                columns = fn(ids, texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return docs.mapInArrow(run, ddl)


def runs(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``: at least ``rows`` rows each, but for the last.

    A group longer than that is held together, so callers bound their groups.
    """
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, n = [table], table.num_rows
        rows = max(rows, 2 * n) if not cut else rows
    if held:
        yield pa.concat_tables(held).combine_chunks()


def held_out(id_col: Column) -> Column:
    """True for the rows whose labels are for testing only: crc32(id as text) mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokenizer_file(name_or_path: str) -> str:
    """The place of a public tokenizer's file: a path, or a name that ``public_tokenizers`` knows."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)
