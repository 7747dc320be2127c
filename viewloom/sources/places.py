"""Where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a session on one machine may lack it; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="viewloom-"))
    return f"file://{_own_folder[0]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, however often it is read, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/viewloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any file system that Spark reads, by paths inside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")

    def path(self, inside: str) -> str:
        return f"{self.root}/{inside}"

    def _at(self, inside: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(inside))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, inside: str) -> bool:
        path, files = self._at(inside)
        return files.exists(path)

    def names(self, inside: str) -> list[str]:
        """What stands in a folder inside, in order; nothing if there is none."""
        path, files = self._at(inside)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def text(self, inside: str) -> str:
        """What a small file says."""
        path, files = self._at(inside)
        stream = files.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, inside: str, text: str) -> bool:
        """Puts a small file where none stands yet, whole or not at all; False if another writer was first."""
        jvm = self.spark._jvm
        own, files = self._at(f"staged/{uuid.uuid4().hex}")
        target, _ = self._at(inside)
        files.mkdirs(target.getParent())
        stream = files.create(own, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), conf).rename(own, target, plain)
        except Py4JJavaError as error:
            files.delete(own, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, inside: str) -> None:
        path, files = self._at(inside)
        files.delete(path, True)
