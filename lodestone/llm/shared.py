"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words are runs of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and its master is local (tests, where all
    is one machine) a temporary folder is used instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _fallback:
        _fallback[key] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _fallback[key]


def _clear() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; the cluster's own cleaning takes over
            return


atexit.register(_clear)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`new_path` as soon as nothing reads it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Folder:
    """A folder of the file systems that Spark reads, for small files of the driver's."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        at = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Write a file that must not exist yet; readers see all of it or nothing."""
        draft, target = self._path(f"{self.root}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise FileExistsError(f"{self.root}/{name} was written by another")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """Like :func:`written`, in buckets of a column: joins by it move the other side only. To be given to :func:`forget`."""
    spark, table = df.sparkSession, f"lodestone_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    df.write.bucketBy(partitions(spark), column).sortBy(column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stored, out._table = path, table
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what was written for these frames: nothing reads them any more."""
    for df in frames:
        if table := df.__dict__.pop("_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := df.__dict__.pop("_stored", None):
            drop_path(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id, written as text, is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
