"""What changes in an index: sets of files and rows, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import extension

MAX_AGE_SECONDS = 24 * 3600


def incremental_diff(scanned: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """``path, hash, status`` of scanned files, and their ``size`` if told: ``skipped`` if the index has the same hash,
    embedded, else ``indexed``.

    Unreadable files (null hash) are ``skipped``."""
    known = files.select(F.col("path").alias("_p"), F.col("hash").alias("_h"), F.col("embedded").alias("_e"))
    same = F.coalesce((F.col("hash") == F.col("_h")) & F.col("_e"), F.lit(False)) & F.lit(not force)
    joined = scanned.join(known, F.col("path") == F.col("_p"), "left")
    told = [scanned["size"]] if "size" in scanned.columns else []
    return joined.select("path", "hash", *told, F.when(same | F.col("hash").isNull(), "skipped").otherwise("indexed").alias("status"))


def files_upsert(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files with changed rows in place of old ones of the same path."""
    return files.join(changed.select("path"), "path", "left_anti").unionByName(changed.select(*files.columns))


def files_delete(rows: DataFrame, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows of files that aren't among ``paths``."""
    gone = paths.select(F.col("path").alias("_gone"))
    return rows.join(gone, F.col(path_col) == F.col("_gone"), "left_anti")


def rebuild_target(tracked: DataFrame, indexed: DataFrame, existing: Column, excluded: Column) -> DataFrame:
    """Tracked files with the indexed ones that still exist and aren't excluded."""
    return tracked.select("path").unionByName(indexed.where(existing & ~excluded).select("path")).distinct()


def rebuild_prune(indexed: DataFrame, target: DataFrame) -> DataFrame:
    """Indexed files that are no target."""
    return indexed.select("path").join(target.select("path"), "path", "left_anti")


def rebuild_new(indexed: DataFrame, target: DataFrame) -> DataFrame:
    """Targets that aren't indexed."""
    return target.select("path").join(indexed.select("path"), "path", "left_anti")


def rebuild_mark(files: DataFrame, target: DataFrame) -> DataFrame:
    """Files with ``embedded`` false for targets, so that they are indexed again."""
    marks = target.select(F.col("path").alias("_t")).distinct()
    joined = files.join(marks, F.col("path") == F.col("_t"), "left")
    return joined.withColumn("embedded", F.col("embedded") & F.col("_t").isNull()).drop("_t")


def index_stats(chunks: DataFrame, files: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: ``total_chunks, total_files, total_tokens, embedded_count, coverage`` (percent, rounded)."""
    c = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    counted = [c, files.agg(F.count(F.lit(1)).alias("total_files")), vectors.agg(F.count(F.lit(1)).alias("embedded_count"))]
    # Each side is one row.
    one = counted[0].withColumn("_k", F.lit(1))
    for other in counted[1:]:
        one = one.join(F.broadcast(other.withColumn("_k", F.lit(1))), "_k")
    share = F.when(F.col("total_chunks") == 0, 0).otherwise(F.round(F.col("embedded_count") / F.nullif(F.col("total_chunks"), F.lit(0)) * 100)).cast("int")
    return one.select("total_chunks", "total_files", "total_tokens", "embedded_count", share.alias("coverage"))


def is_stale(last_build: Column, now: Column, max_age: int = MAX_AGE_SECONDS) -> Column:
    """Whether an index is older than ``max_age`` seconds; one that was never built isn't."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_build.cast("timestamp"))
    return F.coalesce(age > max_age * 1_000_000, F.lit(False))


def ext_histogram(files: DataFrame, top: int = 8) -> DataFrame:
    """The most frequent extensions; ties by name."""
    return files.groupBy(extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext").limit(top)
