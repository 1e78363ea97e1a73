"""Import of an index kept as one JSON file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = "struct<id: string, file: string, content: string, lineStart: int, lineEnd: int, hash: string, indexed: string, tokens: int, vector: array<float>>"
_FILE = "struct<hash: string, chunks: int, indexed: string, size: bigint, embedded: boolean>"
SCHEMA = f"chunks array<{_CHUNK}>, files map<string, {_FILE}>, lastBuild string, embeddingModel string"


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """One row of SCHEMA; malformed JSON gives no row."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def legacy_tables(index: DataFrame, dim: int) -> dict[str, DataFrame]:
    """Tables ``chunks``, ``vectors`` (those of ``dim`` numbers) and ``files``."""
    c = index.select(F.explode("chunks").alias("c"))
    chunks = c.select(
        "c.id", F.col("c.file").alias("file_path"), F.col("c.content").alias("chunk_content"), F.col("c.lineStart").alias("line_start"), F.col("c.lineEnd").alias("line_end"),
        F.col("c.hash").alias("chunk_hash"), F.try_to_timestamp("c.indexed").alias("indexed_at"), "c.tokens",
    )
    vectors = c.where(F.size("c.vector") == dim).select(F.col("c.id").alias("chunk_id"), F.col("c.vector").alias("embedding"))
    f = index.select(F.explode("files").alias("path", "f"))
    files = f.select("path", "f.hash", "f.chunks", F.try_to_timestamp("f.indexed").alias("indexed"), "f.size", F.coalesce("f.embedded", F.lit(False)).alias("embedded"))
    return {"chunks": chunks, "vectors": vectors, "files": files}
