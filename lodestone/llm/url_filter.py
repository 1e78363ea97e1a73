"""URL filters: a blocked Bloom filter before an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .shared import ascii_lower

#: Words of 64 bits in a block; a key sets one bit in each.
BLOCK = 4
#: Bits of the filter for each key, before rounding up to a power of two of blocks: the filter grows with the list.
BITS_A_KEY = 16
#: Most blocks of a filter that is broadcast (2.5 MB); a larger one is dealt by block, and the keys go to their blocks.
BROADCAST_BLOCKS = 1 << 16


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rules as a table."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _mask(h: Column, j: int) -> Column:
    """One of 64 bits, named by six bits of the hash."""
    at = F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _hashes(host: Column, path: Column, n_blocks: int) -> tuple[Column, Column]:
    """The block of a key, and the hash that names its bits."""
    h = F.xxhash64(host, path)
    return F.pmod(h, F.lit(n_blocks)), F.xxhash64(h)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The blocked filter of ``listed`` (host, path): a row for each block that has bits."""
    block, g = _hashes(F.col("host"), F.col("path"), n_blocks)
    return listed.select(block.alias("_block"), g.alias("_g")).groupBy("_block").agg(
        *(F.bit_or(_mask(F.col("_g"), j)).alias(f"_w{j}") for j in range(BLOCK))
    )


def block_count(n_keys: int) -> int:
    """Blocks of a filter of so many keys: a power of two with BITS_A_KEY bits for each."""
    n = 1
    while n * BLOCK * 64 < BITS_A_KEY * n_keys:
        n *= 2
    return n


def possible(keys: DataFrame, listed: DataFrame, n_blocks: int) -> DataFrame:
    """Rows of ``keys`` (host, path, ...) that the filter of ``listed`` lets pass: all that are listed, and few others."""
    block, g = _hashes(F.col("host"), F.col("path"), n_blocks)
    blocks = bloom_blocks(listed, n_blocks)
    hits = keys.withColumns({"_block": block, "_g": g}).join(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks, "_block")
    for j in range(BLOCK):
        hits = hits.where(F.col(f"_w{j}").bitwiseAND(_mask(F.col("_g"), j)) != 0)
    return hits.select(*keys.columns)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each url by a list of ``verdict, host, path`` rules.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path goes on up to ``?`` or ``#``. A rule fits its
    host and all subdomains of it if the path starts with the rule's. The
    longest rule (host and path together) wins; block wins over allow for the
    same host and path. Where none fits, ``default`` holds.

    Each url gives the keys under which a rule that fits must be listed: suffixes
    of its host at dots, with prefixes of its path of the lengths that occur in
    the list. A blocked Bloom filter, as large as the list needs, drops nearly
    all keys that aren't listed; what passes meets the list in an exact join, by
    distinct host and path. Of the list, its size and the distinct lengths of its
    paths (at most the longest path) come to the driver.

    Returns id, host, path, ``rule`` (host and path joined, else null), ``verdict``.

    Defined cases: a null url, or one without ``://``, has an empty host and path
    and the default verdict; a host that is empty fits no rule. Equal rows each
    get a row. Rules with a null field, and rules with an empty host, are ignored.
    """
    words_of = rules.where("verdict is not null and path is not null and host != ''").select("verdict", ascii_lower(F.col("host")).alias("host"), "path")
    listed = words_of.groupBy("host", "path").agg(F.max("verdict").alias("_verdict"))  # block sorts after allow
    facts = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    rows = pages.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("_url"))
    rows = rows.withColumn("_at", F.instr("_url", "://"))
    rows = rows.withColumn("_rest", F.when(F.col("_at") > 0, F.expr("substring(_url, _at + 3)")).otherwise(""))
    rows = rows.withColumn("_raw", F.regexp_extract("_rest", "^[^/?#]*", 0))
    rows = rows.select("_id", ascii_lower(F.col("_raw")).alias("_host"), F.regexp_extract(F.expr("substring(_rest, length(_raw) + 1)"), "^[^?#]*", 0).alias("_path"))
    if not facts["n"]:
        return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    n_blocks = block_count(facts["n"])
    lengths = ", ".join(str(n) for n in sorted(facts["lengths"]))
    keys = F.expr(
        "flatten(transform(sequence(1, size(split(_host, '[.]'))), i -> "
        f"transform(filter(array({lengths}), n -> n <= length(_path)), n -> "
        "named_struct('host', array_join(slice(split(_host, '[.]'), i, size(split(_host, '[.]'))), '.'), 'path', left(_path, n)))))"
    )
    hits = rows.where("_host != ''").withColumn("_key", F.explode(keys)).select("_host", "_path", F.col("_key.host").alias("host"), F.col("_key.path").alias("path"))
    hits = possible(hits, listed, n_blocks).distinct()
    found = hits.join(listed, ["host", "path"]).groupBy("_host", "_path").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "_verdict"), F.struct(F.length("host") + F.length("path"), F.length("host"))).alias("_best")
    )
    found = found.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), F.lit(0).cast("long").alias("_s"), "_best")
    # Urls without a host match nothing: they are spread, not sent to one task as one key.
    rows = rows.withColumn("_salt", F.when(F.col("_host") == "", F.xxhash64("_id").bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    out = rows.join(found, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")) & (F.col("_salt") == F.col("_s")), "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best._verdict"), F.lit(default)).alias("verdict"),
    )
