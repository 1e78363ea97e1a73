"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, partitions

#: Characters of the content that splitters hold; bounds what sampling sends to the driver.
SPLITTER_CHARS = 24
#: A text is hot when it fills more than 1/HOT_SHARE of an even partition's rows.
HOT_SHARE = 4


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Group rows whose texts are equal after lower-casing A-Z.

    Method: sampled splitters range-partition the rows by content (a prefix of
    the normalised text, then its hash), an external sort inside each range
    places equal texts next to each other, and a window over the full
    normalised text compares neighbours. Of equal texts the smallest identifier
    stays (``keep="min"``) or the largest (``keep="max"``).

    A text that fills a large part of a partition is sorted in several salted
    runs; the number of salts follows its exact row count, and the heads of
    the runs are compared in full afterwards. Rows are dealt to salts by their
    place, so repeated and null identifiers spread too. The list of such texts has
    at most HOT_SHARE rows for each shuffle partition, so it is broadcast.

    Returns for each input row the columns ``carry``, then ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text, UTF-8);
    the identifier comes first if ``carry`` does not name it.

    Defined cases: a null text equals an empty one. Null identifiers lose to all
    others; a group of null identifiers only has a null ``keep_id``. Of rows with
    equal text and equal identifier one is ``kept``. An empty table gives an
    empty result. Columns not in ``carry`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    carried = list(carry) if id_col in carry else [id_col, *carry]
    names = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*carried, text_col]))}
    rid, text = names[id_col], F.coalesce(F.col(names[text_col]), F.lit(""))
    norm = ascii_lower(text)
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()))
    rows = rows.withColumn("_h", F.xxhash64(norm))

    n_rows = docs.count()
    per_part = max(1.0, n_rows / (HOT_SHARE * n_parts))
    hot = (
        rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > F.lit(max(per_part, 8.0)))
        .select("_h", F.ceil(F.col("_n") / F.lit(per_part)).cast("long").alias("_salts"))
    )
    run_key = ["_p", "_h", "_salt"]
    placed = (
        rows.join(F.broadcast(hot), "_h", "left")
        .withColumn("_p", F.substring(norm, 1, SPLITTER_CHARS))
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_salts")), F.lit(-1)))
        .drop("_salts")
        .repartitionByRange(n_parts, *run_key)
        .withColumn("_norm", norm)
    )
    best = F.col(rid).desc_nulls_last() if keep == "max" else F.col(rid).asc_nulls_last()
    pick = F.max if keep == "max" else F.min
    equal = Window.partitionBy(*run_key, "_norm")
    runs = placed.select(
        *names.values(), "_h", "_salt",
        F.row_number().over(equal.orderBy(best)).alias("_rank"),
        pick(rid).over(equal).alias("_keep"),
        F.count(F.lit(1)).over(equal).alias("_size"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        "_norm",
    )
    # The heads of a hot text's runs, compared in full: only hot rows are sorted for this.
    alone = F.col("_keep").isNull()
    order = F.struct(~alone, "_keep", F.negate("_salt")) if keep == "max" else F.struct(alone, "_keep", "_salt")
    merged = (
        runs.where((F.col("_salt") >= 0) & (F.col("_rank") == 1))
        .groupBy("_h", "_norm")
        .agg(
            pick("_keep").alias("_all_keep"), F.sum("_size").alias("_all_size"), F.collect_list(F.struct("_salt", "_sha")).alias("_runs"),
            (F.max_by if keep == "max" else F.min_by)("_salt", order).alias("_first"),
        )
        .select("_h", "_all_keep", "_all_size", "_first", F.explode("_runs").alias("_run"))
        .select("_h", F.col("_run._salt").alias("_salt"), F.col("_run._sha").alias("_sha"), "_all_keep", "_all_size", "_first", F.lit(True).alias("_hot"))
    )
    out = runs.join(F.broadcast(merged), ["_h", "_salt", "_sha"], "left")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    keep_id = F.when(is_hot, F.col("_all_keep")).otherwise(F.col("_keep"))
    return out.select(
        *(F.col(names[c]).alias(c) for c in carried),
        keep_id.alias("keep_id"),
        F.when(is_hot, F.col("_all_size")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_rank") == 1) & (~is_hot | (F.col("_salt") == F.col("_first")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
