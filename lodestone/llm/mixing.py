"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WORD, written

#: Sources whose totals the driver may hold; more is an error, never a cut.
MAX_SOURCES = 1_000_000
#: Bins of the Pareto order in which words are summed before the cut is placed.
BINS = 1 << 16


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Target of each source: ``share`` of all words, dealt by weight; no target
    exceeds ``cap`` times its source, and the excess is dealt again by weight.

    ``sizes`` is in order of source; weights repeat over it."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    most = [cap * s for _, s in sizes]
    target = [0.0] * len(sizes)
    left, open_ = share * sum(s for _, s in sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if w[i] * left / total > most[i]]
        if not over:
            for i in open_:
                target[i] = w[i] * left / total
            break
        for i in sorted(over):
            target[i] = float(most[i])
        left -= sum(most[i] for i in over)
        open_ -= set(over)
    return target


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """How often each document enters a mix in which every source has its target.

    Sources by code point, null last, weigh ``weights``, repeating. A source
    with target T and S words takes each document floor(T/S) times for certain.
    The R words left are a Pareto order sample of one more copy: a document of s
    words has the inclusion probability p = min(1, c s), with c such that the
    expected words, the sum of p s, are R; documents with p = 1 are certain too.
    All are ranked by the Pareto value, the random odds u/(1-u) (u is a hash of
    the identifier) over the inclusion odds p/(1-p), and taken in that order up
    to the sample's fixed size, which is counted in words: the place nearest to R.

    c comes from the counts of the distinct sizes of a source. The place of the
    cut is found from sums over fixed bins of the order; only the rows of the one
    bin that holds it are sorted, so no source, however large, is sorted or held
    by one task.

    Returns id, ``size``, ``source``, ``source_size``, ``target``, ``copies``,
    ``probability`` (of the sampled copy), ``taken``.

    Defined cases: a null or blank text has size 0, probability 0 and takes 0; a
    null source is a source of its own; a source without words has target 0; null
    identifiers share one u, and tied rows are taken in order of size, then
    identifier; equal rows each get a row. More than MAX_SOURCES sources raise an
    error. Rows, their order and the partitioning do not matter to the result.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = written(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), size.alias("_size"), u.alias("_u")), "mix-sizes")

    totals = rows.groupBy("_source").agg(F.sum("_size").alias("_s")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r[0], int(r[1])) for r in totals), key=lambda r: (r[0] is None, r[0] or ""))
    targets = source_targets(totals, weights, share, cap)
    plan = []
    for (source, s), t in zip(totals, targets, strict=True):
        whole = int(t // s) if s else 0
        plan.append((source, s, t, whole, t - whole * s))
    schema = T.StructType([
        T.StructField("_source", T.StringType()), T.StructField("_s", T.LongType()), T.StructField("_t", T.DoubleType()),
        T.StructField("_whole", T.LongType()), T.StructField("_need", T.DoubleType()),
    ])
    by_source = spark.createDataFrame(plan, schema)

    def of_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("_source", "_key")
        right = F.broadcast(right) if len(plan) <= 10_000 else right
        return left.join(right, left["_source"].eqNullSafe(right["_key"]), "left").drop("_key")

    # The rate c of each source: with all sizes over s certain, c = (R - their words) / sum of the other sizes squared;
    # the largest s with c s < 1 is where certainty ends. Sums are exact, so their order doesn't matter.
    sizes = rows.where("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    words, squares = F.col("_n") * F.col("_size"), (F.col("_n") * F.col("_size")).cast("decimal(38,0)") * F.col("_size")
    larger = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("_source").orderBy(F.desc("_size")).rowsBetween(0, Window.unboundedFollowing)
    rate = (F.col("_need") - F.coalesce(F.sum(words).over(larger), F.lit(0))) / F.sum(squares.cast("decimal(38,0)")).over(rest).cast("double")
    rates = of_source(sizes, by_source).where("_need > 0").select("_source", "_size", rate.alias("_c")).where(F.col("_c") * F.col("_size") < 1)
    rates = rates.groupBy("_source").agg(F.max_by("_c", "_size").alias("_c"))

    chance = F.when(F.col("_size") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("_c"), F.lit(0.0)) * F.col("_size")))
    odds = F.col("_u") / (1 - F.col("_u"))
    # With p = 0 nothing more is taken; else Q in [0, inf), and Q/(1+Q) in [0, 1).
    q = F.when(F.col("_p") > 0, odds * (1 - F.col("_p")) / F.col("_p"))
    ranked = of_source(of_source(rows, by_source), rates).withColumn("_p", chance).withColumn("_q", q).withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS))
    sums = ranked.where(F.col("_q").isNotNull()).groupBy("_source", "_bin").agg(F.sum("_size").alias("_in_bin"), F.first("_need").alias("_need"))
    cum = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sums.withColumn("_cum", F.sum("_in_bin").over(cum))
        .where(F.col("_cum") >= F.col("_need"))
        .groupBy("_source")
        .agg(F.min("_bin").alias("_cut"), F.min_by(F.col("_cum") - F.col("_in_bin"), "_bin").alias("_before"))
    )
    placed = of_source(ranked, cut)
    inner = Window.partitionBy("_source").orderBy("_q", "_size", "_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = placed.where(F.col("_bin") == F.col("_cut")).withColumn("_sum", F.col("_before") + F.sum("_size").over(inner))
    at_cut = at_cut.withColumn("_extra", (F.col("_sum") - F.col("_size") / 2 <= F.col("_need")).cast("long")).drop("_sum")
    rest = placed.where(~F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False)))
    rest = rest.withColumn("_extra", F.when(F.col("_q").isNotNull() & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))), 1).otherwise(0).cast("long"))
    copies = F.col("_whole") + F.col("_extra")
    return at_cut.unionByName(rest).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_source").alias("source"),
        F.col("_s").alias("source_size"),
        F.col("_t").alias("target"),
        copies.alias("copies"),
        F.col("_p").alias("probability"),
        (copies * F.col("_size")).alias("taken"),
    )
