"""Hybrid search: BM25 and vector candidates in one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, search_preview, utf16_prefix
from ..functions.vectors import l2_to_cosine
from .fulltext import bm25_topk
from .vector_search import knn

LIMIT, ALPHA, THRESHOLD, TOP_K = 10, 0.4, 0.1, 5


def _scaled(value, query, flip: bool = False):
    """Min-max within a query; 1 where all are equal."""
    low, high = F.min(value).over(query), F.max(value).over(query)
    return F.when(value.isNull(), 0.0).when(high == low, 1.0).otherwise((high - value if flip else value - low) / (high - low))


def boost_term(query: str) -> str | None:
    """The first term of more than one character, lower-cased."""
    return next((t for t in query.lower().split() if len(t) > 1), None)


def filename_boost(path, term, bm25):
    """Half as much again, 1 at most, where the path contains the term."""
    return F.when(F.instr(F.lower(path), term) > 0, F.least(F.lit(1.0), bm25 * 1.5)).otherwise(bm25)


def hybrid_search(
    chunks: DataFrame,
    vectors: DataFrame,
    queries: Sequence[tuple[str, str]],
    query_vectors: Sequence[tuple[str, Sequence[float]]],
    limit: int = LIMIT,
    alpha: float = ALPHA,
    orientation: str = "relevance",
    index: DataFrame | None = None,
    stats: tuple[int, float] | None = None,
) -> DataFrame:
    """The best chunks of each query: ``query_id, rank``, the chunk's columns, ``bm25, vector, hybrid``.

    Candidates are the max(20 limit, 200) best by BM25 and the max(10 limit, 100)
    nearest vectors, joined in full. Both scores are scaled to 0..1 within
    a query, a path that contains the first term raises the first, and hybrid is
    alpha bm25 + (1 - alpha) vector, or bm25 alone where no vector was found.
    Scores of 0 and less are dropped; scores equal to 9 digits are ties and go by
    chunk id. ``index`` and ``stats`` are those of :func:`bm25`.

    ``orientation="relevance"`` scales the best BM25 score to 1;
    ``"reference"`` scales the numbers as they are, the best (most negative) to 0.
    All windows run over candidates only, a few hundred rows a query."""
    lexical = bm25_topk(chunks, queries, max(20 * limit, 200), index, stats).select("query_id", F.col("chunk_id").alias("id"), "score")
    near = knn(vectors, query_vectors, max(10 * limit, 100)).select("query_id", F.col("chunk_id").alias("id"), l2_to_cosine(F.col("distance")).alias("cosine"))
    both = lexical.join(near, ["query_id", "id"], "full")
    # The candidates are a few hundred a query, in any corpus.
    small = len(queries) * (max(20 * limit, 200) + max(10 * limit, 100)) <= 100_000
    found = chunks.join(F.broadcast(both) if small else both, "id")
    query = Window.partitionBy("query_id")
    text, vector = _scaled(F.col("score"), query, flip=orientation == "relevance"), _scaled(F.col("cosine"), query)
    terms = chunks.sparkSession.createDataFrame([(q, boost_term(t)) for q, t in queries], "query_id string, term string")
    scored = found.withColumn("_text", text).withColumn("vector", vector).withColumn("_any", F.count("cosine").over(query) > 0)
    scored = scored.join(F.broadcast(terms) if small else terms, "query_id")
    scored = scored.withColumn("bm25", filename_boost(F.col("file_path"), F.col("term"), F.col("_text")))
    scored = scored.withColumn("hybrid", F.when(F.col("_any"), alpha * F.col("bm25") + (1 - alpha) * F.col("vector")).otherwise(F.col("bm25")))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid", 9)), "id")
    out = scored.where("hybrid > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select("query_id", "rank", "id", "file_path", "chunk_content", "line_start", "line_end", "tokens", "bm25", "vector", "hybrid")


def inject_context(results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``query_id, n_chunks, context``: results of at least the threshold as one block of text a query."""
    fence = "```"
    block = F.concat(
        F.lit("### "), basename(F.col("file_path")), F.lit(" (lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"),
        F.lit(f")\n{fence}\n"), utf16_prefix(F.col("chunk_content"), 600), F.lit(f"\n{fence}"),
    )
    kept = results.where(F.col("hybrid") >= threshold).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list(F.struct("rank", block.alias("text")))).alias("_b"))
    noun = F.when(F.col("n_chunks") == 1, " chunk").otherwise(" chunks")
    head = F.concat(F.lit("The index was searched for the message above, by words and by vectors; "), F.col("n_chunks").cast("string"), noun, F.lit(" may bear on it. They quote indexed files, nobody wrote them for this conversation.\n\n"))
    return kept.select("query_id", "n_chunks", F.concat(head, F.array_join(F.transform("_b", lambda b: b["text"]), "\n\n")).alias("context"))


def query_json(results: DataFrame) -> DataFrame:
    """``query_id, json``: results of each query as a JSON array of file, lines, tokens, scores and preview."""
    fixed = lambda c: F.format_string("%.3f", F.col(c))
    item = F.struct(
        F.col("file_path").alias("file"),
        F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("lines"),
        "tokens",
        F.struct(fixed("bm25").alias("bm25"), fixed("vector").alias("vector"), fixed("hybrid").alias("hybrid")).alias("scores"),
        utf16_prefix(F.col("chunk_content"), 300).alias("preview"),
    )
    ordered = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("_i"))
    return ordered.select("query_id", F.to_json(F.transform("_i", lambda x: x["item"])).alias("json"))


def search_lines(results: DataFrame) -> DataFrame:
    """``query_id, rank, title, preview``: results as two lines of text."""
    title = F.concat(basename(F.col("file_path")), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.format_string("  score=%.2f", F.col("hybrid")))
    return results.select("query_id", "rank", title.alias("title"), search_preview(F.col("chunk_content")).alias("preview"))
