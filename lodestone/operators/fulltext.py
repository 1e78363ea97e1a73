"""Full-text search: phrase matching and BM25 over chunks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import token_list, tokens

K1, B = 1.2, 0.75
#: Weight of a term that at least half of the chunks have.
LEAST_IDF = 1e-6
#: Query terms that are broadcast at most; more go through a shuffled join.
BROADCAST_TERMS = 100_000
#: Query terms that are pushed down to written postings at most.
PUSHED_TERMS = 10
#: Tokens of a sorted run of postings at most, but one chunk at least; where the places of a path's tokens begin.
RUN_TOKENS = 1 << 20
PATH = 1 << 30


def phrases(query: str) -> list[list[str]]:
    """The terms of a query, each a phrase of adjacent tokens; terms without tokens vanish."""
    return [p for t in query.split() if (p := token_list(t))]


def postings(chunks: DataFrame, *more: str) -> DataFrame:
    """``chunk_id, term, places, dl``: the places of each token of a chunk; dl counts all of them.

    Places in the content count from 0, those in the path from PATH, so tokens of
    the two are never neighbours. ``more`` columns go along. Rows come in runs of at most
    RUN_TOKENS tokens (but whole chunks), each sorted by term: no shuffle, no sort of a whole
    table, and in a Parquet file the pages' statistics skip what a term can't be in."""
    rows = chunks.select(F.col("id").alias("chunk_id"), *more, tokens(F.col("chunk_content")).alias("_c"), tokens(F.col("file_path")).alias("_p"))
    kept = {c: rows.schema[c].dataType.simpleString() for c in ("chunk_id", *more)}

    def inverted(batches):
        for b in batches:
            lists = [b.column(c) for c in ("_c", "_p")]
            ends = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists))
            at = 0
            while at < b.num_rows:
                upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_TOKENS, "right")), at + 1)
                yield _run(b.slice(at, upto - at), list(kept))
                at = upto

    return rows.mapInArrow(inverted, ", ".join(["chunk_id " + kept["chunk_id"], "term string", "places array<int>", "dl int", *(f"{c} {kept[c]}" for c in more)]))


def _run(b: pa.RecordBatch, kept: list[str]) -> pa.RecordBatch:
    """The postings of some chunks, by term and then in the order of the chunks."""
    words, owners, places = [], [], []
    for c, base in (("_c", 0), ("_p", PATH)):
        lists = b.column(c)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words.append(lists.flatten())
        owners.append(np.repeat(np.arange(b.num_rows), sizes))
        places.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + base)
    coded = pa.concat_arrays(words).dictionary_encode()
    by_term = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(by_term), np.int64)
    rank[by_term] = np.arange(len(by_term))
    owner, place = np.concatenate(owners), np.concatenate(places).astype(np.int32)
    key = rank[coded.indices.to_numpy()] * b.num_rows + owner
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    row = owner[order[starts]]
    columns = {
        "term": coded.dictionary.take(pa.array(by_term[key[starts] // max(b.num_rows, 1)])),
        "places": pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(place[order])),
        "dl": pa.array(np.bincount(owner, minlength=b.num_rows)[row].astype(np.int32)),
    }
    first, *more = (b.column(c).take(pa.array(row)) for c in kept)
    return pa.RecordBatch.from_arrays([first, *columns.values(), *more], [kept[0], *columns, *kept[1:]])


def write_postings(chunks: DataFrame, path: str) -> None:
    """Postings as Parquet, in runs that are sorted by term, so page statistics prune."""
    postings(chunks).write.mode("overwrite").parquet(path)


def token_count() -> Column:
    """Tokens of a chunk's content and path."""
    return F.size(tokens(F.col("chunk_content"))) + F.size(tokens(F.col("file_path")))


def corpus_stats(chunks: DataFrame) -> tuple[int, float]:
    """Number of chunks, and mean number of tokens."""
    n, mean = chunks.agg(F.count(F.lit(1)), F.avg(token_count())).first()
    return n, mean or 0.0


def _terms(spark: SparkSession, queries: Sequence[tuple[str, str]]) -> DataFrame:
    """``query_id, n_ords, ord, phrase, off, term, len``: the tokens of all phrases of all queries."""
    rows = []
    for query_id, text in queries:
        split = phrases(text)
        for i, p in enumerate(split):
            rows.extend((query_id, len(split), i, " ".join(p), off, t, len(p)) for off, t in enumerate(p))
    return spark.createDataFrame(rows, "query_id string, n_ords int, ord int, phrase string, off int, term string, len int")


def phrase_hits(index: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """``chunk_id, phrase, hits, dl``: places where a phrase's tokens stand next to each other.

    Postings have the places of a single token already; only those of longer phrases are brought together."""
    wanted = terms.select("phrase", "off", "term", "len").distinct()
    met = index.join(F.broadcast(wanted) if small else wanted, "term")
    single = met.where("len = 1").select("chunk_id", "phrase", F.size("places").alias("hits"), "dl")
    shifted = F.transform("places", lambda p: p - F.col("off"))
    longer = met.where("len > 1").groupBy("chunk_id", "phrase").agg(F.collect_list(shifted).alias("_at"), F.max("len").alias("len"), F.max("dl").alias("dl")).where(F.size("_at") == F.col("len"))
    starts = F.aggregate(F.slice("_at", 2, F.col("len")), F.get("_at", F.lit(0)), F.array_intersect)
    return single.unionByName(longer.select("chunk_id", "phrase", F.size(starts).alias("hits"), "dl").where("hits > 0"))


def fts_match(chunks: DataFrame, queries: Sequence[tuple[str, str]], index: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """``query_id, chunk_id``: chunks that have every term of a query, in content or path."""
    return bm25(chunks, queries, index, stats).select("query_id", "chunk_id")


def bm25(chunks: DataFrame, queries: Sequence[tuple[str, str]], index: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """``query_id, chunk_id, score`` of matching chunks; the more negative the better.

    k1 = 1.2, b = 0.75; both columns count, a query's repeated terms count
    again, and a term in half of the chunks or more weighs LEAST_IDF. A query
    without terms matches nothing. Query terms are broadcast (their number is
    checked) against the tokens, so only hits are shuffled. ``index`` replaces
    tokenising by written postings, of which few terms read few row groups, and
    ``stats``, the number of chunks and their mean number of tokens, counting."""
    spark = chunks.sparkSession
    terms = _terms(spark, queries)
    small = sum(len(phrases(q)) for _, q in queries) <= BROADCAST_TERMS
    n, mean = stats or corpus_stats(chunks)
    if index is None:
        index = postings(chunks)
    elif len(wanted := sorted({t for _, q in queries for p in phrases(q) for t in p})) <= PUSHED_TERMS:
        index = index.where(F.col("term").isin(wanted))
    hits = phrase_hits(index, terms, small)
    df = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("phrase", F.when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    ords = terms.where("off = 0").select("query_id", "n_ords", "ord", "phrase")
    per = hits.join(F.broadcast(ords) if small else ords, "phrase").join(F.broadcast(weights) if small else weights, "phrase")
    f = F.col("hits")
    part = F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0)))
    scored = per.groupBy("query_id", "chunk_id").agg((-F.sum(part)).alias("score"), F.countDistinct("ord").alias("_met"), F.max("n_ords").alias("_all"))
    return scored.where("_met = _all").select("query_id", "chunk_id", "score")


def bm25_topk(chunks: DataFrame, queries: Sequence[tuple[str, str]], k: int = 200, index: DataFrame | None = None, stats: tuple[int, float] | None = None) -> DataFrame:
    """The k best of each query, with their rank; scores that are equal to 9 digits are ties, and go by chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "chunk_id")
    return bm25(chunks, queries, index, stats).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
