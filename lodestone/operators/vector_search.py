"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the vectors; what a pass sends to each task.
BLOCK = 1024
#: Vectors of one matrix product.
ROWS = 4096


def _nearest(m: np.ndarray, v: np.ndarray, k: int) -> Iterator[list[tuple[float, int]]]:
    """For each vector of ``v`` the rows of ``m`` among which its k nearest are, with their distances.

    One matrix product tells which rows can be; only these are measured exactly."""
    mm, vv = (m * m).sum(1), (v * v).sum(1)
    squares = np.maximum(vv[:, None] + mm[None, :] - 2 * (v @ m.T), 0)
    slack = 1e-9 * (vv + mm.max(initial=0))  # more than the product can be off
    for row, own, far in zip(squares, v, slack, strict=True):
        near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + far) if len(row) > k else np.arange(len(row))
        yield [(float(d), int(i)) for d, i in zip(np.sqrt(((m[near] - own) ** 2).sum(1)), near, strict=True)]


def knn(vectors: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, <id>, distance, rank``: the k nearest vectors of each query; distances equal to 9 digits are ties and go by id.

    Each task keeps its own k best of every query, so only those are shuffled;
    queries pass in blocks of BLOCK. Vectors of another length than the query's are
    skipped, and so are null ones."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").cast("array<float>").alias("_v")).where("_v is not null and _id is not null")
    parts = []
    for at in range(0, len(queries), BLOCK):
        block = [(q, np.asarray(v, np.float32).astype(np.float64)) for q, v in queries[at : at + BLOCK]]
        by_size = {n: ([q for q, v in block if len(v) == n], np.stack([v for _, v in block if len(v) == n])) for n in {len(v) for _, v in block}}

        def nearest(batches, block=block, by_size=by_size):
            best: dict[str, list[tuple]] = {q: [] for q, _ in block}
            for b in batches:
                ids = b.column("_id").to_pylist()
                lists = b.column("_v")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    if size not in by_size:
                        continue
                    start = (np.cumsum(sizes) - sizes)[mine]
                    for lo in range(0, len(mine), ROWS):
                        m = flat[start[lo : lo + ROWS, None] + np.arange(size)]
                        for (q, found) in zip(by_size[size][0], _nearest(m, by_size[size][1], k), strict=True):
                            best[q] = sorted([*best[q], *((d, ids[mine[lo + i]]) for d, i in found)], key=lambda x: (round(x[0], 9), x[1]))[:k]
            out = [(q, i, d) for q, found in best.items() for d, i in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([o[2] for o in out])], ["query_id", "_id", "distance"])

        parts.append(rows.mapInArrow(nearest, f"query_id string, _id {id_type}, distance double"))
    if not parts:
        parts = [rows.select(F.lit("").alias("query_id"), "_id", F.lit(0.0).alias("distance")).where("false")]
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "_id")
    found = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("_id").alias(id_col), "distance", "rank")
