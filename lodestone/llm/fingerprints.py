"""Fingerprints that several documents share, found without a row for each.

Tasks send sorted arrays of fingerprints, one row for each bucket of them; the
JVM moves a few large rows, numpy does the merging. A fingerprint that two
documents of one task share is sent once and marked, so one that is everywhere
arrives once for each task, not once for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Slice, run_bounds, slices, trim
from .shared import partitions

#: Fingerprints that a task gathers before it sends them.
FLUSH = 1 << 19
#: Buckets for each shuffle partition, so that buckets even out.
BUCKETS_A_PARTITION = 4
#: In place of a document: several have it, and they know.
SEVERAL = -1

RUN_SCHEMA = "part int, id long, keys binary, docs binary"

Fingerprinter = Callable[[Slice], tuple[np.ndarray, np.ndarray]]


def pack(x: np.ndarray) -> bytes:
    """Integers as what they exceed their least by, in as few bytes each as that needs."""
    x = x.astype(np.int64)
    base = int(x.min()) if len(x) else 0
    kind = np.min_scalar_type(int(x.max()) - base) if len(x) else np.dtype(np.uint8)
    return base.to_bytes(8, "little", signed=True) + bytes([kind.itemsize]) + (x - base).astype(kind).tobytes()


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """The n integers that :func:`pack` put first in ``raw``, and the bytes they took."""
    base, size = int.from_bytes(memoryview(raw)[:8], "little", signed=True), memoryview(raw)[8]
    return np.frombuffer(raw, f"<u{size}", n, 9).astype(np.int64) + base, 9 + size * n


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers by byte, the highest first: the high ones come in runs, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T[::-1]).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1)[::-1].T).view("<u4").ravel()


def bucket_count(spark: SparkSession) -> int:
    return BUCKETS_A_PARTITION * partitions(spark)


def keyed(fp: np.ndarray, buckets: int) -> np.ndarray:
    """A fingerprint as bucket (high half) and its own high bits (low half)."""
    return ((fp % np.uint64(buckets)) << np.uint64(32)) | (fp >> np.uint64(32))


def _hit_rows(ids: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple]:
    """A row for each document: its keys that are shared, as they become known."""
    order = np.argsort(ids, kind="stable")
    ids, keys = ids[order], keys[order]
    bounds = run_bounds(ids)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        doc = int(ids[lo])
        yield doc % buckets, doc, keys[lo:hi].tobytes(), None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    part, ids, keys, docs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(docs, pa.binary())], ["part", "id", "keys", "docs"])


def _in_batches(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += len(r[2]) + len(r[3] or b"") + 64
        if weight > size:
            yield _batch(held)
            held, weight = [], 0
    if held:
        yield _batch(held)


def _flush(ids: np.ndarray, fps: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of one task: what single documents have, by bucket, and what several have."""
    key = keyed(fps, buckets)
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[new], ids[new]
    bounds = run_bounds(key)
    size = np.diff(bounds)
    several = np.repeat(size > 1, size)
    yield from _hit_rows(ids[several], key[several], buckets)
    first = bounds[:-1]
    yield from run_rows(key[first], np.where(size > 1, SEVERAL, ids[first]))


def run_rows(key: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    """Sorted keys and their documents as a row for each bucket."""
    part = (key >> np.uint64(32)).astype(np.int64)
    bounds = run_bounds(part)
    low = key.astype(np.uint32)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(part[lo]), None, _planes(low[lo:hi]), pack(ids[lo:hi])


def fingerprint_rows(docs: DataFrame, fingerprints: Fingerprinter, buckets: int, overlap: int | None = None) -> DataFrame:
    """Rows of RUN_SCHEMA of a frame ``_id long, _text string``.

    Rows with an id say which keys of that document are known to be shared; the
    others hold, for a bucket, sorted keys and the document of each, or SEVERAL.
    Rows with a null id have no fingerprints. With an ``overlap`` (in bytes), long
    documents come to ``fingerprints`` in pieces."""

    def tell(batches):
        ids, fps, size = [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for s in slices(b.column("_text"), overlap=overlap):
                d, fp = fingerprints(s)
                ids.append(own[s.first + d])
                fps.append(fp)
                size += len(fp)
                if size >= FLUSH:
                    yield from _in_batches(_flush(np.concatenate(ids), np.concatenate(fps), buckets))
                    ids, fps, size = [], [], 0
        if size:
            yield from _in_batches(_flush(np.concatenate(ids), np.concatenate(fps), buckets))
        trim()

    return docs.where(F.col("_id").isNotNull()).select("_id", "_text").mapInArrow(tell, RUN_SCHEMA)


def run_entries(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The bucket of a table of RUN_SCHEMA, and the keys and documents of its runs."""
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    part = int(table.column("part")[0].as_py()) if table.num_rows else 0
    for k, d in zip(table.column("keys"), table.column("docs"), strict=True):
        if d.is_valid:
            keys.append(_from_planes(k.as_buffer()).astype(np.uint64))
            docs.append(unpack(d.as_buffer(), len(keys[-1]))[0])
    return part, (np.uint64(part) << np.uint64(32)) | np.concatenate(keys), np.concatenate(docs)


def merge_rows(rows: DataFrame, buckets: int, keep_runs: bool = False) -> DataFrame:
    """Merge the rows of each bucket: newly shared keys go to their documents.

    Returns rows of RUN_SCHEMA: hits (with an id) and, if ``keep_runs``, one
    merged run for each bucket."""

    def merge(table: pa.Table) -> pa.Table:
        out = []
        part, key, ids = run_entries(table)
        out.extend((part, i, k, None) for i, k in zip(table.column("id").to_pylist(), table.column("keys").to_pylist(), strict=True) if i is not None)
        if len(key):
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            bounds = run_bounds(key)
            first, last = bounds[:-1], bounds[1:] - 1
            shared = (ids[first] != ids[last]) | (ids[first] == SEVERAL)
            mine = np.repeat(shared, np.diff(bounds)) & (ids != SEVERAL)
            out.extend(_hit_rows(ids[mine], key[mine], buckets))
            if keep_runs:
                out.extend(run_rows(key[first], np.where(shared, SEVERAL, ids[first])))
        return pa.Table.from_batches([_batch(out)]) if out else pa.Table.from_arrays([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())], ["part", "id", "keys", "docs"])

    return rows.groupBy("part").applyInArrow(merge, RUN_SCHEMA)


def hits_by_document(hits: DataFrame) -> DataFrame:
    """``_hit long, _keys array<binary>``: the shared keys of each document."""
    return hits.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("_hit")).agg(F.collect_list("keys").alias("_keys"))


def shared_fingerprints(docs: DataFrame, fingerprints: Fingerprinter, buckets: int, overlap: int | None = None) -> DataFrame:
    """``_hit, _keys`` of each document of ``docs`` (``_id long, _text``) that shares a fingerprint with another."""
    return hits_by_document(merge_rows(fingerprint_rows(docs, fingerprints, buckets, overlap), buckets))


def joined_keys(keys) -> np.ndarray:
    """The keys of one document, sorted, from its list of arrays."""
    return np.sort(np.frombuffer(b"".join(k for k in keys), np.uint64))


def is_key(key: np.ndarray, doc: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Which ``key`` is among ``keys[doc]``; ``doc`` is in order."""
    out = np.zeros(len(key), bool)
    bounds = np.searchsorted(doc, np.arange(len(keys) + 1))
    for i, mine in enumerate(keys):
        lo, hi = bounds[i], bounds[i + 1]
        if hi > lo and len(mine):
            at = np.minimum(np.searchsorted(mine, key[lo:hi]), len(mine) - 1)
            out[lo:hi] = mine[at] == key[lo:hi]
    return out


#: Places handled at once by :func:`window_minimizers`.
_CHUNK = 1 << 20


def window_minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of ``w`` values the place of its least one, the last of equals.

    The same values give the same choice wherever they stand."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    low = np.uint64(_CHUNK - 1)
    for a in range(0, n, _CHUNK - w):
        b = min(a + _CHUNK - w, n)
        part = h[a : b + w - 1]
        m = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        size = 1
        while size * 2 <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        out[a:b] = a + (low - (m & low)).astype(np.int64)
    return out
