"""Substring deduplication with suffixes sorted column by column."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import RUN_SCHEMA, _in_batches, bucket_count, is_key, joined_keys, keyed, pack, run_bounds, shared_fingerprints, unpack, window_minimizers
from .grid import Slice, byte_grams_hash, mix, slices, trim
from .shared import new_path

#: Length of the repeated byte strings.
LENGTH = 50
#: Bytes of the grams that pick a string's anchor.
GRAM = 20
#: Bytes of columns that a bucket keeps in memory; more go to a sequential file in the shared folder.
IN_MEMORY = 64 << 20
#: Spans that a task gathers before it sends them.
FLUSH = 1 << 17
#: Bytes of text that are handled at once; longer documents come in overlapping pieces.
PIECE = 1 << 18

def packed(raw: bytes) -> bytes:
    """Spans move compressed: they overlap, and the shuffle's own codec is a light one."""
    return pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(raw: pa.Buffer, size: int) -> pa.Buffer:
    return pa.Codec("zstd").decompress(raw, size)


def _anchors(s: Slice, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, document, anchor place and anchor hash of every byte string of ``length``."""
    n = len(s.buf) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    h = byte_grams_hash(s.buf, gram)
    place = window_minimizers(h, length - gram + 1)
    room = np.maximum(np.diff(s.offs) - length + 1, 0)  # strings of each document
    doc = np.repeat(np.arange(s.n), room)
    start = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room) + np.repeat(s.offs[:-1], room)
    place = place[start]
    return start, doc, place, h[place]


def column_sort(columns: Iterator[np.ndarray], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a collection, built by inserting one symbol of each document a round.

    ``columns`` gives the symbols of all documents, from the last place to the
    first. Each round yields the documents in the order of their suffixes from
    that place, and the common prefix of each with the one before it (up to 255).

    The symbols of a column, taken in the order so far, are the new part of the
    collection's Burrows-Wheeler transform; sorting them by symbol, stably, is
    the step to the next order. Neighbours with the same symbol have one more
    symbol in common than the least common prefix between their old places;
    others have none."""
    order = np.arange(n)
    common = np.full(n, 0, np.uint8)
    first = True
    for column in columns:
        bwt = column[order]
        step = np.argsort(bwt, kind="stable")
        symbol = bwt[step]
        same = np.zeros(n, bool)
        same[1:] = symbol[1:] == symbol[:-1]
        if first:
            common = same.astype(np.uint8)
            first = False
        else:
            # Least of common[u + 1 .. v] for old places u < v, by a table of powers of two.
            table = [common]
            size = 1
            while size * 2 <= n:
                table.append(np.minimum(table[-1][:-size], table[-1][size:]))
                size *= 2
            at = np.flatnonzero(same)
            lo, hi = step[at - 1] + 1, step[at] + 1
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            least = np.empty(len(at), np.uint8)
            for k in np.unique(level):
                mine = level == k
                least[mine] = np.minimum(table[k][lo[mine]], table[k][hi[mine] - (1 << int(k))])
            common = np.zeros(n, np.uint8)
            common[at] = np.minimum(least, 254) + 1
        order = order[step]
        yield order, common


def _columns(rows: np.ndarray, folder: str | None) -> Iterator[np.ndarray]:
    """Columns of a matrix, last first; those of a large one pass through a sequential file in ``folder``."""
    if rows.nbytes <= IN_MEMORY or folder is None:
        for c in range(rows.shape[1] - 1, -1, -1):
            yield np.ascontiguousarray(rows[:, c])
        return
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    path = f"{path}/{uuid.uuid4().hex}"
    n, width = rows.shape
    with fs.open_output_stream(path) as out:
        for c in range(width - 1, -1, -1):
            out.write(np.ascontiguousarray(rows[:, c]))
    del rows
    with fs.open_input_stream(path) as spool:
        for _ in range(width):
            yield np.frombuffer(spool.read(n), np.uint8)
    fs.delete_file(path)


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, first and last of the runs of consecutive starts."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return doc[first], start[first], start[last]


def range_rows(doc: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int = 1) -> Iterator[tuple]:
    """A row of RUN_SCHEMA for each document, spread over buckets: pairs of first and last starts. ``doc`` is in order."""
    bounds = run_bounds(doc)
    pairs = np.stack([first, last], 1).astype(np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(doc[lo]) % buckets, int(doc[lo]), pairs[lo:hi].tobytes(), None


def repeated_strings(rows: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, reach: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts of the strings that also start in a smaller document.

    Row i is the text around an anchor at column ``reach``; its strings start
    at columns ``low[i]`` to ``high[i]``, and column ``reach`` is place ``at[i]``
    of document ``doc[i]``. Equal strings have the same column, so each round of
    the column sort settles the strings that start there."""
    n, width = rows.shape
    docs, starts = [], []
    for c, (order, common) in zip(range(width - 1, -1, -1), column_sort(_columns(rows, folder), n), strict=True):
        if c > reach:
            continue
        group = np.cumsum(common < length)
        live = (low[order] <= c) & (c <= high[order])
        who, group = order[live], group[live]
        if not len(who):
            continue
        bounds = run_bounds(group)
        least = np.minimum.reduceat(doc[who], bounds[:-1])
        gone = doc[who] > np.repeat(least, np.diff(bounds))
        docs.append(doc[who][gone])
        starts.append(at[who][gone] + (c - reach))
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none, none
    return _ranges(np.concatenate(docs), np.concatenate(starts))


def _spans(s: Slice, keys: list[np.ndarray], buckets: int, length: int, gram: int) -> dict[str, np.ndarray]:
    """Spans of text around the anchors that are shared: key, document, anchor place, first and last column of starts, text."""
    reach = length - gram
    start, doc, place, h = _anchors(s, length, gram)
    key = keyed(h, buckets)
    hit = is_key(key, doc, keys)
    start, doc, place, key = start[hit], doc[hit], place[hit], key[hit]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(start) else first
    low, high = start[first] - place[first] + reach, start[last] - place[first] + reach
    width = reach + length
    col = np.arange(width)
    from_ = place[first] - reach
    idx = np.clip(from_[:, None] + col, 0, max(len(s.buf) - 1, 0))
    text = np.where((col >= low[:, None]) & (col < high[:, None] + length), s.buf[idx] if len(first) else np.zeros((0, width), np.uint8), 0).astype(np.uint8)
    return {"key": key[first], "doc": doc[first], "at": place[first] - s.offs[doc[first]] + s.base, "low": low.astype(np.uint8), "high": high.astype(np.uint8), "text": text}


def _span_rows(part: dict[str, np.ndarray], length: int, buckets: int) -> Iterator[tuple]:
    """Rows of one task's spans: settled copies as ranges, the rest by bucket."""
    # Of equal spans only that of the smallest document is sent; the others are repeats of it.
    n, width = part["text"].shape
    whole = np.zeros((n, (width + 9) // 8 * 8), np.uint8)
    whole[:, :width], whole[:, width], whole[:, width + 1] = part["text"], part["low"], part["high"]
    words = whole.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(words.shape[1]):
        h = mix(h ^ words[:, j]) + np.uint64(j)
    order = np.lexsort((part["doc"], h))
    same = np.zeros(n, bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    for j in range(words.shape[1]):
        same[1:] &= words[order[1:], j] == words[order[:-1], j]
    del whole, words, h
    head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    repeat = part["doc"][order] > part["doc"][order[head]]
    gone = order[repeat]
    first = part["at"][gone] + part["low"][gone].astype(np.int64) - (width - length)
    last = first + (part["high"][gone].astype(np.int64) - part["low"][gone])
    by = np.lexsort((first, part["doc"][gone]))
    yield from range_rows(part["doc"][gone][by], first[by], last[by], buckets)
    sent = order[~repeat]
    sent = sent[np.argsort(part["key"][sent], kind="stable")]
    bucket = (part["key"][sent] >> np.uint64(32)).astype(np.int64)
    bounds = run_bounds(bucket)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mine = sent[lo:hi]
        text = packed(part["text"][mine].tobytes())
        yield int(bucket[lo]), None, text, len(mine).to_bytes(4, "little") + b"".join(pack(part[k][mine]) for k in ("doc", "at", "low", "high"))


def removed_ranges(candidates: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """``_gone long, _ranges array<binary>``: starts of removed strings of each document.

    ``candidates``: ``_id, _text, _keys`` of the documents that share anchors."""
    reach, width = length - gram, 2 * length - gram
    folder = new_path(candidates.sparkSession, "columns")

    def gathered(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        whole = {}
        for k in list(held[0]):
            whole[k] = np.concatenate([h.pop(k) for h in held])
        return _in_batches(_span_rows(whole, length, buckets))

    def tell(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = b.column("_keys")
            for s in slices(b.column("_text"), PIECE, length - 1):
                mine = [joined_keys(keys[s.first + i].as_py() or []) for i in range(s.n)]
                part = _spans(s, mine, buckets, length, gram)
                part["doc"] = own[s.first + part["doc"]]
                held.append(part)
                size += len(part["doc"])
                if size >= FLUSH:
                    yield from gathered(held)
                    held, size = [], 0
        if size:
            yield from gathered(held)
        trim()

    def settle(table: pa.Table) -> pa.Table:
        """Settled ranges pass; the spans of the bucket are sorted."""
        text, meta, out = [], [], []
        for i, k, d in zip(*(table.column(c) for c in ("id", "keys", "docs")), strict=True):
            if i.is_valid:
                out.append((i.as_py(), k.as_py()))
                continue
            said = d.as_buffer()
            n, cols, at = int.from_bytes(said[:4], "little"), [], 4
            text.append(np.frombuffer(unpacked(k.as_buffer(), n * width), np.uint8).reshape(n, width))
            for _ in range(4):
                col, used = unpack(said[at:], n)
                cols.append(col)
                at += used
            meta.append(np.stack(cols))
        if text:
            doc, at, low, high = np.concatenate(meta, 1)
            ranges = repeated_strings(np.concatenate(text), doc, at, low, high, length, reach, folder)
            out.extend((i, k) for _, i, k, _ in range_rows(*ranges))
            del text, meta, doc, at, low, high
        trim()
        return pa.table({"id": pa.array([r[0] for r in out], pa.int64()), "keys": pa.array([r[1] for r in out], pa.binary())})

    rows = candidates.select("_id", "_text", "_keys").mapInArrow(tell, RUN_SCHEMA)
    settled = rows.groupBy("part").applyInArrow(settle, "id long, keys binary")
    return settled.groupBy(F.col("id").alias("_gone")).agg(F.collect_list("keys").alias("_ranges"))


def covered(ranges: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the strings cover."""
    pairs = np.frombuffer(b"".join(ranges), np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    end = np.maximum.accumulate(pairs[:, 1] + length)
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pairs)) - 1 if len(pairs) else first
    return pairs[first, 0], end[last]


CUT_SCHEMA = "_id long, _text string, _starts array<long>, _ends array<long>"


def covered_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``_id, _text, _ranges`` as those of CUT_SCHEMA."""
    for b in batches:
        pairs = [covered(r.as_py(), length) for r in b.column("_ranges")]
        runs = [pa.array([p[i] for p in pairs], pa.list_(pa.int64())) for i in range(2)]
        yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_text"), *runs], ["_id", "_text", "_starts", "_ends"])


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_id, _text, _ranges`` (starts of removed strings) of the documents of ``_id long, _text`` that lose bytes."""
    buckets = bucket_count(docs.sparkSession)

    def anchors(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        _, doc, place, h = _anchors(s, length, gram)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        return doc[new], h[new]

    # Both joins take the texts from one shuffle by identifier.
    candidates = docs.join(shared_fingerprints(docs, anchors, buckets, length - 1), F.col("_id") == F.col("_hit")).select("_id", "_text", "_keys")
    gone = removed_ranges(candidates, length, gram, buckets)
    return docs.join(gone, F.col("_id") == F.col("_gone")).select("_id", "_text", "_ranges")


def cut_text(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_id, _text, _starts, _ends`` (removed byte runs) of the documents of ``_id long, _text`` that lose bytes."""

    return repeated(docs, length, gram).mapInArrow(lambda batches: covered_batches(batches, length), CUT_SCHEMA)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts in a document with a smaller identifier.

    Every string has an anchor, the least of the hashes of its grams. Documents
    that share no anchor are done after one pass. For the others the text around
    each shared anchor goes to the anchor's bucket, aligned at the anchor, and
    the bucket is a collection whose suffixes are sorted column-wise: one
    symbol of each member is inserted a round, the order (by the new symbols of
    the Burrows-Wheeler transform) and the common prefixes are updated, and
    neighbours with ``length`` symbols in common are equal strings. Columns of
    large buckets pass through sequential files in the shared folder, and long
    documents are read in overlapping pieces.

    Returns id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` (of the bytes left).

    Defined cases: a null text is empty; matches never cross documents; rows with
    one identifier are one document to each other and remove nothing of each
    other; a null identifier has no order, so nothing of it is removed and it
    removes nothing. Identifiers are integers.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text"))
    facts = rows.select("_key", "_id", F.octet_length("_text").cast("long").alias("_n"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"))

    def digest(batches):
        for b in batches:
            out = []
            for t, r in zip(b.column("_text"), b.column("_ranges"), strict=True):
                raw, at, h, n = t.as_buffer(), 0, hashlib.sha256(), 0
                starts, ends = covered(r.as_py(), length)
                for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                    h.update(raw[at:lo])
                    n += hi - lo
                    at = hi
                h.update(raw[at:])
                out.append((hashlib.sha256(raw).hexdigest(), n, len(starts), h.hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["_cid", "_csha", "_gone", "_spans", "_kept"])

    cut = repeated(rows.where("_id is not null").select("_id", "_text"), length, gram)
    cut = cut.mapInArrow(digest, "_cid long, _csha string, _gone long, _spans long, _kept string").dropDuplicates(["_cid", "_csha"])
    out = facts.join(cut, (F.col("_id") == F.col("_cid")) & (F.col("_sha") == F.col("_csha")), "left")
    return out.select(
        F.col("_key").alias(id_col),
        F.col("_n").alias("n_bytes"),
        F.coalesce("_gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("_kept", "_sha").alias("kept_sha256"),
    )
