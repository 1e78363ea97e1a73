"""Benchmark decontamination by q-gram lemma filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grid import Slice, run_bounds, slices
from .license_scan import normalised
from .shared import written

#: Length of a q-gram, in bytes of normalised text; at most the 8 of one number.
Q = 8
#: Share of an item's bytes that may be edited.
ERROR = 0.1
#: Bytes of benchmark text in a block; each block is one pass over the documents. Its index, which a pass sends to the
#: executors, takes about 21 bytes for each, so 84 MB, beside a table of 4 MB.
BLOCK_BYTES = 4 << 20
#: Bytes of a document's normalised text that are searched at once, beside the overlap, and postings handled at once.
PIECE, POSTINGS = 1 << 18, 1 << 20
#: Bits of the table that tells at once most q-grams that no item has.
_TABLE_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)
_KEEP[65:91] += 32


def edit_budget(size: int, error: float = ERROR) -> int:
    """Edits allowed in an item of ``size`` bytes: so many that a shared q-gram is still certain."""
    return max(0, min(int(error * size), (size - Q) // Q))


@dataclass
class Item:
    """An item's words, each after one space, and a last space: it starts and ends where words do."""

    item_id: object
    text: bytes
    edits: int

    @property
    def least(self) -> int:
        """q-grams that a text within the edit budget shares with the item."""
        return len(self.text) - Q + 1 - Q * self.edits


def make_item(item_id: object, text: str | None, error: float) -> Item | None:
    body = normalised(text or "")
    return Item(item_id, body, edit_budget(len(body) - 2, error)) if body.strip() else None


class Index:
    """Postings of the q-grams of a block of items: places in their joined texts, sorted by q-gram.

    Items of fewer than Q bytes with their spaces have one gram, of all their bytes, and no edits."""

    def __init__(self, items: list[Item]):
        self.items = items
        sizes = np.array([len(x.text) for x in items], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        grams, at = [], []
        short: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(items):
            if len(x.text) < Q:
                short.setdefault(len(x.text), []).append((int.from_bytes(x.text, "little"), i))
                continue
            g = qgrams(np.frombuffer(x.text, np.uint8))
            grams.append(g)
            at.append((self.starts[i] + np.arange(len(g))).astype(np.int32))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.place = (np.concatenate(at) if at else np.zeros(0, np.int32))[order]
        g = g[order]
        bounds = run_bounds(g)
        self.grams, self.first, self.count = g[bounds[:-1]], bounds[:-1].astype(np.int32), np.diff(bounds).astype(np.int32)
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[_slot(self.grams)] = True
        self.short = {n: (np.array(sorted(k for k, _ in pairs), np.uint64), np.array([i for _, i in sorted(pairs)])) for n, pairs in short.items()}
        self.edits = np.array([x.edits for x in items], np.int64)
        self.shift = max((len(x.text) for x in items), default=0) + 1
        self.least = np.array([x.least for x in items], np.int64)

    def postings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places in them of postings."""
        item = np.searchsorted(self.starts, self.place[at], side="right") - 1
        return item, self.place[at] - self.starts[item]


def short_matches(index: Index, buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Exact places of items of fewer than Q bytes: document, item, start and end in ``buf``."""
    if not index.short:
        return
    at = np.flatnonzero(buf == 32)  # items begin and end with a space
    padded = np.concatenate([buf, np.zeros(Q, np.uint8)])
    eight = np.zeros(len(at), np.uint64)
    for j in range(Q - 1):
        eight |= padded[at + j].astype(np.uint64) << np.uint64(8 * j)
    for n, (keys, items) in index.short.items():
        mine = eight & np.uint64((1 << 8 * n) - 1)
        first, last = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
        hit = np.flatnonzero(first < last)
        doc = np.searchsorted(bounds, at[hit], side="right") - 1
        new = np.ones(len(hit), bool)  # the first place of each document and item
        order = np.lexsort((at[hit], first[hit], doc))
        hit, doc = hit[order], doc[order]
        new[1:] = (doc[1:] != doc[:-1]) | (first[hit[1:]] != first[hit[:-1]])
        for j, d in zip(hit[new], doc[new], strict=True):
            if at[j] + n - 1 <= bounds[d + 1]:
                for i in items[first[j] : last[j]]:
                    yield int(d), int(i), int(at[j]), int(at[j]) + n


def qgrams(buf: np.ndarray) -> np.ndarray:
    """Every Q bytes in a row as one number."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(n + 8, np.uint8)
    padded[: len(buf)] = buf
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        mine = out[o::8]
        mine[:] = np.frombuffer(padded, "<u8", len(mine), o)
    return out & np.uint64((1 << (8 * Q)) - 1)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * _SPREAD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def squeezed(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice, lower-cased, with one space for a run of other ASCII and around each document; starts of documents, with the end."""
    if s.n == 1:  # perhaps a long one: a part at a time
        parts, last = [np.full(1, 32, np.uint8)], 32
        for lo in range(0, len(s.buf) + 1, PIECE):
            part = _KEEP[s.buf[lo : lo + PIECE]] if lo + PIECE <= len(s.buf) else np.append(_KEEP[s.buf[lo:]], np.uint8(32))
            if len(part):
                keep = np.ones(len(part), bool)
                keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
                keep[0] = part[0] != 32 or last != 32
                parts.append(part[keep])
                last = part[-1]
        buf = np.concatenate(parts)
        return buf, np.array([0, max(len(buf) - 1, 1)])
    buf = np.empty(len(s.buf) + s.n + 1, np.uint8)
    place = np.arange(len(s.buf)) + np.repeat(np.arange(s.n), np.diff(s.offs)) + 1
    buf[s.offs + np.arange(s.n + 1)] = 32
    buf[place] = _KEEP[s.buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    keep[s.offs + np.arange(s.n + 1)] = True
    return buf[keep], (np.cumsum(keep) - 1)[s.offs + np.arange(s.n + 1)]


def windows(index: Index, buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts to search, with bounds and the place of each: a long document comes in pieces that overlap by more than any match."""
    if len(bounds) > 2 or len(buf) <= PIECE:
        yield buf, bounds, 0
        return
    overlap = index.shift + 2 * int(index.edits.max()) + Q
    for lo in range(0, max(len(buf) - overlap, 1), PIECE):
        part = buf[lo : lo + PIECE + overlap]
        yield part, np.array([0, len(part) - 1]), lo


def candidates(index: Index, buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Bands (document, item, first and last diagonal) with the q-grams that the lemma asks for.

    A diagonal is the place in ``buf`` less the place in the item. A band of an
    item with k edits covers 2 (k + 1) diagonals and starts every k + 1 of
    them, so any k + 1 neighbouring diagonals lie in one band."""
    g = qgrams(buf)
    at = np.flatnonzero(index.seen[_slot(g)]) if len(index.grams) else np.zeros(0, np.int64)
    if not len(at):
        return
    where = np.searchsorted(index.grams, g[at])
    where = np.minimum(where, len(index.grams) - 1)
    hit = index.grams[where] == g[at]
    at, where = at[hit], where[hit]
    if not len(at):
        return
    count = index.count[where].astype(np.int64)
    # One number for document, item and band, in that order.
    bands = np.int64(len(buf) + 2 * index.shift * (int(index.edits.max()) + 2))
    total = np.cumsum(count)
    cuts = [0, *np.searchsorted(total, np.arange(POSTINGS, total[-1], POSTINGS)), len(at)]

    def expanded(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of document, item and band, and places in the item, of the postings of some places."""
        n = count[lo:hi]
        pos = np.repeat(at[lo:hi], n)
        posting = np.repeat(index.first[where[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, inside = index.postings(posting)
        doc = np.searchsorted(bounds, pos, side="right") - 1
        step = index.edits[item] + 1
        shift = step * index.shift  # makes diagonals positive, in whole steps
        return (doc.astype(np.int64) * len(index.items) + item) * bands + (pos - inside + shift) // step, inside

    key, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        more, n = _counted(expanded(lo, hi)[0])
        every, place = np.unique(np.concatenate([key, more]), return_inverse=True)
        key, size = every, np.bincount(place, np.concatenate([size, n]), len(every)).astype(np.int64)
    key, size = _joined_counts(key, size)
    likely = key[size >= index.least[key // bands % len(index.items)]]
    if not len(likely):
        return
    # Of these, each q-gram of the item counts once.
    boths = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        every, place = expanded(lo, hi)
        near = np.isin(every, np.concatenate([likely, likely - 1]), kind="sort")
        boths.append((every[near], place[near]))
    every, place = (np.concatenate(x) for x in zip(*boths, strict=True))
    both = np.concatenate([every, every + 1])  # a hit counts for its own band and the next
    place = np.concatenate([place, place])
    order = np.lexsort((place, both))
    both, place = both[order], place[order]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]) | (place[1:] != place[:-1])
    key, size = _counted(both[new])
    key, size = key[np.isin(key, likely)], size[np.isin(key, likely)]
    band, pair = key % bands, key // bands
    item, doc = pair % len(index.items), pair // len(index.items)
    for j in np.flatnonzero(size >= index.least[item]):
        i, step = int(item[j]), int(index.edits[item[j]]) + 1
        first = (int(band[j]) - 1) * step - step * index.shift
        yield int(doc[j]), i, first, first + 2 * step - 1


def _joined_counts(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of given counts, with their successors, and how often each or its predecessor occurs."""
    every, _ = _counted(np.concatenate([key, key + 1]))
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, key)] = size
    total[np.searchsorted(every, key + 1)] += size
    return every, total


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with counts."""
    key = np.sort(key)
    bounds = run_bounds(key)
    return key[bounds[:-1]], np.diff(bounds)


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """The best place of ``item`` in ``text`` whose path stays on the diagonals
    ``first`` to ``last`` widened by ``edits``: (edits, start, end), or None.

    Banded dynamic programming: a vector holds one cell for each diagonal, and
    each symbol of the item is one step."""
    exact = text[max(first, 0) : max(last + len(item), 0)].tobytes().find(item.tobytes())
    if exact >= 0:
        return 0, exact + max(first, 0), exact + max(first, 0) + len(item)
    low, width = first - edits, last - first + 1 + 2 * edits
    far = np.int32(1 << 28)
    place = np.arange(width) + low
    inside = (place >= 0) & (place <= len(text))
    cost = np.where(inside, 0, far).astype(np.int32)
    start = place.copy()
    padded = np.full(len(item) + width, 256, np.int32)
    lo, hi = max(low, 0), min(low + len(padded), len(text))
    if lo < hi:
        padded[lo - low : hi - low] = text[lo:hi]
    lane = np.arange(width, dtype=np.int32)
    for i, c in enumerate(item):
        same = cost + (padded[i : i + width] != c)
        skip = np.append(cost[1:] + 1, far)
        pick = skip < same
        new = np.where(pick, skip, same)
        origin = np.where(pick, np.append(start[1:], 0), start)
        # Steps along the text go from lane to lane: a running minimum of cost less lane.
        flat = new - lane
        least = np.minimum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == least, lane, 0))
        cost, start = np.minimum(least + lane, far), origin[source]
        ends = place + i + 1
        cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
        if cost.min() > edits:
            return None
    best = int(np.argmin(cost))
    return int(cost[best]), int(start[best]), int(place[best]) + len(item)


def found_in(index: Index, text: pa.Array) -> list[list[dict]]:
    """Matches of each row of the batch: one for each item, the one with the fewest edits, then the first."""
    out: list[list[dict]] = [[] for _ in range(len(text))]
    for s in slices(text):
        buf, bounds = squeezed(s)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part, ends, base in windows(index, buf, bounds):
            for doc, i, start, end in short_matches(index, part, ends):
                lo = int(ends[doc]) - base
                best[doc, i] = min(best.get((doc, i), (1, 0, 0)), (0, start - lo, end - lo))
            for doc, i, first, last in candidates(index, part, ends):
                x, lo = index.items[i], int(ends[doc])
                mine = best.get((doc, i))
                if mine and mine[0] == 0:
                    continue
                got = align(np.frombuffer(x.text, np.uint8), part[lo : int(ends[doc + 1]) + 1], first - lo, last - lo, x.edits)
                if got and (mine is None or (got[0], got[1] + base, got[2] + base) < mine):
                    best[doc, i] = got[0], got[1] + base, got[2] + base
        for (doc, i), (edits, start, end) in sorted(best.items()):
            out[s.first + doc].append({"item": i, "start": start, "end": max(end - 2, start), "edits": edits})
    return out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, error: float) -> Iterator[list[Item]]:
    """The benchmark in blocks of at most BLOCK_BYTES, streamed through the driver."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        x = make_item(r["i"], r["t"], error)
        if x is None:
            continue
        if block and size + len(x.text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(x)
        size += len(x.text)
    if block:
        yield block


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    error: float = ERROR,
) -> DataFrame:
    """Pairs of documents and benchmark items whose text they contain, up to edits.

    Texts are compared as words: A-Z lower-cased, other ASCII between words one
    space; items begin and end where words do. An item of m bytes may differ in
    k = min(error m, (m - Q) / Q) edits. By the q-gram lemma such a place shares
    with the item, spaces around it included, m + 2 - Q + 1 - kQ q-grams within
    k + 1 diagonals; overlapping diagonal bands are counted, regions that reach
    the bound are kept, and alignment in the region verifies them. Items too
    short for a q-gram are looked up whole.

    The benchmark passes in blocks of BLOCK_BYTES, one pass over the documents
    each. Of several blocks only one is held at a time: its matches are written to
    the shared folder and its index is released before the next. Documents are
    never shuffled.

    Returns a row for each pair: id, item id, ``start`` and ``end`` (bytes of the
    normalised text), ``edits``.

    Defined cases: null and empty texts match nothing, and so do items without a
    word; repeated items each give a pair; equal rows of documents each give
    their pairs.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    item_type = benchmark.schema[item_col].dataType
    spark = docs.sparkSession
    parts = []
    kind = T.StructType([T.StructField("_item", T.IntegerType()), T.StructField("_item_id", item_type)])
    for block, alone in _told(item_blocks(benchmark, item_col, item_text_col, error)):
        ids = F.broadcast(spark.createDataFrame([(i, x.item_id) for i, x in enumerate(block)], kind))
        sent = spark.sparkContext.broadcast(Index(block))
        hits = rows.select("_id", F.explode(_matcher(sent)(F.col("_text"))).alias("_m"))
        hits = hits.select("_id", F.col("_m.item").alias("_item"), "_m.start", "_m.end", "_m.edits").join(ids, "_item")
        if not alone:
            hits = written(hits, "matches")
            sent.destroy()
        parts.append(hits)
    if not parts:
        parts = [rows.select("_id", F.lit(0).alias("_item"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).alias("edits"), F.lit(None).cast(item_type).alias("_item_id")).where("false")]
    found = reduce(DataFrame.unionByName, parts)
    return found.select(F.col("_id").alias(id_col), F.col("_item_id").alias(item_col if item_col != id_col else f"item_{item_col}"), "start", "end", "edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error: float = ERROR) -> DataFrame:
    """Documents, with all their columns, in which :func:`contaminated` finds no item.

    With one block of items nothing is shuffled. With more, each block leaves
    the sha256 of the texts that it finds in, and texts with one of these go."""
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    gone = []
    for block, alone in _told(item_blocks(benchmark, item_col, item_text_col, error)):
        sent = spark.sparkContext.broadcast(Index(block))
        clean = F.size(_matcher(sent)(text)) == 0
        if alone:
            return docs.where(clean)
        gone.append(written(docs.where(~clean).select(F.sha2(text.cast("binary"), 256).alias("_sha")), "matches"))
        sent.destroy()
    if not gone:
        return docs
    found = reduce(DataFrame.union, gone).distinct()
    sha = F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))
    return docs.join(found, sha == found["_sha"], "left_anti")


def _told(blocks: Iterator[list[Item]]) -> Iterator[tuple[list[Item], bool]]:
    """Blocks, and whether there is only one."""
    one = next(blocks, None)
    more = next(blocks, None)
    if one is not None:
        yield one, more is None
    if more is not None:
        yield more, False
    for block in blocks:
        yield block, False


def _matcher(sent: Broadcast):
    """An Arrow function from texts to their matches with the items of a block."""

    @F.arrow_udf("array<struct<item: int, start: long, end: long, edits: int>>")
    def matches(text: pa.Array) -> pa.Array:
        kind = pa.struct([("item", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
        return pa.array(found_in(sent.value, text), pa.list_(kind))

    return matches
