"""Incremental substring deduplication with a log-structured fingerprint index."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import (
    RUN_SCHEMA, SEVERAL, _batch, _from_planes, _in_batches, _planes, bucket_count, fingerprint_rows, hits_by_document, is_key, joined_keys, keyed, merge_rows, pack, run_bounds, run_entries, run_rows,
    unpack, window_minimizers,
)
from .grid import Slice, grams_hash, joined_words, mix, plain, run_names, slices, spans_hash, trim, word_ids
from .shared import Folder, drop_path, forget, new_path, partitions, written
from .suffix_dedup import CUT_SCHEMA, _ranges, covered, covered_batches, packed, range_rows, unpacked

#: Words in a window, and in the grams that pick its anchor.
LENGTH, GRAM = 50, 25
#: Words in the grams that cut shared text into spans for the comparison.
CUT = 10
#: Batches in which a whole table is indexed.
BATCHES = 3
#: Windows that a task gathers before it sends them, and bytes of spans.
FLUSH, SPAN_BYTES = 1 << 18, 16 << 20

_RANGES = "id long, keys binary"


def _windows(s: Slice, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Number in its document, document, anchor place, anchor hash of every window; words' hashes and their documents' first words."""
    _, _, doc_of, h = s.words(lower=False)
    first = np.searchsorted(doc_of, np.arange(s.n + 1))
    room = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(s.n), room)
    nth = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    anchor = grams_hash(h, gram)
    place = window_minimizers(anchor, length - gram + 1)
    place = place[nth + first[doc]] if len(nth) else np.zeros(0, np.int64)
    return nth, doc, place, anchor[place] if len(place) else np.zeros(0, np.uint64), h, first


class WindowIndex:
    """A log-structured index of the hashes that anchor the windows of all documents so far.

    The folder holds immutable runs, sorted by hash in ``buckets`` buckets, the
    documents found to share hashes, and numbered manifests that list them; the
    manifest with the largest number is the index. A folder that has one is opened
    with the settings it was made with, whatever those of the session.

    :meth:`add` writes the anchors of a batch as a run, merge-joins it with each
    older run, bucket with bucket and without moving them, and records which
    documents, new or old, now share an anchor. Two runs of one level are
    compacted into one of the next; runs that were replaced are deleted when the
    manifest without them is there. A batch counts only once its manifest is
    written: after a crash it can be added again.

    :meth:`resolve` verifies: windows of documents that share anchors are
    compared word for word, and the smallest document keeps each.

    ``buckets`` bounds what a task holds of a run: choose it so that a
    ``buckets``-th of all anchors (about one for 13 words, 12 bytes each) fits.
    Without a ``path`` the index lies in the shared folder and goes with the driver.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.path = spark, path or new_path(spark, "window-index")
        self.folder = Folder(spark, f"{self.path}/manifests")
        self._tables: dict[str, str] = {}
        found = self.folder.names()
        if found:
            self.version = int(found[-1].partition(".")[0])
            said = json.loads(self.folder.read(found[-1]))
            self.length, self.gram, self.buckets, self.files = said["length"], said["gram"], said["buckets"], said["files"]
            self.runs, self.hits = [tuple(r) for r in said["runs"]], said["hits"]
        else:
            self.version, self.length, self.gram = 0, length, gram
            self.buckets = buckets or bucket_count(spark)
            self.files = min(partitions(spark), self.buckets)
            self.runs: list[tuple[int, str]] = []
            self.hits: list[str] = []

    def _commit(self, runs: list[tuple[int, str]], hits: list[str]) -> None:
        said = {"length": self.length, "gram": self.gram, "buckets": self.buckets, "files": self.files, "runs": runs, "hits": hits}
        self.folder.write_new(f"{self.version + 1:09}.json", json.dumps(said))
        self.version += 1
        for _, name in set(self.runs) - set(runs):
            self._forget(name)
            drop_path(self.spark, f"{self.path}/{name}")
        self.runs, self.hits = runs, hits

    def _write(self, rows: DataFrame) -> str:
        """A run: rows in files by bucket, sorted by it. A task writes the buckets that it has."""
        name, table = f"run-{uuid.uuid4().hex}", f"lodestone_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.files, "part").sortBy("part").option("path", f"{self.path}/{name}").saveAsTable(table)
        self._tables[name] = table
        return name

    def _read(self, name: str) -> DataFrame:
        """A run, as a table whose buckets need no exchange."""
        if name not in self._tables:
            self._tables[name] = f"lodestone_{uuid.uuid4().hex}"
            self.spark.sql(
                f"CREATE TABLE {self._tables[name]} (part int, id long, keys binary, docs binary) USING parquet "
                f"CLUSTERED BY (part) SORTED BY (part) INTO {self.files} BUCKETS LOCATION '{self.path}/{name}'"
            )
        return self.spark.table(self._tables[name])

    def _forget(self, name: str) -> None:
        if name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(name)}")

    def _hits(self, rows: DataFrame) -> str:
        name = f"hits-{uuid.uuid4().hex}"
        rows.select("id", "keys").write.parquet(f"{self.path}/{name}")
        return name

    def add(self, batch: DataFrame) -> None:
        """Index a batch (``_id long, _text string``)."""
        length, gram = self.length, self.gram

        def anchors(s: Slice) -> tuple[np.ndarray, np.ndarray]:
            _, doc, place, h, _, _ = _windows(s, length, gram)
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            return doc[new], h[new]

        told = written(merge_rows(fingerprint_rows(batch, anchors, self.buckets), self.buckets, keep_runs=True), "batch")
        mine = self._write(told.where("id is null").repartition(self.files, "part"))
        hits = [*self.hits, self._hits(told.where("id is not null"))]
        forget(told)
        for _, name in self.runs:
            pair = self._read(mine).groupBy("part").cogroup(self._read(name).groupBy("part"))
            hits.append(self._hits(pair.applyInArrow(_common, _RANGES)))
        runs, made = [*self.runs, (0, mine)], []
        while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
            (level, a), (_, b) = runs[-2:]
            pair = self._read(a).groupBy("part").cogroup(self._read(b).groupBy("part"))
            runs = [*runs[:-2], (level + 1, self._write(pair.applyInArrow(_merged, RUN_SCHEMA)))]
            made += [a, b]
        self._commit(runs, hits)
        for name in made:  # also runs that were made and replaced within this batch
            if name in self._tables:
                self._forget(name)
                drop_path(self.spark, f"{self.path}/{name}")

    def resolve(self, docs: DataFrame) -> DataFrame:
        """``_id, _text, _starts, _ends`` (runs of removed words) of the documents that lose words.

        ``docs`` holds all indexed documents that may share windows: a batch with
        its history. Only those that share anchors are looked into."""
        docs = docs.where("_id is not null").select("_id", "_text")
        return removed_words(docs, self.removed(docs), self.length)

    def removed(self, docs: DataFrame) -> DataFrame:
        """``_gone long, _ranges array<binary>``: starts of removed windows of each document."""
        if not self.hits:
            return self.spark.createDataFrame([], "_gone long, _ranges array<binary>")
        hits = self.spark.read.schema(_RANGES).parquet(*(f"{self.path}/{name}" for name in self.hits))
        docs = docs.where("_id is not null").select("_id", "_text")
        # All joins take the texts from one shuffle by identifier.
        found = docs.join(hits_by_document(hits), F.col("_id") == F.col("_hit")).select("_id", "_text", "_keys")
        shared = shared_windows(found, self.length, self.gram, self.buckets)
        found = docs.join(shared, F.col("_id") == F.col("_hit")).select("_id", "_text", "_keys")
        return compared_windows(found, self.length, bucket_count(self.spark))

    def close(self) -> None:
        """Forget the tables of the catalog; the folder stays."""
        for name in list(self._tables):
            self._forget(name)

    def drop(self) -> None:
        """Delete the index."""
        self.close()
        drop_path(self.spark, self.path)
        self.runs, self.hits = [], []


def _common(new: pa.Table, old: pa.Table) -> pa.Table:
    """What two sorted runs share of a bucket: a row for each document that is alone in its run."""
    (_, key, ids), (_, keys, theirs) = run_entries(new), run_entries(old)
    _, a, b = np.intersect1d(key, keys, assume_unique=True, return_indices=True)
    apart = (ids[a] != theirs[b]) | (ids[a] == SEVERAL)
    doc = np.concatenate([ids[a][apart], theirs[b][apart]])
    key = np.concatenate([key[a][apart], keys[b][apart]])
    doc, key = doc[doc != SEVERAL], key[doc != SEVERAL]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    bounds = run_bounds(doc)
    return pa.table({"id": pa.array(doc[bounds[:-1]]), "keys": pa.array([key[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})


def _merged(a: pa.Table, b: pa.Table) -> pa.Table:
    """Two runs of a bucket as one."""
    (_, x, ids), (_, y, theirs) = run_entries(a), run_entries(b)
    key, ids = np.concatenate([x, y]), np.concatenate([ids, theirs])
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    bounds = run_bounds(key)
    first, last = bounds[:-1], bounds[1:] - 1
    return pa.Table.from_batches([_batch(list(run_rows(key[first], np.where(ids[first] != ids[last], SEVERAL, ids[first]))))])


def shared_windows(candidates: DataFrame, length: int, gram: int, anchor_buckets: int) -> DataFrame:
    """``_hit long, _keys array<binary>``: first and last of the runs of windows whose hash another document has too.

    Windows go to buckets by their own hash, not by that of the anchor, so text
    that is everywhere in ever other surroundings doesn't meet in one; a window
    that several documents of a task have is sent once. ``candidates``: ``_id,
    _text, _keys`` of the documents that share anchors."""
    buckets, groups = bucket_count(candidates.sparkSession), max(1, partitions(candidates.sparkSession) // 4)

    def rows(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
        key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, key))
        key, doc, at = key[order], doc[order], at[order]
        bounds = run_bounds(key)
        first, last = bounds[:-1], bounds[1:] - 1
        shared = doc[first] != doc[last]
        mine = np.repeat(shared, np.diff(bounds))
        yield from range_rows(*_ranges(doc[mine], at[mine]), buckets)
        # A window that one document has more than once goes on with all its places.
        sent = np.flatnonzero(~mine | np.isin(np.arange(len(key)), first))
        key, doc, at = key[sent], np.where(mine[sent], SEVERAL, doc[sent]), at[sent]
        part = (key >> np.uint64(32)).astype(np.int64)
        bounds = run_bounds(part)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(part[lo]), None, _planes(key[lo:hi].astype(np.uint32)), pack(doc[lo:hi]) + pack(at[lo:hi])

    def tell(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            keys = batch.column("_keys")
            for s in slices(batch.column("_text")):
                nth, doc, place, anchor, h, first = _windows(s, length, gram)
                if not len(nth):
                    continue
                hit = is_key(keyed(anchor, anchor_buckets), doc, [joined_keys(keys[s.first + i].as_py() or []) for i in range(s.n)])
                nth, doc = nth[hit], doc[hit]
                held.append((keyed(grams_hash(h, length)[nth + first[doc]], buckets), own[s.first + doc], nth))
                size += len(nth)
                if size >= FLUSH:
                    yield from _in_batches(rows(held))
                    size = 0
        if size:
            yield from _in_batches(rows(held))
        trim()

    def meet(table: pa.Table) -> pa.Table:
        """The windows of a bucket meet. Runs of windows, these and the known ones, go on in few rows: one for each
        group of documents, not one for each document."""
        keys, docs, ats = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        runs = [np.zeros((0, 3), np.int64)]
        for i, k, d in zip(*(table.column(c) for c in ("id", "keys", "docs")), strict=True):
            if i.is_valid:
                pairs = np.frombuffer(k.as_buffer(), np.int64).reshape(-1, 2)
                runs.append(np.concatenate([np.full((len(pairs), 1), i.as_py()), pairs], 1))
                continue
            keys.append(_from_planes(k.as_buffer()))
            doc, used = unpack(d.as_buffer(), len(keys[-1]))
            docs.append(doc)
            ats.append(unpack(d.as_buffer()[used:], len(doc))[0])
        key, doc, at = np.concatenate(keys), np.concatenate(docs), np.concatenate(ats)
        order = np.lexsort((doc, key))
        key, doc, at = key[order], doc[order], at[order]
        bounds = run_bounds(key)
        first, last = bounds[:-1], bounds[1:] - 1
        mine = np.repeat((doc[first] != doc[last]) | (doc[first] == SEVERAL), np.diff(bounds)) & (doc != SEVERAL)
        found = np.concatenate([*runs, np.stack(_ranges(doc[mine], at[mine]), 1)])
        to = (mix(found[:, 0].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((found[:, 1], found[:, 0], to))
        found, to = found[order], to[order]
        bounds = run_bounds(to)
        out = [(int(to[lo]), hi - lo, b"".join(pack(c) for c in found[lo:hi].T)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "n": pa.array([r[1] for r in out], pa.int32()), "runs": pa.array([r[2] for r in out], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """The runs of each document of a group."""
        found = []
        for n, raw in zip(table.column("n").to_pylist(), table.column("runs"), strict=True):
            cols, at = [], 0
            for _ in range(3):
                col, used = unpack(raw.as_buffer()[at:], n)
                cols.append(col)
                at += used
            found.append(np.stack(cols, 1))
        rows = list(range_rows(*_joined_runs(*np.concatenate(found).T)))
        return pa.table({"_hit": pa.array([r[1] for r in rows], pa.int64()), "_keys": pa.array([[r[2]] for r in rows], pa.list_(pa.binary()))})

    told = candidates.select("_id", "_text", "_keys").mapInArrow(tell, RUN_SCHEMA)
    met = told.groupBy("part").applyInArrow(meet, "part int, n int, runs binary")
    return met.groupBy("part").applyInArrow(gather, "_hit long, _keys array<binary>")


def _joined_runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of document and place, those that touch or overlap as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    # The furthest end so far of each document: a running maximum that starts anew with it.
    step = int(last.max(initial=0)) + 2
    nth = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) if len(doc) else doc
    far = np.maximum.accumulate(last + nth * step) - nth * step
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > far[:-1] + 1)
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(doc)) - 1 if len(doc) else heads
    return doc[heads], first[heads], far[ends]


def _spans(first: np.ndarray, last: np.ndarray, base: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of a document, cut where the anchor changes: first and last window."""
    count = last - first + 1
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (place[at[1:] + base] != place[at[:-1] + base])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1 if len(at) else lo
    return at[lo], at[hi]


def compared_windows(candidates: DataFrame, length: int, buckets: int) -> DataFrame:
    """``_gone long, _ranges array<binary>``: starts of windows whose words, compared one by one, a smaller document has too.

    ``candidates``: ``_id, _text, _keys``, the runs of windows to compare. The
    words of a run go, cut into spans at anchors, to the anchors' buckets, where
    windows are named by their words. Of equal spans of a task only that of the
    smallest document is sent."""
    gram = min(CUT, length)

    def rows(held: dict[tuple, list]) -> Iterator[tuple]:
        by_part: dict[int, list] = {}
        done: dict[int, list] = {}
        for (part, _, raw), (least, at, others) in held.items():
            by_part.setdefault(part, []).append((raw, least, at))
            for doc, there, n in others:
                if doc > least:
                    done.setdefault(doc, []).append((there, there + n - 1))
                else:
                    by_part[part].append((raw, doc, there))
        held.clear()
        for doc, pairs in done.items():
            yield doc % buckets, doc, np.array(pairs, np.int64).tobytes(), None
        for part, spans in by_part.items():
            counts = np.array([raw.count(b" ") for raw, _, _ in spans])
            raw = b"".join(raw for raw, _, _ in spans)
            yield part, None, len(raw).to_bytes(8, "little") + packed(raw), len(spans).to_bytes(4, "little") + pack(counts) + pack(np.array([d for _, d, _ in spans])) + pack(np.array([a for _, _, a in spans]))

    def tell(batches):
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys = batch.column("_id").to_pylist(), batch.column("_keys")
            for s in slices(batch.column("_text")):
                buf, start, end, of = s.bounds(lower=False)
                anchor = grams_hash(spans_hash(buf, start, end), gram)
                buf, offs = plain(buf, start, end)
                words = np.searchsorted(of, np.arange(s.n + 1))
                place = window_minimizers(anchor, length - gram + 1)
                for i in range(s.n):
                    runs = np.frombuffer(b"".join(keys[s.first + i].as_py() or []), np.int64).reshape(-1, 2)
                    base, most = int(words[i]), int(words[i + 1] - words[i]) - length
                    runs = runs[runs[:, 1] <= most]  # ranges of another text with the identifier may go beyond this one
                    if not len(runs):
                        continue
                    doc = ids[s.first + i]
                    runs = runs[np.argsort(runs[:, 0], kind="stable")]
                    far = np.maximum.accumulate(runs[:, 1])
                    new = np.ones(len(runs), bool)
                    new[1:] = runs[1:, 0] > far[:-1] + 1
                    heads = np.flatnonzero(new)
                    lo, hi = _spans(runs[heads, 0], far[np.append(heads[1:], len(runs)) - 1], base, place)
                    parts = (anchor[place[lo + base]] % np.uint64(buckets)).astype(np.int64)
                    for a, b, part in zip(lo.tolist(), hi.tolist(), parts.tolist(), strict=True):
                        raw = buf[offs[base + a] : offs[base + b + length]].tobytes()
                        own = held.setdefault((part, b - a, raw), [doc, a, []])
                        if own[0] != doc or own[1] != a:
                            if doc < own[0]:
                                own[2].append((own[0], own[1], b - a + 1))
                                own[0], own[1] = doc, a
                            else:
                                own[2].append((doc, a, b - a + 1))
                            size += 64
                        else:
                            size += len(raw) + 300
                if size >= SPAN_BYTES:
                    yield from _in_batches(rows(held))
                    size = 0
        if size:
            yield from _in_batches(rows(held))
        trim()

    def settle(table: pa.Table) -> pa.Table:
        """Ranges that are settled pass; the windows of the bucket's spans are named."""
        raws, counts, docs, ats, out = [], [], [], [], []
        for i, k, d in zip(*(table.column(c) for c in ("id", "keys", "docs")), strict=True):
            if i.is_valid:
                out.append((i.as_py(), k.as_py()))
                continue
            held = k.as_buffer()
            raws.append(unpacked(held[8:], int.from_bytes(held[:8], "little")))
            said = d.as_buffer()
            n, used = int.from_bytes(said[:4], "little"), 4
            for col in (counts, docs, ats):
                more, size = unpack(said[used:], n)
                col.append(more)
                used += size
        if raws:
            count, doc, at = np.concatenate(counts), np.concatenate(docs), np.concatenate(ats)
            name = run_names(word_ids(b"".join(raws)), length)
            room = count - length + 1
            inside = np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
            name = name[np.repeat(np.cumsum(count) - count, room) + inside]
            doc, at = np.repeat(doc, room), np.repeat(at, room) + inside
            order = np.lexsort((doc, name))
            name, doc, at = name[order], doc[order], at[order]
            bounds = run_bounds(name)
            gone = doc > np.repeat(doc[bounds[:-1]], np.diff(bounds))
            out.extend((i, k) for _, i, k, _ in range_rows(*_ranges(doc[gone], at[gone])))
        trim()
        return pa.table({"id": pa.array([r[0] for r in out], pa.int64()), "keys": pa.array([r[1] for r in out], pa.binary())})

    told = candidates.select("_id", "_text", "_keys").mapInArrow(tell, RUN_SCHEMA)
    settled = told.groupBy("part").applyInArrow(settle, _RANGES)
    return settled.groupBy(F.col("id").alias("_gone")).agg(F.collect_list("keys").alias("_ranges"))


def removed_words(docs: DataFrame, gone: DataFrame, length: int) -> DataFrame:
    """``_id, _text, _starts, _ends`` of the documents of ``gone``, as maximal runs of words."""

    both = docs.join(gone, F.col("_id") == F.col("_gone")).select("_id", "_text", "_ranges")
    return both.mapInArrow(lambda batches: covered_batches(batches, length), CUT_SCHEMA)


def kept_words(words: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """Words, joined by one space, without runs of them, and the number removed."""
    space = np.concatenate([[-1], np.flatnonzero(np.frombuffer(words, np.uint8) == 32), [len(words)]])
    kept, at, gone = [], 0, 0
    for lo, hi in [*zip(starts.tolist(), ends.tolist(), strict=True), (len(space) - 1, len(space) - 1)]:
        if lo > at:
            kept.append(words[space[at] + 1 : space[lo]])
        gone += hi - lo
        at = hi
    return b" ".join(kept), gone


def window_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts in a document with a smaller identifier.

    The table is indexed in ``batches`` ranges of identifiers through a
    :class:`WindowIndex`, then resolved. Windows are judged on the input.

    Returns id, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space).

    Defined cases: a null text has no words; rows with one identifier are one
    document to each other and remove nothing of each other; a null identifier
    has no order, so nothing of it is removed and it removes nothing.
    Identifiers are integers, 0 or more.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def facts(batches):
        for b in batches:
            words = [joined_words(t.as_buffer().to_pybytes()) for t in b.column("_text")]
            told = [pa.array([w.count(b" ") + 1 if w else 0 for w in words], pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for w in words], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_id"), *told], ["_key", "_id", "_words", "_sha"])

    def digest(batches):
        for b in batches:
            out = []
            for t, r in zip(b.column("_text"), b.column("_ranges"), strict=True):
                words = joined_words(t.as_buffer().to_pybytes())
                kept, gone = kept_words(words, *covered(r.as_py(), length))
                out.append((hashlib.sha256(words).hexdigest(), gone, hashlib.sha256(kept).hexdigest()))
            kinds = [pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["_cid", "_csha", "_n", "_kept"])

    index = WindowIndex(docs.sparkSession, length=length, gram=gram)
    texts = rows.select("_id", "_text")
    cuts = rows.select(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        batch = texts
        if lo is not None:
            batch = batch.where(F.col("_id") > lo)
        if hi is not None:
            batch = batch.where(F.col("_id") <= hi)
        index.add(batch)
    gone = written(index.removed(texts), "removed")
    index.drop()
    cut = texts.join(gone, F.col("_id") == F.col("_gone")).select("_id", "_text", "_ranges")
    cut = cut.mapInArrow(digest, "_cid long, _csha string, _n long, _kept string").dropDuplicates(["_cid", "_csha"])
    out = rows.mapInArrow(facts, f"_key {docs.schema[id_col].dataType.simpleString()}, _id long, _words long, _sha string")
    out = out.join(cut, (F.col("_id") == F.col("_cid")) & (F.col("_sha") == F.col("_csha")), "left")
    return out.select(
        F.col("_key").alias(id_col),
        F.col("_words").alias("n_words"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_kept", "_sha").alias("kept_sha256"),
    )
