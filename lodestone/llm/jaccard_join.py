"""Similarity join of word n-gram sets with rare-first prefix filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .fingerprints import bucket_count, is_key, joined_keys, keyed, run_bounds, shared_fingerprints
from .grid import SLICE, Slice, grams_hash, mix, plain, run_names, slices, spans_hash, trim, word_ids
from .shared import forget, written, written_by

#: Words in an n-gram, and the least similarity in percent.
N, PERCENT = 5, 80
#: Hash buckets in which n-grams are counted over all documents; their counts (8 bytes each) are what the driver and the tasks hold.
#: An n-gram that is more than a millionth of all stands out in its bucket, however large the input; the others are about as rare as their buckets say.
COUNTERS = 1 << 20
_BLOCKS = 256
#: Parts of the n-grams, by hash, in which the suffix filter counts a set's suffix; at most 256.
PARTS = 32
#: Rounds in which entries meet one pivot before all pairs across components do, and pivots of an n-gram in a round.
ROUNDS, PIVOTS = 4, 8
#: Pairs of a document for which its set is sent once.
MEETINGS = 64
#: Entries that a task gathers before it sends them.
FLUSH = 1 << 18


def shingles(s: Slice, n: int = N, second: bool = False) -> tuple[np.ndarray, ...]:
    """Document and 64-bit hash of the distinct n-grams of a slice, sorted by both; with ``second``, also another, independent hash.

    A document with fewer than n words has its whole sequence as one."""
    buf, start, end, doc = s.bounds(lower=True)
    hashes = [spans_hash(buf, start, end, key) for key in range(1 + second)]
    if not len(doc):
        return (doc, *hashes)
    whole = doc[: max(len(doc) - n + 1, 0)] == doc[n - 1 :]
    count = np.bincount(doc, minlength=s.n)
    first = np.cumsum(count) - count
    short = [np.flatnonzero(count == k) for k in range(1, n)]
    docs = np.concatenate([doc[: len(whole)][whole], *short])
    grams = [np.concatenate([grams_hash(h, n)[whole], *(grams_hash(h, k)[first[at]] for k, at in enumerate(short, 1) if len(at))]) for h in hashes]
    order = np.lexsort((grams[0], docs))
    docs, grams = docs[order], [g[order] for g in grams]
    new = np.ones(len(docs), bool)
    new[1:] = (grams[0][1:] != grams[0][:-1]) | (docs[1:] != docs[:-1])
    return (docs[new], *(g[new] for g in grams))


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram & np.uint64(COUNTERS - 1)).astype(np.int64)


def set_facts(docs: DataFrame, n: int) -> DataFrame:
    """Rows ``id, n, s1, s2`` (size of each document's set, and a signature of 128 bits from two independent hashes of
    its words), and rows ``block, counts`` with each task's counts of n-grams by hash bucket."""

    def tell(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for b in batches:
            sizes, sig1, sig2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for s in slices(b.column("_text")):
                doc, gram, other = shingles(s, n, second=True)
                counts += np.bincount(_slot(gram), minlength=COUNTERS)
                bounds = run_bounds(doc)
                if len(doc):
                    at = s.first + doc[bounds[:-1]]
                    sizes[at] = np.diff(bounds)
                    sig1[at] = np.add.reduceat(mix(gram), bounds[:-1])
                    sig2[at] = np.add.reduceat(mix(other), bounds[:-1])
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes), pa.array(sig1.view(np.int64)), pa.array(sig2.view(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], ["id", "n", "s1", "s2", "block", "counts"])
        if counts.any():
            narrow = counts.astype(np.min_scalar_type(counts.max())) if counts.max() < 1 << 32 else counts
            blocks = [x.astype(np.int64).tobytes() if narrow.dtype == np.int64 else bytes([narrow.itemsize]) + x.tobytes() for x in np.split(narrow, _BLOCKS)]
            none = pa.nulls(_BLOCKS).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(_BLOCKS), pa.int32()), pa.array(blocks, pa.binary())], ["id", "n", "s1", "s2", "block", "counts"])
        trim()

    return docs.select("_id", "_text").mapInArrow(tell, "id long, n long, s1 long, s2 long, block int, counts binary")


def _widened(raw: bytes) -> np.ndarray:
    size = COUNTERS // _BLOCKS
    if len(raw) == size * 8:
        return np.frombuffer(raw, np.int64)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], size, 1).astype(np.int64)


def gram_counts(facts: DataFrame) -> np.ndarray:
    """Counts of n-grams by hash bucket over all documents: COUNTERS numbers, whatever the input.

    The tasks' counts are summed as they stream by, a block of buckets a group."""
    size = COUNTERS // _BLOCKS

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, block = np.zeros(size, np.int64), None
        for b in batches:
            block = b.column("block")[0] if block is None and b.num_rows else block
            for x in b.column("counts"):
                out += _widened(x.as_py())
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "counts"])

    counts = np.zeros(COUNTERS, np.int64)
    rows = facts.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(total, "block int, counts binary")
    for r in rows.collect():
        counts[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return counts


def prefixes(s: Slice, counts: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets in rare-first order: document, n-gram, place in the order, size of the set, whether in the prefix.

    Two sets that reach the similarity share an n-gram of both prefixes: the
    first size - ceil(percent size / 100) + 1 of an order common to all sets."""
    doc, gram = shingles(s, n)
    order = np.lexsort((gram, counts[_slot(gram)], doc))
    doc, gram = doc[order], gram[order]
    size = np.bincount(doc, minlength=s.n)
    place = np.arange(len(doc)) - (np.cumsum(size) - size)[doc]
    own = size[doc]
    return doc, gram, place, own, place < own - -(-percent * own // 100) + 1


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Common n-grams that sets of these sizes must have."""
    return -(-percent * (a + b) // (100 + percent))


def _passes(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filter of entries i and j of one n-gram.

    A pair that reaches the similarity passes at the first n-gram that both
    prefixes have. What can still follow there in both sets must be enough, and
    so must what the suffixes, the n-grams after it in the order, can share:
    parts that differ by c in their counts hold c n-grams that only one has."""
    ni, nj = x["n"][i], x["n"][j]
    least = _least_overlap(ni, nj, percent)
    ok = 100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj)
    ok &= np.minimum(ni - x["at"][i], nj - x["at"][j]) >= least
    at = np.flatnonzero(ok)
    after = (ni - x["at"][i] - 1 + nj - x["at"][j] - 1)[at]
    for block in np.array_split(np.arange(len(at)), max(1, len(at) >> 16)):
        mine, theirs = x["suffix"][i[at[block]]].astype(np.int16), x["suffix"][j[at[block]]]
        apart = np.abs(mine - theirs).sum(1, dtype=np.int64)
        ok[at[block]] = apart <= after[block] - 2 * (least[at[block]] - 1)
    return ok


def _entries(table: pa.Table) -> dict[str, np.ndarray]:
    """The entries of a bucket, by n-gram, then size, then document."""
    keys, meta, suffix = [], [], []
    for k, d in zip(table.column("keys"), table.column("docs"), strict=True):
        key = np.frombuffer(k.as_buffer(), np.uint32)
        m, raw = len(key), d.as_buffer()
        keys.append(key)
        meta.append(np.frombuffer(raw, np.int64, 4 * m).reshape(4, m))
        suffix.append(np.frombuffer(raw, np.uint8, PARTS * m, 32 * m).reshape(m, PARTS))
    key = np.concatenate(keys)
    doc, n, at, comp = np.concatenate(meta, 1)
    order = np.lexsort((doc, n, key))
    return {"key": key[order], "doc": doc[order], "n": n[order], "at": at[order], "comp": comp[order], "suffix": np.concatenate(suffix)[order]}


def _pivots(x: dict[str, np.ndarray], percent: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries with the pivot of their n-gram: one of its largest component, drawn by a hash
    of document and turn. Entries that can't be similar to it get a pivot among themselves, and so on."""
    draw = mix(x["doc"].astype(np.uint64) * np.uint64(2) + (mix(np.array([turn], np.uint64)) | np.uint64(1)))
    live = np.arange(len(draw))
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _ in range(PIVOTS):
        live = live[np.lexsort((draw[live], x["comp"][live], x["key"][live]))]
        key, comp = x["key"][live], x["comp"][live]
        group = run_bounds(key)
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(live)))
        # The largest run of each group, the first of equals.
        number = (np.cumsum(new) - 1)[group[:-1]]
        most = np.repeat(np.maximum.reduceat(size, number), np.diff(np.append(number, len(size))))
        at = np.where(size == most, np.arange(len(size)), len(size))
        pivot = np.repeat(live[head[np.minimum.reduceat(at, number)]], np.diff(group))
        apart = x["comp"][live] != x["comp"][pivot]
        live, pivot = live[apart], pivot[apart]
        ok = _passes(x, live, pivot, percent)
        out_i.append(live[ok])
        out_j.append(pivot[ok])
        live = live[~ok]
        if not len(live):
            break
    return np.concatenate(out_i), np.concatenate(out_j)


def _mixed(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one n-gram whose documents aren't yet in one component, and that pass the filters.

    Entries are in order of size, so each meets only those of sizes that can be similar."""
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = run_bounds(x["key"])
    low, high = np.minimum.reduceat(x["comp"], bounds[:-1]), np.maximum.reduceat(x["comp"], bounds[:-1])
    for g in np.flatnonzero(low != high):
        lo, hi = bounds[g], bounds[g + 1]
        _, number, size = np.unique(x["comp"][lo:hi], return_inverse=True, return_counts=True)
        largest, n = int(np.argmax(size)), x["n"][lo:hi]
        others = np.flatnonzero(number != largest)  # the largest component's own entries needn't be compared
        left = np.searchsorted(n, -(-percent * n[others] // 100))
        count = np.searchsorted(n, 100 * n[others] // percent, side="right") - left
        cuts = [0, *np.searchsorted(np.cumsum(count), np.arange(1 << 20, count.sum(), 1 << 20)), len(others)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            c = count[a:b]
            i = np.repeat(others[a:b], c)
            j = np.repeat(left[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            want = (number[i] != number[j]) & ((number[j] == largest) | (i < j))
            i, j = i[want] + lo, j[want] + lo
            ok = _passes(x, i, j, percent)
            out_i.append(i[ok])
            out_j.append(j[ok])
    return np.concatenate(out_i), np.concatenate(out_j)


def _suffixes(order: np.ndarray, total: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place, how many n-grams of the set after it are in each part; 255 for more.

    ``order`` has the parts of the prefix's n-grams, ``total`` those of all."""
    if not len(places):
        return np.zeros((0, PARTS), np.uint8)
    seen = np.zeros((int(places.max()) + 1, PARTS), np.uint32)
    seen[np.arange(len(seen)), order[: len(seen)]] = 1
    return np.minimum(total - np.cumsum(seen, 0, dtype=np.uint32)[places], 255).astype(np.uint8)


def candidate_pairs(sets: DataFrame, percent: int, turn: int | None) -> DataFrame:
    """``x, y, shared``: pairs of documents that meet in an n-gram of both prefixes and pass the filters.

    ``sets``: id, n, tokens, places, order, total, comp. In a ``turn`` each entry meets
    only a pivot of its n-gram, so pairs grow with the entries, not their
    square; with None, the entries of other components."""

    def tell(batches):
        from .fingerprints import _in_batches

        def rows(held: list[tuple]) -> Iterator[tuple]:
            key, doc, n, at, comp, suffix = (np.concatenate([h[i] for h in held]) for i in range(6))
            order = np.argsort(key, kind="stable")
            part = (key[order] >> np.uint64(32)).astype(np.int64)
            bounds = run_bounds(part)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                mine = order[lo:hi]
                meta = np.stack([doc[mine], n[mine], at[mine], comp[mine]]).astype(np.int64)
                yield int(part[lo]), None, key[mine].astype(np.uint32).tobytes(), meta.tobytes() + suffix[mine].tobytes()

        held, size = [], 0
        for b in batches:
            for i, n, tokens, places, order, total, comp in zip(*(b.column(c).to_pylist() for c in ("id", "n", "tokens", "places", "order", "total", "comp")), strict=True):
                key, at = np.frombuffer(tokens, np.uint64), np.frombuffer(places, np.int32)
                m = len(key)
                held.append((key, np.full(m, i), np.full(m, n), at, np.full(m, comp), _suffixes(np.frombuffer(order, np.uint8), np.frombuffer(total, np.uint32), at)))
                size += m
                if size >= FLUSH:
                    yield from _in_batches(rows(held))
                    held, size = [], 0
        if size:
            yield from _in_batches(rows(held))
        trim()

    def meet(table: pa.Table) -> pa.Table:
        x = _entries(table)
        i, j = _mixed(x, percent) if turn is None else _pivots(x, percent, turn)
        a, b = x["doc"][i], x["doc"][j]
        if turn is None:
            a, b = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = np.flatnonzero(new)
        return pa.table({"x": pa.array(a[first]), "y": pa.array(b[first]), "shared": pa.array(np.diff(np.append(first, len(a))).astype(np.int64))})

    rows = sets.select("id", "n", "tokens", "places", "order", "total", "comp").mapInArrow(tell, "part int, id long, keys binary, docs binary")
    met = rows.groupBy("part").applyInArrow(meet, "x long, y long, shared long")
    return met.groupBy("x", "y").agg(F.sum("shared").alias("shared"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links ``a, b``: the pairs ``x, y`` whose sets reach the similarity, each compared once.

    Pairs are dropped by hashes of the n-grams first; those that are left are
    compared by their words. ``sets`` lie by id: that of x goes to the pair, once
    for each; that of y goes once for MEETINGS pairs, so the pairs of a pivot are
    spread, however many."""

    def compare(batches):
        for b in batches:
            columns = [b.column(c) for c in ("p", "q", "v", "w")]
            sizes = zip(b.column("m").to_pylist(), b.column("n").to_pylist(), strict=True)
            likely = [i for i, size in enumerate(sizes) if _may_reach(*(np.frombuffer(c[i].as_buffer(), np.uint32) for c in columns[:2]), *size, percent)]
            keep = np.zeros(b.num_rows, bool)
            held, size = [], 0
            for i in likely:
                held.append((i, columns[2][i].as_buffer(), columns[3][i].as_buffer()))
                size += held[-1][1].size + held[-1][2].size
                if size > SLICE:
                    keep[[i for i, ok in _same_words(held, percent, n) if ok]] = True
                    held, size = [], 0
            keep[[i for i, ok in _same_words(held, percent, n) if ok]] = True
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], ["a", "b"]).filter(pa.array(keep))
        trim()

    many = pairs.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / MEETINGS).cast("int").alias("_m"))
    mine = sets.select(F.col("id").alias("x"), F.col("n").alias("m"), F.col("grams").alias("p"), F.col("words").alias("v"))
    theirs = sets.select(F.col("id").alias("y"), "n", F.col("grams").alias("q"), F.col("words").alias("w")).join(many, "y")
    theirs = theirs.select("y", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_salt"), "n", "q", "w")
    dealt = pairs.join(many, "y").select("x", "y", F.pmod(F.xxhash64("x"), F.col("_m")).cast("int").alias("_salt"))
    both = dealt.join(mine, "x").join(theirs, ["y", "_salt"])
    return both.select("x", "y", "m", "n", "p", "q", "v", "w").mapInArrow(compare, "a long, b long").distinct()


def _may_reach(p: np.ndarray, q: np.ndarray, m: int, n: int, percent: int) -> bool:
    """Whether sets of m and n n-grams, known by sorted hashes of 32 bits, can reach the similarity.

    n-grams of one hash, if any, are all taken for shared."""
    at = np.minimum(np.searchsorted(p, q), len(p) - 1)
    common = int((p[at] == q).sum()) + m - len(p) + n - len(q)
    return 100 * common >= percent * (m + n - common)


def _same_words(pairs: list[tuple[int, pa.Buffer, pa.Buffer]], percent: int, n: int) -> Iterator[tuple[int, bool]]:
    """Whether the texts of pairs (words with a space behind each) reach the similarity; n-grams are compared word for word."""
    if not pairs:
        return
    texts = [t for _, p, q in pairs for t in (p, q)]
    raw = b"".join(texts)
    ids = word_ids(raw)
    names = run_names(ids, n)
    first = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), np.cumsum([0, *(t.size for t in texts)]))
    for k, (i, p, q) in enumerate(pairs):
        a, b, c = first[2 * k : 2 * k + 3]
        if min(b - a, c - b) < n:  # a short text is one n-gram of its own length
            yield i, p == q
            continue
        x, y = np.unique(names[a : b - n + 1]), np.unique(names[b : c - n + 1])
        common = len(np.intersect1d(x, y, assume_unique=True))
        yield i, 100 * common >= percent * (len(x) + len(y) - common)


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more links: those of components are joined, not those of their members."""
    for end in ("a", "b"):
        to = comp.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        links = links.join(to, F.col(end) == F.col("_n"), "left").withColumn(end, F.coalesce("_c", end)).drop("_n", "_c")
    over = connected_components(links)
    known = comp.unionByName(over.select("node", F.col("node").alias("component")))
    to = over.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    out = written(known.join(to, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")), "components")
    forget(comp, over)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Groups of documents linked by sets of word n-grams: 100 |A & B| >= percent |A | B|.

    Words are runs other than space and controls 9 to 13, A-Z lower-cased; n-grams
    are held as 64-bit hashes, and pairs verified by words. Documents of equal sets
    are one class, by size and a signature of 128 bits from two independent hashes
    of the words, and its smallest identifier stands for it. n-grams
    are ordered rare first by counts over all documents, in COUNTERS hash
    buckets; classes whose prefixes share an n-gram meet there. In ROUNDS rounds each
    meets one pivot, the one it shares most n-grams with; the components of these
    links settle most n-grams. Then all pairs that meet in an n-gram across
    components, and pass the length, positional and suffix filters, are compared
    once each, so no link between components is lost and no group is expanded.

    Returns id, ``n_shingles``, ``component_id`` (least identifier reachable),
    ``class_id`` (least identifier with an equal set).

    Defined cases: a document with fewer than n words has its whole sequence as
    one n-gram; without words it has none, and is linked with nothing. Rows with
    one identifier are one node. A null identifier links with nothing and has a
    null component. Identifiers are integers.
    """
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    buckets = bucket_count(spark)
    told = written(set_facts(rows, n), "set-facts")
    facts = told.where("block is null").select("id", "n", "s1", "s2")
    counts = spark.sparkContext.broadcast(gram_counts(told))

    some = facts.where("n > 0 and id is not null")
    classes = written(some.groupBy("n", "s1", "s2").agg(F.min("id").alias("class"), F.max("id").alias("_last")).where("class < _last").drop("_last"), "classes")
    copies = written(some.join(classes, ["n", "s1", "s2"]).where("id > class").groupBy("id").agg(F.min("class").alias("class")), "copies")

    def rare(s: Slice) -> tuple[np.ndarray, np.ndarray]:
        doc, gram, _, _, first = prefixes(s, counts.value, n, percent)
        return doc[first], gram[first]

    def sets_of(batches):
        kinds = {"id": pa.int64(), "n": pa.int64(), "grams": pa.binary(), "words": pa.binary(), "tokens": pa.binary(), "places": pa.binary(), "order": pa.binary(), "total": pa.binary()}
        for batch in batches:
            keys = batch.column("_keys")
            ids = batch.column("_id").to_pylist()
            for s in slices(batch.column("_text")):
                out = {k: [] for k in kinds}
                doc, gram, place, _, first = prefixes(s, counts.value, n, percent)
                token, part = keyed(gram, buckets), (gram >> np.uint64(59)).astype(np.uint8)
                hit = first & is_key(token, doc, [joined_keys(keys[s.first + i].as_py() or []) for i in range(s.n)])
                bounds = np.searchsorted(doc, np.arange(s.n + 1))
                buf, start, end, of = s.bounds(lower=True)
                buf, offs = plain(buf, start, end)
                word = offs[np.searchsorted(of, np.arange(s.n + 1))]
                for i in range(s.n):
                    lo, hi = bounds[i], bounds[i + 1]
                    mine = hit[lo:hi]
                    out["id"].append(ids[s.first + i])
                    out["n"].append(int(hi - lo))
                    out["grams"].append(np.unique((gram[lo:hi] >> np.uint64(32)).astype(np.uint32)).tobytes())
                    out["words"].append(buf[word[i] : word[i + 1]].tobytes())
                    out["tokens"].append(token[lo:hi][mine].tobytes())
                    out["places"].append(place[lo:hi][mine].astype(np.int32).tobytes())
                    out["order"].append(part[lo:hi][first[lo:hi]].tobytes())
                    out["total"].append(np.bincount(part[lo:hi], minlength=PARTS).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))
        trim()

    hits = shared_fingerprints(rows, rare, buckets)
    hits = hits.join(copies.select(F.col("id").alias("_hit")), "_hit", "left_anti")
    found = rows.join(hits, F.col("_id") == F.col("_hit")).select("_id", "_text", "_keys")
    sets = written_by(found.mapInArrow(sets_of, "id long, n long, grams binary, words binary, tokens binary, places binary, order binary, total binary"), "sets", "id")

    # Read as plain files, so that small ones share a task.
    sets_narrow = spark.read.schema(sets.schema).parquet(sets._stored).select("id", "n", "tokens", "places", "order", "total")
    comp = spark.createDataFrame([], "node long, component long")
    tried = spark.createDataFrame([], "x long, y long")
    turns: list[int | None] = [*range(ROUNDS), None]
    done: list[DataFrame] = []
    while turns:
        turn = turns.pop(0)
        labelled = sets_narrow.join(comp, F.col("id") == F.col("node"), "left").select(*sets_narrow.columns, F.coalesce("component", "id").alias("comp"))
        pairs = candidate_pairs(labelled, percent, turn)
        if turn is not None:
            pairs = pairs.groupBy("x").agg(F.max_by("y", F.struct("shared", F.negate("y"))).alias("y"))
        pairs = pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
        fresh = written(pairs.join(tried, ["x", "y"], "left_anti"), "pairs")
        tried = tried.union(fresh)
        done.append(fresh)
        links = None if fresh.isEmpty() else written(verified(fresh, sets, percent, n), "links")
        if links is None or links.isEmpty():
            turns = turns[-1:]  # pivots have nothing more to tell: all pairs that are left
            continue
        comp = _joined(comp, links)
        forget(links)
    forget(sets, *done)
    comp = comp.select(F.col("node").alias("class"), "component")

    named = facts.join(copies, "id", "left").withColumn("class", F.coalesce("class", "id")).join(comp, "class", "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return named.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(linked, F.coalesce("component", "class")).otherwise(F.col("id")).alias("component_id"),
        F.when(linked, F.col("class")).otherwise(F.col("id")).alias("class_id"),
    )
