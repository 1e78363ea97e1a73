"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import gc
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.jaccard_join import jaccard_components
from lodestone.llm.suffix_dedup import column_sort, repeated_strings, substring_dedup
from lodestone.llm.window_index import WindowIndex, compared_windows, removed_words, window_dedup

DOCS = "doc_id long, text string, source string"


def lower(text):
    return (text or "").encode().lower().decode()


def corpus(seed: int, n: int = 120, words: int = 40) -> list[tuple]:
    """Random documents with copies, edits, shared passages, nulls, blanks and a very long one."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ß"]
    passages = [" ".join(rng.choices(vocab, k=70)) for _ in range(3)]
    out = []
    for i in range(n):
        roll = rng.random()
        if out and roll < 0.2:
            text = rng.choice(out)[1]
        elif out and roll < 0.45 and (base := rng.choice(out)[1]):
            parts = base.split(" ")
            for _ in range(rng.randrange(1, 3)):
                parts[rng.randrange(len(parts))] = rng.choice(vocab)
            text = " ".join(parts)
        elif roll < 0.6:
            text = " ".join(rng.choices(vocab, k=rng.randrange(30))) + " " + rng.choice(passages) + "\n" + " ".join(rng.choices(vocab, k=rng.randrange(30)))
        else:
            text = " ".join(rng.choices(vocab, k=rng.randrange(words * 4)))
        out.append((i, text.upper() if rng.random() < 0.05 else text, "s"))
    long = " ".join(rng.choices(vocab, k=30_000))
    out += [(n, None, "s"), (n + 1, "", None), (n + 2, " \t\n", "s"), (n + 3, "one two", "s"), (n + 4, "One TWO", "s"), (n + 5, "ab" * 80, "s"), (n + 6, "ba" * 90, "s"), (n + 7, long, "s"), (n + 8, long + " end", "s")]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


# Exact


def test_exact_against_brute_force(spark):
    rows = corpus(1) + [(900 + i, "hot copy of a text", "s") for i in range(200)] + [(i + 2000, "HOT copy of a text", "s") for i in range(100)]
    for keep, pick in (("min", min), ("max", max)):
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(lower(t), []).append(i)
        want = {i: (pick(g := groups[lower(t)]), len(g), i == pick(g), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows}
        got = {r["doc_id"]: tuple(r[1:]) for r in exact_dedup(frame(spark, rows), keep=keep).collect()}
        assert got == want


def test_exact_defined_cases(spark):
    rows = [(1, "a", "x"), (1, "A", "y"), (None, "a", "z"), (None, "b", "z"), (None, "b", "z"), (2, None, None), (3, "", None)]
    df = frame(spark, rows).withColumnRenamed("source", "kept")
    got = exact_dedup(df, carry=["text", "kept", "doc_id"]).toDF("text", "mine", "doc_id", "keep_id", "n", "kept", "sha").collect()
    assert len(got) == 7
    assert sum(r["kept"] for r in got) == 3
    assert {(r["doc_id"], r["keep_id"], r["n"]) for r in got} == {(1, 1, 3), (None, 1, 3), (None, None, 2), (2, 2, 2), (3, 2, 2)}
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_hot_rows_without_order(spark):
    """A hot text on null and repeated identifiers: one row is kept, whatever run it is in."""
    for ids in ([None] * 400, [7] * 400, [None] * 200 + [3] * 200, [3] * 100 + [9] * 300):
        df = frame(spark, [(i, "hot", "s") for i in ids] + [(1000 + i, f"text {i}", "s") for i in range(20)])
        for keep, pick in (("min", min), ("max", max)):
            got = exact_dedup(df, keep=keep).where("doc_id is null or doc_id < 1000").collect()
            want = pick((i for i in ids if i is not None), default=None)
            assert {(r["keep_id"], r["group_size"]) for r in got} == {(want, 400)} and [r["doc_id"] for r in got if r["kept"]] == [want]


# Near


def similar(a: set, b: set) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = lower(t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if y < x and similar(sets[x], sets[y]):
                a, b = root(x), root(y)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_against_brute_force(spark, seed):
    rows = corpus(seed, 200, 15)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_jaccard_chain(spark):
    """A chain of edits: neighbours are similar, ends are not."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words), "s"))
        words[2 * i % 120] = f"n{i}"
        words[rng.randrange(120)] = f"m{i}"
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_defined_cases(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (3, "A b C d e F", "x"), (None, "a b c d e f", "z"), (7, None, None), (8, "", None), (9, "x y", None), (10, "X  y", None)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows).withColumnRenamed("source", "class")).collect())
    assert got == [(0, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3), (7, 0, 7), (8, 0, 8), (9, 1, 9), (10, 1, 9)]
    assert jaccard_components(frame(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (None, 3)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[300] == got[200] == 100 and got[559] == 500 and 0 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substrings


def brute_substrings(rows, length):
    first = {}
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for i in sorted(texts):
        t = texts[i]
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = {}
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(t), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_against_brute_force(spark, seed):
    rows = corpus(seed, 60, 20)
    got = {r["doc_id"]: tuple(r[1:]) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == brute_substrings(rows, 50)
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_substring_defined_cases(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(70))
    rows = [(4, text, "x"), (4, text, "y"), (None, text, "z"), (9, "é" + text, None), (10, None, None), (11, text[:49], None), (2, "\0" * 60, None), (3, "\0" * 55, None)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substring_dedup(frame(spark, rows).withColumnRenamed("source", "_id")).collect())
    assert got == [(0, 70, 0, 0), (2, 60, 0, 0), (3, 55, 55, 1), (4, 70, 0, 0), (4, 70, 0, 0), (9, 72, 70, 1), (10, 0, 0, 0), (11, 49, 0, 0)]
    assert substring_dedup(frame(spark, [])).count() == 0


def test_column_sort():
    """Orders are those of the suffixes, common prefixes are true, also through files."""
    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (200, 12)).astype(np.uint8)
    for c, (order, common) in zip(range(11, -1, -1), column_sort(iter(np.ascontiguousarray(m.T[::-1])), 200), strict=True):
        rows = [bytes(m[i, c:]) for i in order]
        assert rows == sorted(rows)
        for a, b, n in zip(rows, rows[1:], common[1:], strict=False):
            assert n == next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))


def test_columns_through_a_file(monkeypatch, tmp_path):
    from lodestone.llm import suffix_dedup

    m = np.random.default_rng(1).integers(0, 2, (50, 8)).astype(np.uint8)
    doc, zero = np.arange(50), np.zeros(50, np.int64)
    args = (doc, zero + 10, zero, zero + 4, 4, 4)
    want = [x.tolist() for x in repeated_strings(m, *args)]
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 0)
    assert [x.tolist() for x in repeated_strings(m, *args, f"file://{tmp_path}/columns")] == want
    assert not list((tmp_path / "columns").iterdir())


# Windows


def brute_windows(rows, length):
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    first, out = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 3), (3, 6)])
def test_windows_against_brute_force(spark, seed, batches):
    rows = corpus(seed, 150, 40)
    got = {r["doc_id"]: tuple(r[1:]) for r in window_dedup(frame(spark, rows), batches=batches).collect()}
    assert got == brute_windows(rows, 50)
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_windows_defined_cases(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(4, text, "x"), (4, text, "y"), (None, text, "z"), (9, "more " + text, None), (10, None, None), (11, "  ", None)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in window_dedup(frame(spark, rows).withColumnRenamed("source", "_text")).collect())
    assert got == [(0, 60, 0), (4, 60, 0), (4, 60, 0), (9, 61, 60), (10, 0, 0), (11, 0, 0)]
    assert window_dedup(frame(spark, [])).count() == 0


def thue_morse(n: int, flip: int) -> str:
    return "".join("ab"[bin(i).count("1") + flip & 1] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_are_told_apart(spark, size):
    """Words that a polynomial hash modulo 2^64 takes for equal are different words."""
    w, v = thue_morse(size, 0), thue_morse(size, 1)
    rest = " ".join(f"t{i}" for i in range(49))
    rows = [(1, f"{w} b c d e", "s"), (2, f"{v} b c d e", "s"), (3, f"{w} {rest}", "s"), (4, f"{v} {rest}", "s"), (5, f"{w} {rest}", "s"), (6, w, "s"), (7, v, "s")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows) and got[2][1] == 2 and got[5][1] == 3
    got = {r["doc_id"]: tuple(r[1:]) for r in window_dedup(frame(spark, rows), batches=2).collect()}
    assert got == brute_windows(rows, 50) and got[4][1] == 0 and got[5][1] == 50


def test_hashes_do_not_decide(spark, monkeypatch):
    """Where hashes fail, words are compared: with a hash of two bits the links and windows are still those of brute force."""
    rows = [r for r in corpus(11, 60, 40) if len(r[1] or "") < 20_000]
    w = [f"t{i}" for i in range(60)]
    rows += [(500, " ".join(w), "s"), (501, " ".join(w[:30] + ["x"] + w[30:]), "s"), (502, " ".join(reversed(w)), "s")]
    want = brute_windows(rows, 50)
    index = WindowIndex(spark, buckets=4)
    texts = frame(spark, rows).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    index.add(texts)
    # All windows of all documents are sent to the comparison, as if their hashes were equal.
    every = [(i, [np.array([[0, len((t or "").split()) - 50]]).astype(np.int64).tobytes()]) for i, t, _ in rows if len((t or "").split()) >= 50]
    found = texts.join(spark.createDataFrame(every, "_hit long, _keys array<binary>"), F.col("_id") == F.col("_hit")).select("_id", "_text", "_keys")
    gone = removed_words(texts, compared_windows(found, 50, 4), 50)
    got = {r["_id"]: sum(b - a for a, b in zip(r["_starts"], r["_ends"], strict=True)) for r in gone.collect()}
    assert got == {i: n for i, (_, n, _) in want.items() if n}
    index.drop()
    # Sets whose hashes say that they are equal, with other words.
    from lodestone.llm.jaccard_join import verified

    grams = np.arange(2, dtype=np.uint32).tobytes()
    words = {1: b"a b c d e f ", 2: b"a b c d e g ", 3: b"a b c d e f ", 4: b"a b ", 5: b"a b "}
    sets = spark.createDataFrame([(i, 2, grams, w) for i, w in words.items()], "id long, n long, grams binary, words binary")
    pairs = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (5, 4)], "x long, y long")
    assert sorted(map(tuple, verified(pairs, sets, 80, 5).collect())) == [(3, 1), (5, 4)]


def test_suffix_filter_keeps_similar_pairs():
    """A pair that reaches the similarity passes all filters where its prefixes first meet; most others don't."""
    from lodestone.llm import jaccard_join as jj

    rng = np.random.default_rng(5)
    dropped = 0
    for _ in range(400):
        a = rng.choice(1 << 62, rng.integers(5, 300), replace=False).astype(np.uint64) * np.uint64(4)
        keep = rng.random(len(a)) < rng.choice([0.3, 0.85, 0.95])
        b = np.concatenate([a[keep], rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64) * np.uint64(4) + np.uint64(1)])
        if not keep.any():
            continue
        a, b = np.sort(a), np.sort(b)
        common = np.intersect1d(a, b)
        alike = 100 * len(common) >= 80 * (len(a) + len(b) - len(common))
        x = {k: [] for k in ("n", "at", "suffix")}
        for s in (a, b):
            part, at = (s >> np.uint64(59)).astype(np.uint8), np.flatnonzero(s == common[0])
            x["n"].append(len(s))
            x["at"].append(int(at[0]))
            x["suffix"].append(jj._suffixes(part, np.bincount(part, minlength=jj.PARTS).astype(np.uint32), at)[0])
        ok = jj._passes({k: np.array(v) for k, v in x.items()}, np.array([0]), np.array([1]), 80)[0]
        assert ok or not alike
        dropped += not ok
    assert dropped > 100


def test_index_in_two_sessions(spark, tmp_path):
    """An index that is opened again goes on as it was made, whatever the session's number of partitions."""
    rows = corpus(9, 120, 40)
    texts = frame(spark, rows).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    path, part = f"file://{tmp_path}/index", lambda lo, hi: texts.where((F.col("_id") >= lo) & (F.col("_id") < hi))
    want = {i: n for i, (_, n, _) in brute_windows(rows, 50).items() if n}
    first = WindowIndex(spark, path)
    first.add(part(0, 50))
    first.close()
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", 6)
    index = WindowIndex(other, path)
    assert (index.buckets, index.version, [lv for lv, _ in index.runs]) == (first.buckets, 1, [0])
    index.add(part(50, 100))
    stale = WindowIndex(spark, path)
    index.add(part(100, 200))
    assert [lv for lv, _ in index.runs] == [1, 0] and len(list((tmp_path / "index").glob("run-*"))) == 2
    with pytest.raises(FileExistsError):  # another writer was faster
        stale.add(part(100, 200))
    index = WindowIndex(other, path)
    got = {r["_id"]: sum(b - a for a, b in zip(r["_starts"], r["_ends"], strict=True)) for r in index.resolve(texts).collect()}
    assert got == want
    assert "Exchange" not in index._read(index.runs[0][1]).groupBy("part").cogroup(index._read(index.runs[1][1]).groupBy("part")).applyInArrow(lambda a, b: a, "part int, id long, keys binary, docs binary")._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert not (tmp_path / "index").exists()


def long_text(rng, size: int) -> str:
    return " ".join(f"w{n}" for n in rng.integers(0, 5000, size // 6).tolist())


def test_long_documents_in_pieces(spark, monkeypatch):
    """Documents longer than a piece: results are those of brute force, wherever pieces end."""
    from lodestone.llm import suffix_dedup

    rng = np.random.default_rng(2)
    a, b = long_text(rng, 4000), long_text(rng, 3000)
    rows = [(1, a, "s"), (2, b[:900] + a[500:1700] + b[900:], "s"), (3, "é" + a[3:] + b, "s"), (4, a + a, "s")]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    got = {r["doc_id"]: tuple(r[1:]) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == brute_substrings(rows, 50)


def test_memory_of_long_documents():
    """Arrays of a document of 32 MB that shares everything stay within a bound."""
    from lodestone.llm import suffix_dedup
    from lodestone.llm.grid import slices
    from lodestone.llm.jaccard_join import shingles
    from lodestone.llm.window_index import _windows

    text = pa.array([long_text(np.random.default_rng(3), 32 << 20)])
    size = len(text[0].as_py())

    def peak(work) -> float:
        gc.collect()
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    def spans():
        for s in slices(text, suffix_dedup.PIECE, 49):
            _, doc, _, h = suffix_dedup._anchors(s, 50, 20)
            suffix_dedup._spans(s, [np.unique(suffix_dedup.keyed(h, 16))], 16, 50, 20)

    assert peak(spans) < 6
    assert peak(lambda: [shingles(s) for s in slices(text)]) < 40
    assert peak(lambda: [_windows(s, 50, 25) for s in slices(text)]) < 40


def test_index_is_incremental(spark):
    """A later batch is judged by the runs of the earlier ones; runs are compacted."""
    rows = corpus(7, 150, 40)
    index = WindowIndex(spark)
    texts = frame(spark, rows).select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))
    for lo in range(0, 180, 40):
        index.add(texts.where((F.col("_id") >= lo) & (F.col("_id") < lo + 40)))
        assert len(index.runs) <= 3
    got = {r["_id"]: sum(b - a for a, b in zip(r["_starts"], r["_ends"], strict=True)) for r in index.resolve(texts).collect()}
    assert got == {i: n for i, (_, n, _) in brute_windows(rows, 50).items() if n}
    index.drop()
