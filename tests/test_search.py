from __future__ import annotations

import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions.embed import hash_embed, hashing_embedding
from lodestone.functions.text import token_list, tokens
from lodestone.operators import hybrid
from lodestone.operators.fulltext import PATH, bm25, bm25_topk, postings, write_postings
from lodestone.operators.vector_search import knn

CHUNKS = [
    ("a", "/src/auth.ts", "authenticate the user with a password and the token token token"),
    ("b", "/src/pay.ts", "payment of the user, foo.bar is called before foo bar"),
    ("c", "/src/café.ts", "Café au lait, the user pays; bar foo is not foo_bar"),
    ("d", "/src/user.ts", "process the user process processItem0 once and then once more with many other words in a longer chunk of text"),
    ("e", "/src/none.ts", "nothing to see"),
]


def chunks(spark, rows=CHUNKS):
    return spark.createDataFrame([(i, p, t, 1, 2, 5) for i, p, t in rows], "id string, file_path string, chunk_content string, line_start int, line_end int, tokens int")


QUERIES = ["user", "token", "the user", "foo.bar", "foo_bar foo", "cafe", "process process", "auth user", "ts once", "!!", "", "pay ... user", "nothing here"]


def fts5(query: str) -> dict[str, float]:
    """The same ranking by SQLite."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_content, file_path)")
    for i, (_, path, text) in enumerate(CHUNKS):
        db.execute("INSERT INTO t(rowid, chunk_content, file_path) VALUES (?, ?, ?)", (i, text, path))
    terms = " ".join('"' + t.replace('"', '""') + '"' for t in query.split())
    if not terms:
        return {}
    return {CHUNKS[i][0]: s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (terms,))}


def test_bm25_equals_fts5(spark, tmp_path):
    df = chunks(spark)
    asked = [(str(i), q) for i, q in enumerate(QUERIES)]
    write_postings(df, str(tmp_path / "postings"))
    for index in (None, spark.read.parquet(str(tmp_path / "postings"))):
        got = {}
        for r in bm25(df, asked, index).collect():
            got.setdefault(r["query_id"], {})[r["chunk_id"]] = r["score"]
        for i, q in asked:
            want = fts5(q)
            assert got.get(i, {}) == pytest.approx(want, abs=1e-9), q
    assert sum(len(v) for v in got.values()) > 15


def test_folding_equals_fts5(spark):
    """Letters and marks of all scripts below U+1F00 as of Unicode 3.2, each inside a word, are cut and folded as SQLite's tokenizer does."""
    chars = [chr(c) for c in range(0x80, 0x1F00) if unicodedata.ucd_3_2_0.category(chr(c))[0] == "L" and not 0x13A0 <= c < 0x1400 or 0x300 <= c < 0x370]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(ord(c), f"z{c}y") for c in chars])
    want: dict[str, list[str]] = {}
    for doc, term in db.execute("SELECT doc, term FROM v ORDER BY doc, offset"):
        want.setdefault(chr(doc), []).append(term)
    rows = spark.createDataFrame([(c, f"z{c}y") for c in chars], "c string, t string").select("c", tokens(F.col("t")).alias("t")).collect()
    apart = {r["c"] for r in rows if list(r["t"]) != want[r["c"]]}
    # Letters and cases that are younger than SQLite's tables (Cherokee's, for one) are left out.
    assert len(apart) <= 5 and not [c for c in apart if c < "\u0250"] and {c for c in chars if token_list(f"z{c}y") != want[c]} == apart
    assert token_list("Cafe\u0301 ÉTÉ Ṩ ạ ſ") == ["cafe", "ete", "ṩ", "a", "s"]


def test_postings_in_sorted_runs(spark, monkeypatch):
    """A row for each term of a chunk, with all its places, by term in each run; nothing is shuffled."""
    monkeypatch.setattr("lodestone.operators.fulltext.RUN_TOKENS", 30)
    df = chunks(spark, [*CHUNKS, ("f", "/!", "..."), ("g", "/src/none.ts", None)]).coalesce(1)
    made = postings(df, "line_start")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().replace("ReusedExchange", "")
    rows = made.collect()
    got = {(r["chunk_id"], r["term"]): (sorted(r["places"]), r["dl"], r["line_start"]) for r in rows}
    want = {}
    for i, path, text in [*CHUNKS, ("g", "/src/none.ts", "")]:
        words = [*enumerate(token_list(text)), *((PATH + n, t) for n, t in enumerate(token_list(path)))]
        for at, t in words:
            want.setdefault((i, t), ([], len(words), 1))[0].append(at)
    assert got == want and len(rows) == len(want)
    falls = sum(a["term"] > b["term"] for a, b in zip(rows, rows[1:], strict=False))
    assert 0 < falls < 5


def test_topk_and_empty(spark):
    top = bm25_topk(chunks(spark), [("q", "user")], 2).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["score"] <= top[1]["score"]
    assert bm25(chunks(spark).where("false"), [("q", "user")]).count() == 0
    assert postings(chunks(spark).where("false")).count() == 0


def test_knn(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)] + [(99, [1.0]), (98, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    got = knn(v, [("x", [3.0, 1.0]), ("y", [0.0, 0.0])], 3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [("x", 3), ("x", 2), ("x", 4), ("y", 0), ("y", 1), ("y", 2)]
    assert got[0]["distance"] == 0 and knn(v, [], 3).count() == 0


def search(spark, query, vectors=True, **kw):
    df = chunks(spark)
    v = df.select(F.col("id").alias("chunk_id"), hashing_embedding(F.col("chunk_content"), 32).alias("embedding"))
    v = v if vectors else v.where("false")
    return hybrid.hybrid_search(df, v, [("q", query)], [("q", hash_embed(query, 32))], **kw)


def test_hybrid_blend(spark):
    rows = search(spark, "the user", alpha=0.3).orderBy("rank").collect()
    assert len(rows) >= 3
    for r in rows:
        assert r["hybrid"] == pytest.approx(0.3 * r["bm25"] + 0.7 * r["vector"], abs=1e-9)
    assert [r["hybrid"] for r in rows] == sorted((r["hybrid"] for r in rows), reverse=True)
    assert len({r["bm25"] for r in rows}) >= 3
    assert search(spark, "the user", limit=2).count() == 2


def test_hybrid_without_vectors(spark):
    rows = search(spark, "the user", vectors=False).orderBy("rank").collect()
    best = min(fts5("the user").items(), key=lambda x: x[1])[0]
    assert rows[0]["id"] == best and rows[0]["bm25"] == 1
    assert all(r["hybrid"] == r["bm25"] and r["vector"] == 0 for r in rows)
    old = search(spark, "the user", vectors=False, orientation="reference").collect()
    assert best not in {r["id"] for r in old}
    assert search(spark, "absent", vectors=False).count() == 0


def test_boost_and_context(spark):
    boosted = {r["id"]: r["bm25"] for r in search(spark, "pay user", vectors=False).collect()}
    assert hybrid.boost_term("a pay user") == "pay" and hybrid.boost_term("a") is None
    assert boosted == {"b": 1.0}
    text = hybrid.inject_context(search(spark, "the user")).first()
    assert text["n_chunks"] >= 3 and "(lines 1-2)\n```\n" in text["context"]
    assert hybrid.inject_context(search(spark, "the user"), threshold=2).count() == 0
    assert '"scores":{"bm25":"' in hybrid.query_json(search(spark, "the user")).first()["json"]
    assert "score=" in hybrid.search_lines(search(spark, "the user")).first()["title"]


def test_embedder_in_slices(spark, monkeypatch):
    """Texts of more than one slice, with more words than are remembered, are embedded as on the driver."""
    monkeypatch.setattr("lodestone.functions.embed.ROWS", 3)
    monkeypatch.setattr("lodestone.functions.embed.HELD_WORDS", 4)
    texts = [None, *(" ".join(f"w{i * j % 13}" for j in range(i)) for i in range(20))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", hashing_embedding(F.col("t"), 8).alias("e")).collect()
    assert len(rows) == 21
    for r in rows:
        assert list(r["e"]) == pytest.approx(hash_embed(texts[r["i"]] or "", 8))


def test_embedder(spark):
    rows = spark.createDataFrame([("plants turn light into sugar",), ("",), (None,)], "t string").select(hashing_embedding(F.col("t"), 64).alias("e")).collect()
    assert list(rows[0]["e"]) == pytest.approx(hash_embed("plants turn light into sugar", 64))
    assert sum(x * x for x in rows[0]["e"]) == pytest.approx(1, abs=1e-6)
    assert set(rows[1]["e"]) == {0.0} and set(rows[2]["e"]) == {0.0}
