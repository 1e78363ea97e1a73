from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators.chunker import chunk_documents, chunk_joined

WHITE = "\t\n\x0b\x0c\r \xa0    　﻿"


def chunked(text: str, most: int = 50) -> list[tuple[int, int, str]]:
    """The chunker, stated plainly."""
    lines, i, out = text.split("\n"), 0, []
    while i < len(lines):
        end = min(i + most, len(lines))
        for j in range(end - 1, i + 10, -1):
            if j <= end - 15:
                break
            if not lines[j].strip(WHITE):
                end = j + 1
                break
        body = "\n".join(lines[i:end])
        if len(body.strip(WHITE)) > 20:
            out.append((i + 1, end, body))
        i = end
    return out


def frame(spark, texts):
    return spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string")


@pytest.mark.parametrize("most", [50, 20, 8])
def test_chunker_equals_plain_statement(spark, most):
    rng = random.Random(most)
    texts = []
    for n in [0, 1, 2, 10, 11, 12, 13, 14, 49, 50, 51, 64, 65, 66, 120, 200, *(rng.randrange(1, 300) for _ in range(60))]:
        texts.append("\n".join(rng.choice(["", " \t", "\xa0", "word", "some longer line of text"]) if rng.random() < 0.3 else f"line {k} text" for k in range(n)))
    got = {}
    for r in chunk_documents(frame(spark, texts), max_lines=most).collect():
        got.setdefault(r["file_path"], []).append((r["line_start"], r["line_end"], r["chunk_content"]))
    assert {k: sorted(v) for k, v in got.items()} == {f"/f{i}": c for i, t in enumerate(texts) if (c := chunked(t, most))}


@pytest.mark.parametrize("most", [50, 8])
def test_joined_chunks_equal_those_of_the_joined_text(spark, most):
    rng = random.Random(most)
    docs = []
    for path in range(6):
        for i in rng.sample(range(1000), 1 + 12 * path):
            n = rng.choice([1, 1, 2, 5, 12, 60, 200])
            docs.append((f"/p{path}", i, "\n".join(rng.choice(["", " ", f"line {k} of the text {i}"]) for k in range(n)) if rng.random() < 0.9 else None))
    whole = {}
    for path, _, t in sorted(d for d in docs if d[2] is not None):
        whole[path] = f"{whole[path]}\n\n{t}" if path in whole else t
    got = {}
    for r in chunk_joined(spark.createDataFrame(docs, "path string, doc_id long, text string").repartition(3), "path", "doc_id", "text", most).collect():
        got.setdefault(r["file_path"], []).append((r["line_start"], r["line_end"], r["chunk_content"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, t in whole.items() if (c := chunked(t, most))}


def test_long_text_is_cut_in_linear_work(spark):
    """A text of many windows passes several runs of the fold, and lines aren't copied for each chunk."""
    lines = [f"line {i} of the text" if i % 7 else "" for i in range(20_000)]
    found = chunk_documents(frame(spark, ["\n".join(lines)]))
    got = sorted((r["line_start"], r["line_end"], r["chunk_content"]) for r in found.collect())
    assert got == chunked("\n".join(lines), 50) and len(got) > 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(_spans" in plan and "*(" in next(line for line in plan.split("\n") if "Generate explode" in line)


def test_chunker_examples(spark):
    blank = "\n".join("" if i == 44 else f"line {i} of the text" for i in range(80))
    rows = chunk_documents(frame(spark, ["a line of text\nanother line\nthe third", "tiny", blank, None])).orderBy("file_path", "line_start").collect()
    assert [(r["file_path"], r["line_start"], r["line_end"]) for r in rows] == [("/f0", 1, 3), ("/f2", 1, 45), ("/f2", 46, 80)]
    assert rows[0]["id"] == hashlib.sha256(b"/f0").hexdigest()[:12] + "-1"


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, tx.utf16_length(F.col("t")), t="a😀") == 3
    assert one(spark, tx.utf16_prefix(F.col("t"), 3), t="a😀b") == "a😀"
    assert one(spark, tx.utf16_prefix(F.col("t"), 2), t="a😀b") == "a"
    assert one(spark, tx.trim_white(F.col("t")), t="﻿\xa0 a b 　") == "a b"
    data = bytes(range(256))
    assert one(spark, tx.binary_sha12(F.col("t")), t=bytearray(data)) == hashlib.sha256(data.decode("latin-1").encode()).hexdigest()[:12]
    for ext, want in ((" .TeX ", ".tex"), ("cs", ".cs"), ("  ", "")):
        assert one(spark, tx.normalize_extension(F.col("t")), t=ext) == want
    for path, want in (("/a/.env", ""), ("/a/x.env", ".env"), ("/a.b/c", ""), ("/x/a.b.c", ".c")):
        assert one(spark, tx.extension(F.col("t")), t=path) == want
    for n, pages, want in ((49, 1, True), (50, 1, False), (149, 3, True), (150, 3, False), (49, 0, True), (50, 0, False)):
        assert one(spark, tx.sparse_text(F.col("t"), F.lit(pages)), t="x" * n) is want
    assert one(spark, tx.fold(F.col("t")), t="Café ÉCOLE") == "cafe ecole"


def test_vectors(spark):
    def cos(a, b):
        return spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(vx.cosine_similarity(F.col("a"), F.col("b"))).first()[0]

    assert cos([1.0, 0.0], [2.0, 0.0]) == pytest.approx(1)
    assert cos([1.0, 0.0], [0.0, 3.0]) == 0
    assert cos([1.0, 1.0], [-2.0, -2.0]) == pytest.approx(-1)
    assert cos([1.0], [1.0, 2.0]) == 0
    assert cos([0.0, 0.0], [1.0, 2.0]) == 0
    scale = lambda v: spark.createDataFrame([(v,)], "v array<double>").select(vx.minmax(F.col("v"))).first()[0]
    assert scale([10.0, 0.0, 5.0]) == [1, 0, 0.5]
    assert scale([3.0, 3.0, 3.0]) == [0, 0, 0]
    assert scale([7.0]) == [0]
