"""Registered queries against their SQL, and the pipeline against brute force."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries as llm

TABLES = "documents pages benchmark labels".split()


def plain(v):
    return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query_equals_sql(spark, sf, name):
    df = llm.queries()[name](spark, sf)
    got = df.collect()
    if name not in llm.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in cur.fetchall()]
    rows = lambda data: sorted(tuple(str(plain(r[c])) for c in sorted(columns)) for r in data)
    assert rows([r.asDict() for r in got]) == rows(want)


def test_stages(spark, sf, tmp_path):
    """Each stage keeps whole rows of what it gets, and drops what it must."""
    from test_dedup import brute_components, lower

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "mix":
            assert set(after) == set(before)
            break
        assert out.columns == docs.columns and all(before[k] == r for k, r in after.items())
        if name == "quality":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
            assert len(bad & set(after)) <= 0.1 * len(bad) and len(good - set(after)) <= 0.02 * len(good)
        if name == "exact dedup":
            first = {}
            for k in sorted(before):
                first.setdefault(lower(before[k]["text"]), k)
            assert set(after) == set(first.values())
        if name == "near dedup":
            comp = brute_components([(k, r["text"], None) for k, r in before.items()])
            assert set(after) == {k for k, (_, c) in comp.items() if c == k}
        if name == "decontamination":
            hit = {k for k, r in before.items() if any(x.lower() in r["text"].lower() for x in items)}
            assert hit and set(after) <= set(before) - hit and len(before) - len(after) <= len(hit) + 2
        docs = out


def plain_mix(spark, sf, docs):
    """The last stage by its own operator, over rows that brute force kept."""
    return {r["doc_id"]: r["taken"] for r in corpus_pipeline.mix(spark, docs, sf).collect()}


def test_run(spark, sf, tmp_path, monkeypatch):
    """The whole run equals its stages one after the other; one that is cut off goes on where it was."""
    want = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, sf).collect(), want.schema)
    want = plain_mix(spark, sf, want)
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and sum(v > 0 for v in got.values()) > 50
    folder, tried = f"file://{tmp_path}/stages", []

    def counting(name, stage, fail=False):
        def run(*a):
            tried.append(name)
            if fail:
                raise RuntimeError("the driver is lost")
            return stage(*a)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(*s, fail=s[0] == "near dedup") for s in stages])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counting(*s) for s in stages])
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf, folder).collect()} == want
    assert tried == ["quality", "exact dedup", "near dedup", "near dedup", "decontamination", "mix"]


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls, empties, ties, repeated ids, extra columns and empty tables go through all stages."""
    good = "The committee met again in the spring and wrote down what had been agreed so far. Nobody objected, and the minutes were sent out the next day."
    other = " ".join(f"Sentence number {i} says that the river was calm and the boats went out to sea." for i in range(6))
    rows = [
        (1, good, "en", "a", 0), (1, good, "en", "a", 0), (1, good.upper(), "en", None, 0), (2, good, None, "b", 0), (3, other, "en", "b", 0), (4, other + " So it was.", "en", "b", 0), (3, "a third text on an id that is there twice, of some words", "en", "b", 0),
        (None, good + " An end without an id.", "en", "a", 0), (None, None, None, None, None), (5, None, "en", "a", 0), (6, "", "en", "a", 0), (7, "word " * 30_000, "en", None, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("kept", F.lit("clash")).withColumn("_id", F.lit(5))
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "the river was quiet"), (2, None), (3, "")], "item_id long, text string")
    for name, d in (("odd", docs), ("none", docs.where("false"))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    # 1 once (equal texts), 2 equal to 1; 3 twice, 4 near 3; of the texts without words one; the null id with a text of its own and 7.
    assert [i for n, i in ids if not n] == [1, 3, 3, 5, 7] and sum(n for n, _ in ids) == 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
