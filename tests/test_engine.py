from __future__ import annotations

import datetime as dt
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import Engine
from lodestone.functions.embed import model_embedder, model_embedding
from lodestone.operators.fulltext import bm25
from lodestone.plans import config as cf
from lodestone.plans.engine import _only
from lodestone.plans.store import Change, Conflict, Store
from lodestone.streaming.ingest import index_stream


@pytest.fixture
def project(spark, tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    for name, text in (("auth.ts", "authenticate the user\nwith a password and a token\n"), ("pay.md", "payment of the invoice\nby the user, in euro\n"), ("empty.txt", "")):
        (root / name).write_text(text)
    clock = {"now": dt.datetime(2024, 1, 1, tzinfo=dt.UTC)}
    (tmp_path / "store").mkdir()
    return root, Engine(spark, str(tmp_path / "store"), now=lambda: clock["now"]), clock


def counts(done):
    return done["indexed"], done["chunks"], done["skipped"]


def test_life_cycle(project):
    root, engine, clock = project
    assert counts(engine.index_path(str(root))) == (3, 2, 0)
    assert counts(engine.index_path(str(root))) == (0, 0, 3)
    (root / "pay.md").write_text("refund of the invoice\nto the customer, in dollars\n")
    (root / "new.md").write_text("a new file with a line of text\n")
    assert counts(engine.refresh()) == (2, 2, 2)
    stats = engine.stats()
    assert (stats["total_chunks"], stats["total_files"], stats["embedded_count"], stats["coverage"]) == (3, 4, 3, 100)
    assert engine.search("refund").first()["file_path"].endswith("pay.md")
    os.remove(root / "new.md")
    engine.refresh()
    assert engine.stats()["total_files"] == 4  # a refresh removes nothing
    done = engine.rebuild()
    assert done["pruned"] == 1 and done["indexed"] == 3 and engine.stats()["total_files"] == 3
    engine.exclude("pay.md")
    assert engine.rebuild(force=True)["indexed"] == 2
    assert {r["path"].rsplit("/", 1)[1] for r in engine.store.table("files").collect()} == {"auth.ts", "empty.txt"}
    engine.clear()
    assert engine.stats()["total_chunks"] == 0 and engine.config.tracked_paths
    assert engine.inject("user") is None


def test_stale_and_inject(project):
    root, engine, clock = project
    engine.index_path(str(root))
    assert not engine.stats()["stale"]
    (root / "late.md").write_text("the late invoice of the user, paid at last\n")
    clock["now"] += dt.timedelta(hours=24)
    assert not engine.stats()["stale"]
    clock["now"] += dt.timedelta(seconds=1)
    assert engine.stats()["stale"]
    assert "late.md" in engine.inject("late invoice").first()["context"]
    assert not engine.stats()["stale"]
    engine.set_enabled(False)
    assert engine.inject("late invoice") is None and engine.search("late invoice").count()


def test_tools_and_status(project):
    root, engine, _ = project
    assert engine.tool_query("user").startswith("The index is empty")
    assert "nothing at" in engine.tool_index(str(root / "none"))
    assert engine.tool_index(str(root)).startswith("3 files are new or changed and were cut into 2 chunks")
    assert json.loads(engine.tool_query("invoice"))[0]["file"].endswith("pay.md")
    status = json.loads(engine.tool_status())
    assert status["files"] == 3 and status["coverage"] == "100%" and status["scope"] == "project"
    assert [r["path"].rsplit("/", 1)[1] for r in engine.find("*.md", str(root)).collect()] == ["pay.md"]
    assert engine.help()[0][0] == "index <path>"
    many = engine.search([("a", "invoice"), ("b", "password")], limit=1)
    assert {r["query_id"]: r["file_path"].rsplit("/", 1)[1] for r in many.collect()} == {"a": "pay.md", "b": "auth.ts"}


def test_extensions_and_excludes(project):
    _, engine, _ = project
    engine.ext_add("TeX")
    assert ".tex" in engine.ext_list()
    engine.ext_remove(".tex")
    assert ".tex" not in engine.ext_list() and not engine.config.exclude_extensions
    engine.ext_remove("md")
    assert ".md" not in engine.ext_list()
    engine.ext_reset()
    assert ".md" in engine.ext_list()
    assert engine.exclude("*.md") == ["*.md"] and engine.exclude("-*.md") == []
    with pytest.raises(ValueError):
        engine.exclude("-none")


FILES = "path string, hash string, chunks int, indexed timestamp, size long, embedded boolean"


def some_files(spark, *names):
    return spark.createDataFrame([(n, "h", 1, dt.datetime(2024, 1, 1), 2, True) for n in names], FILES)


def added(store, files, base=None):
    change = store.change(base)
    change.write("files", files, "path")
    return change


def test_store_is_atomic(spark, tmp_path):
    store, files = Store(spark, str(tmp_path / "s")), some_files(spark, "/a")
    added(store, files).commit({"k": "v"})
    old = store.snapshot()
    with pytest.raises(Exception):
        added(store, files.selectExpr("path", "raise_error('x') as hash", "chunks", "indexed", "size", "embedded")).commit()
    assert store.snapshot() == old and store.table("files").count() == 1
    store.change(clear=True).commit()
    assert store.table("files", old).count() == 1 and store.table("files").count() == 0
    store.vacuum()  # too young to go
    assert store.table("files", old).count() == 1
    store.vacuum(-1)
    assert store.snapshot().metadata == {"k": "v"} and not list((tmp_path / "s/data").iterdir())


def test_two_writers(spark, tmp_path):
    """Writers that start from one version: the second fails, and what the first wrote stays whole."""
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    added(one, some_files(spark, "/old")).commit()
    base = two.snapshot()
    first, second = added(one, some_files(spark, "/a"), base), added(two, some_files(spark, "/b"), base)
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    for store in (one, two):
        assert sorted(r["path"] for r in store.table("files").collect()) == ["/a", "/old"] and store.snapshot().version == 2
    added(two, some_files(spark, "/b")).commit()
    assert one.table("files").count() == 3 and not [p for p in (tmp_path / "s/manifests").iterdir() if p.suffix == ".tmp"]


def test_segments_are_merged(spark, tmp_path):
    """Many commits leave few segments; rows that were removed or replaced stay so."""
    store, want = Store(spark, str(tmp_path / "s")), {}
    for i in range(20):
        change = store.change()
        paths = [f"/{i % 7}", f"/new{i}"]
        gone = spark.createDataFrame([(f"/{i % 7}",), (f"/new{i - 3}",)], "path string")
        change.remove(gone)
        change.write("files", some_files(spark, *paths).withColumn("size", F.lit(i).cast("long")), "path")
        change.commit()
        want.pop(f"/new{i - 3}", None)
        want |= dict.fromkeys(paths, i)
        assert {r["path"]: r["size"] for r in store.table("files").collect()} == want
    segments = store.snapshot().segments["files"]
    assert [s[2] for s in segments] == [1, 1, 0, 0, 0, 0] and len(store.snapshot().removed) <= 12


def test_refresh_writes_what_changed(project):
    root, engine, _ = project
    for i in range(30):
        (root / f"f{i}.md").write_text(f"file number {i} has some words\nand one more line of text\n")
    engine.index_path(str(root))
    before = engine.store.snapshot()
    (root / "f3.md").write_text("file number three has other words\nand one more line of text\n")
    assert counts(engine.refresh())[0] == 1
    after = engine.store.snapshot()
    assert after.segments["chunks"][:-1] == before.segments["chunks"]
    new = engine.spark.read.parquet(f"{engine.store.root}/{after.segments['chunks'][-1][0]}")
    assert [r["file_path"].rsplit("/", 1)[1] for r in new.collect()] == ["f3.md"]
    assert engine.stats()["total_chunks"] == 32 and int(after.metadata["chunks"]) == 32
    stored = {r["chunk_id"] for r in engine.store.table("postings").select("chunk_id").distinct().collect()}
    assert stored == {r["id"] for r in engine.store.table("chunks").collect()}
    assert engine.search("three").first()["file_path"].endswith("f3.md")


def test_stored_search_equals_fresh(project):
    """Stored postings and figures give the scores that the chunks' texts give, also after changes."""
    root, engine, _ = project
    engine.index_path(str(root))
    (root / "pay.md").write_text("payment of two invoices\nby the user, in dollars and euro\n")
    (root / "more.md").write_text("the user sees an invoice, an invoice and a token\n")
    engine.refresh()
    at = engine.store.snapshot()
    n, length = int(at.metadata["chunks"]), int(at.metadata["length"])
    chunks = engine.store.table("chunks")
    asked = [("a", "the user"), ("b", "invoice"), ("c", "invoices"), ("d", "in euro")]
    plain = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25(chunks, asked).collect()}
    stored = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25(chunks, asked, engine.store.table("postings"), (n, length / n)).collect()}
    assert stored == pytest.approx(plain) and len(plain) > 4


def test_older_layout(project):
    """Postings of an older layout are told apart, not read as others; starting anew replaces them."""
    root, engine, _ = project
    engine.index_path(str(root))
    at = engine.store.snapshot()
    name = f"manifests/{at.version}.json"
    said = json.loads(engine.store.read_text(name))
    del said["layout"]
    engine.store.write_text(name, json.dumps(said))
    with pytest.raises(ValueError, match="rebuild"):
        engine.search("user")
    (root / "new.md").write_text("a new file with some words\n")
    with pytest.raises(ValueError, match="rebuild"):
        engine.refresh()
    engine.rebuild(force=True)
    assert engine.search("words").count()


def test_new_files_are_read_without_a_join(project):
    """Where all files are new, their texts aren't moved to be joined with their names."""
    _, engine, _ = project
    texts = engine.spark.createDataFrame([(f"/t/{i}", f"text number {i} of some") for i in range(5)], "path string, text string")
    assert "Join" not in _only(texts, None)._jdf.queryExecution().optimizedPlan().toString()
    done = engine.index_texts(texts)
    assert done["indexed"] == 5 and engine.index_texts(texts)["skipped"] == 5


def test_crash_inside_rebuild(project, monkeypatch):
    """A rebuild that fails leaves the index as it was; one that succeeds is one version."""
    root, engine, _ = project
    engine.index_path(str(root))
    (root / "pay.md").unlink()
    before, rows = engine.store.snapshot(), engine.store.table("files").count()
    for force in (False, True):
        with monkeypatch.context() as m:
            m.setattr(Change, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                engine.rebuild(force)
        assert engine.store.snapshot() == before and engine.store.table("files").count() == rows and engine.stats()["coverage"] == 100
    engine.rebuild(force=True)
    assert engine.store.snapshot().version == before.version + 1 and engine.stats()["total_files"] == 2


def test_unreadable_targets_stay_dirty(project):
    root, engine, _ = project
    engine.index_path(str(root))
    (root / "pay.md").rename(root / "pay.pdf")
    (root / "pay.pdf").write_bytes(b"no pdf at all")
    assert counts(engine.refresh()) == (0, 0, 3)
    good = root / "note.docx"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a note of some words in it</w:t></w:r></w:p></w:body></w:document>')
    assert counts(engine.refresh())[0] == 1
    good.write_bytes(b"broken")
    done = engine.rebuild()
    assert done["skipped"] == 2 and done["indexed"] == 2 and done["pruned"] == 1
    files = {r["path"].rsplit("/", 1)[1]: r["embedded"] for r in engine.store.table("files").collect()}
    assert files == {"auth.ts": True, "empty.txt": True, "note.docx": False} and engine.search("note").count() > 0


def test_progress_completions_and_view(project):
    root, engine, _ = project
    seen = []
    engine.progress = lambda event, what: seen.append((event, what))
    engine.index_path(str(root))
    assert [e for e, _ in seen] == ["file"] * 3 + ["chunk", "embed", "save"]
    assert {w["path"].rsplit("/", 1)[1] for e, w in seen if e == "file"} == {"auth.ts", "pay.md", "empty.txt"} and seen[2][1]["current"] == seen[2][1]["total"] == 3
    assert [c for c, _ in engine.completions("re")] == ["rebuild", "refresh"] and engine.completions("zz") is None
    assert {"on", "off", "index"} <= {c for c, _ in engine.completions()}
    view = engine.search_view("invoice")
    assert "(hybrid BM25 and vectors)" in view[0] and any("pay.md" in line for line in view)
    change = engine.store.change()
    change.remove(engine.store.table("files"), ("vectors",))
    change.commit()
    assert "(BM25 only)" in engine.search_view("invoice")[0] and "Nothing" in engine.search_view("absent")[0]


def test_project_store(spark, project, tmp_path, monkeypatch):
    """Indexing makes a store of the project where none is in scope; other commands don't."""
    root, _, _ = project
    home = tmp_path / "home"
    work = home / "work"
    work.mkdir(parents=True)
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv(cf.STORE_VARIABLE, raising=False)
    monkeypatch.chdir(work)
    engine = Engine(spark)
    assert engine.status()["scope"] == "global" and not (work / cf.FOLDER).exists()
    engine.index_path(str(root))
    assert engine.status()["scope"] == "project" and (work / cf.FOLDER / "config.json").exists() and engine.stats()["total_files"] == 3
    assert Engine(spark).stats()["total_files"] == 3


def test_config_on_any_file_system(spark, tmp_path):
    """The configuration goes where the index goes, by URI."""
    engine = Engine(spark, f"file://{tmp_path}/remote")
    engine.ext_add("tex")
    assert ".tex" in Engine(spark, f"file://{tmp_path}/remote").ext_list() and (tmp_path / "remote/config.json").exists()


def test_engine_with_a_model(spark, tmp_path):
    """An engine takes a model: 64 texts a pass, in order."""
    passes = str(tmp_path / "passes")

    def load():
        def model(texts):
            with open(passes, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 1.0, t.count("a")] for t in texts])

        return model

    engine = Engine(spark, str(tmp_path / "m"), embed_column=model_embedder(load), embed_query=lambda t: [len(t), 1.0, t.count("a")], model="lengths", dim=3)
    rows = [(f"/{i}", "a" * (30 + i)) for i in range(150)]
    engine.index_texts(spark.createDataFrame(rows, "path string, text string").coalesce(1))
    got = {r["chunk_content"]: r["embedding"] for r in engine.store.table("vectors").join(engine.store.table("chunks"), F.col("id") == F.col("chunk_id")).collect()}
    assert got == {t: [len(t), 1.0, len(t)] for _, t in rows}
    sizes = [int(x) for x in open(passes).read().split()]
    assert sum(sizes) == 150 and max(sizes) == 64 and engine.stats()["embedding_model"] == "lengths"
    df = spark.createDataFrame([(None,), ("",), ("aa",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(model_embedding(F.col("t"), load)).collect()] == [[0, 1, 0], [0, 1, 0], [2, 1, 2]]
    assert df.where("false").select(model_embedding(F.col("t"), load)).count() == 0
    with pytest.raises(Exception, match="one vector of 4"):
        df.select(model_embedding(F.col("t"), load, 4)).collect()


def test_legacy_import(project, tmp_path):
    _, engine, _ = project
    path = tmp_path / "index.json"
    chunk = {"id": "x-1", "file": "/x", "content": "some old text", "lineStart": 1, "lineEnd": 2, "hash": "h", "indexed": "2024-01-01T00:00:00.000Z", "tokens": 4}
    path.write_text("{bad")
    assert not engine.import_legacy(str(path)) and path.exists()
    path.write_text(json.dumps({"chunks": [chunk | {"vector": [0.5] * 384}, chunk | {"id": "x-2", "vector": [1.0]}], "files": {"/x": {"hash": "h", "chunks": 2, "indexed": "2024-01-01T00:00:00.000Z", "size": 9, "embedded": True}}, "lastBuild": "2024-01-01T00:00:00+00:00"}))
    assert engine.import_legacy(str(path)) and not path.exists()
    stats = engine.stats()
    assert (stats["total_chunks"], stats["embedded_count"], stats["total_files"]) == (2, 1, 1) and stats["last_build"].startswith("2024")


def test_config(tmp_path, monkeypatch):
    store = str(tmp_path)
    assert cf.load_config(store) == cf.Config()
    (tmp_path / "config.json").write_text('{"top_k": 9, "unknown": 1}')
    assert cf.load_config(store).top_k == 9 and cf.load_config(store).alpha == 0.4
    (tmp_path / "config.json").write_text("{")
    assert cf.load_config(store) == cf.Config()
    cf.save_config(store, cf.Config(tracked_paths=["/a"]))
    assert cf.load_config(store).tracked_paths == ["/a"]
    home, work = tmp_path / "home", tmp_path / "home/w/deep"
    work.mkdir(parents=True)
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv(cf.STORE_VARIABLE, raising=False)
    monkeypatch.chdir(work)
    legacy = tmp_path / "old"
    legacy.mkdir()
    (legacy / "kept").touch()
    assert cf.resolve_store(legacy=str(legacy)) == cf.global_store() and os.path.exists(os.path.join(cf.global_store(), "kept"))
    (home / "w" / cf.FOLDER).mkdir()
    assert cf.resolve_store() == str(home / "w" / cf.FOLDER)
    monkeypatch.chdir(home)
    assert cf.resolve_store(create=True) == cf.global_store()
    monkeypatch.setenv(cf.STORE_VARIABLE, str(tmp_path / "named"))
    assert cf.resolve_store() == str(tmp_path / "named") and (tmp_path / "named").is_dir()


def test_stream(spark, project, tmp_path):
    _, engine, _ = project
    rows = spark.createDataFrame([("/s/a.txt", "the first text of the stream"), ("/s/b.txt", "the second text of the stream")], "path string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        query = index_stream(engine, source, str(tmp_path / "ck"))
        query.awaitTermination(120)
    assert engine.stats()["total_files"] == 2
