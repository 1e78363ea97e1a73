"""Classifiers, scans, filters and the mix."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as dc
from lodestone.llm import language_id, quality
from lodestone.llm.language_id import identify_language, learn_profiles
from lodestone.llm.license_scan import BASE_PHRASES, NOTICES, Scanner, license_digest, normalised, scan_licenses, seeds
from lodestone.llm.mixing import mix_sources, source_targets
from lodestone.llm.quality import FEATURES, classify_quality, fit_additive, train_quality
from lodestone.llm.url_filter import BROADCAST_BLOCKS, block_count, possible, rules_frame, url_filter

SMALL = "/root/testdata/sf0.01"


def tables(spark, *names):
    return [spark.read.parquet(f"{SMALL}/{n}.parquet") for n in names]


def odd(spark):
    """Rows that are hard to handle: nulls, blanks, repeats, a long text, clashing names."""
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (3, " \n", None), (None, "a text without an id", "x"), (4, "123 !!!", "x"), (5, "word " * 50_000, "x"), (6, "é😀" * 10, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, _text string").withColumn("_id", F.lit("clash")).withColumn("score", F.lit(1))


# Quality


def test_quality_held_out(spark):
    docs, labels = tables(spark, "documents", "labels")
    got = classify_quality(docs, train_quality(docs, labels)).join(labels, "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95 and len(out) > 50
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_quality_defined_cases(spark):
    docs, labels = tables(spark, "documents", "labels")
    rows = classify_quality(odd(spark), train_quality(docs, labels)).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [None]
    empty = train_quality(docs, labels.where("false"))
    assert {r["score"] for r in classify_quality(docs, empty).collect()} == {0.5}
    assert classify_quality(odd(spark).where("false"), empty).count() == 0
    one = labels.where("quality = 1").unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    assert min(r["score"] for r in classify_quality(docs, train_quality(docs, one)).collect()) > 0.9


def test_additive_model_learns_pairs():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, paired = fit_additive(x, y, n_pairs=0), fit_additive(x, y)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.7 < 0.95 < ((paired.score(x) > 0.5) == y).mean()
    assert (0, 1) in paired.pairs


def test_quality_rows_are_bounded(spark):
    """At most max_rows rows are fitted, also where one labelled identifier is on many documents."""
    docs = spark.range(3000).select(F.lit(3).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).union(spark.createDataFrame([(i, f"words of {i} and more") for i in range(4, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 60)], "doc_id long, quality int")
    seen = []
    fit, quality.fit_additive = quality.fit_additive, lambda x, y: seen.append((x, y)) or fit(x, y, rounds=1)
    try:
        train_quality(docs, labels, max_rows=10)
    finally:
        quality.fit_additive = fit
    ((x, y),) = seen
    ids = sorted((i for i in range(3, 60) if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:10]
    assert x.shape == (10, len(FEATURES)) and y.tolist() == [i % 2 for i in ids]


def plain_features(text):
    """The features of one text, counted with strings."""
    raw = text.encode()
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x]
    letters = sum(chr(b).isalpha() for b in raw if b < 128)
    n, m, counts = max(len(raw), 1), max(len(words), 1), Counter(words)
    share = lambda chars: sum(chr(b) in chars for b in raw if b < 128)
    return {
        "log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / m,
        "upper": sum(65 <= b <= 90 for b in raw) / max(letters, 1), "digit": sum(48 <= b <= 57 for b in raw) / n,
        "shout": share("!?") / n, "stop": share(".,;:") / m, "space": share(" \t\n\r\x0b\x0c") / n, "line_words": len(words) / max(len(lines), 1),
        "non_ascii": sum(b > 127 for b in raw) / n, "distinct_words": len(counts) / m, "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / m,
        "top_word": max(counts.values(), default=0) / m, "dup_lines": sum(c - 1 for c in Counter(lines).values()) / max(len(lines), 1),
        "longest_word": np.log1p(max(map(len, words), default=0)), "same_next": sum(a == b for a, b in zip(raw, raw[1:])) / n,
        "capitalised": sum(65 <= w[0] <= 90 for w in raw.split()) / m,
    }


def test_quality_against_plain_statement():
    """Features and score of single texts, also where several share a batch."""
    texts = ["Hello there, hello THERE!\nA line.\nA line.\n\n1234 one one", "", "é" * 50, "x" * 300 + " y", " \n \n", "Word. word? WORD!"]
    x = quality.text_features(pa.array(texts))
    for row, t in zip(x, texts, strict=True):
        for name, value in plain_features(t).items():
            assert row[FEATURES.index(name)] == pytest.approx(value, abs=1e-6), (t[:20], name)
    rng = np.random.default_rng(1)
    data = rng.random((500, len(FEATURES)))
    model = fit_additive(data, (data[:, 0] + data[:, 3] > 1).astype(float), rounds=20)
    for row, got in zip(data[:50], model.score(data[:50]), strict=True):
        total = model.intercept + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            total += t[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


# Languages


def test_language_held_out(spark):
    (docs,) = tables(spark, "documents")
    got = identify_language(docs, learn_profiles(docs)).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and len(got) > 100


def test_language_against_plain_statement(spark):
    """Ranks and distances of one document, counted with strings."""
    docs = spark.createDataFrame([(1, "The cat and the hat, the bat!", "en"), (2, "le chat et le rat été", "fr"), (3, "un chat", None), (10, "the chat", "en")], "doc_id long, text string, lang string")
    p = learn_profiles(docs)

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        out = Counter()
        joined = "_" + "_".join(words) + "_"
        for n in (1, 2, 3, 4, 5):
            for i in range(len(joined) - n + 1):
                g = joined[i : i + n]
                if g != "_" and "_" not in g[1:-1]:
                    out[g] += 1
        return out

    def key(g):
        return int(language_id.grams(np.array([1 if c == "_" else ord(c) for c in g]))[len(g) - 1][0])  # ties are in no order a reader would know

    def ranks(counts):
        return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], key(g)))[:300])}

    learnt = {"en": grams("The cat and the hat, the bat!") + (grams("the chat") if zlib.crc32(b"10") % 5 else Counter()), "fr": grams("le chat et le rat été")}
    assert zlib.crc32(b"1") % 5 and zlib.crc32(b"2") % 5
    mine = ranks(grams("un chat"))
    apart = {lang: sum(abs(r - theirs[g]) if g in theirs else 300 for g, r in mine.items()) for lang, c in learnt.items() for theirs in [ranks(c)]}
    row = identify_language(docs, p).where("doc_id = 3").first()
    assert row["lang_pred"] == min(apart, key=apart.get)
    assert row["score"] == pytest.approx(1 - min(apart.values()) / 300 / len(mine), abs=1e-9)


def test_language_any_alphabet(spark):
    """Scripts of thousands of letters don't push each other out, and the number of languages is bounded."""
    rng = random.Random(6)
    scripts = {"zh": (0x4E00, 4000), "zz": (0x4E00 + 4000, 4000), "ko": (0xAC00, 5000), "yi": (0xA000, 1000), "am": (0x1200, 300), "en": (97, 26)}
    text = lambda lang: " ".join("".join(chr(scripts[lang][0] + min(int(rng.expovariate(4) * scripts[lang][1]), scripts[lang][1] - 1)) for _ in range(4)) for _ in range(120))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(scripts) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_language(docs, learn_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    limit, language_id.MAX_LANGS = language_id.MAX_LANGS, 3
    try:
        with pytest.raises(ValueError):
            learn_profiles(docs)
    finally:
        language_id.MAX_LANGS = limit


def test_language_defined_cases(spark):
    (docs,) = tables(spark, "documents")
    p = learn_profiles(docs)
    got = identify_language(odd(spark), p).collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)] == ["und"] * 5
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    none = learn_profiles(docs.where("false"))
    assert {r["lang_pred"] for r in identify_language(odd(spark), none).collect()} == {"und"}
    assert identify_language(odd(spark).where("false"), p).count() == 0


# Licenses


def test_license_base_against_plain_statement(spark):
    docs = ["Licensed under CC-BY, cc by cc by.", "the GNU General Public License; general  public-license", "all rights reserved all rights RESERVED", "occ by", "", None, "rights reserved", "éall rights reserved", "all rights\nreserved"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_digest(scan_licenses(df), "doc_id").collect()}
    for i, t in enumerate(docs):
        words = regex.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at = [(k, label) for p, label in BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(q := p.encode().split())] == q]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(at)), t
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and 0 <= r["score"] <= 1
        assert {x for _, x in at} <= set(r["labels"].split(","))


def test_license_edits():
    """Every notice is found with its allowed edits, wherever they fall."""
    rng, tried = random.Random(0), 0
    scanner = Scanner({}, NOTICES, 10)
    for notice, label in NOTICES.items():
        for _ in range(20):
            text = list(notice)
            for _ in range(len(notice) // 10):
                at = rng.randrange(len(text))
                kind = rng.randrange(3)
                text[at : at + 1] = [] if kind == 0 else [rng.choice("xyz")] if kind == 1 else [text[at], rng.choice("xyz")]
            words = rng.choices(["lorem", "ipsum", "dolor"], k=5)
            whole = " ".join(words) + " " + "".join(text) + " " + " ".join(words)
            if edits(notice.encode(), normalised(whole)) <= len(notice) // 10:  # joining spaces can cost one more
                assert label in {s[0] for s in scanner.scan(whole)[1]}, whole
                tried += 1
    assert tried > 200
    assert scanner.scan("nothing of the kind is said here")[1] == []
    assert "".join(s for s, _ in seeds("abcdefghij", 3)) == "abcdefghij"


def least_edits(a: bytes, b: bytes) -> list[int]:
    """Least edits of a in any part of b that ends at each place."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def test_license_spans_against_brute_force():
    """Every reported span has the edits it says, and every place within the budget is reported or overlaps a better span."""
    rng = random.Random(4)
    notices = {"mozilla public license": "mpl", "all rights reserved": "reserved", "eclipse public license": "epl"}
    scanner, seen = Scanner({}, notices, 10), 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            notice = list(rng.choice(list(notices)))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(notice))
                notice[at : at + 1] = rng.choice(["", "x", notice[at] + "y"])
            parts += ["".join(notice), *rng.choices(["public", "license", "rights", "word", "mozilla"], k=rng.randrange(3))]
        text = " ".join(parts)
        norm, spans = normalised(text), scanner.scan(text)[1]
        words = norm.split()
        for notice, label in notices.items():
            k = len(notice) // 10
            taken = np.zeros(len(norm) + 1, bool)
            starts = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            for name, first, last, e, base in spans:
                if name == label:
                    seen += 1
                    part = b" " + b" ".join(words[first : last + 1]) + b" "
                    assert not base and e <= k and min(least_edits(notice.encode(), part)) <= e
                    taken[starts[first] : starts[last + 1] + 1] = True
            for end, e in enumerate(least_edits(notice.encode(), norm)):
                assert e > k or taken[max(end - len(notice) - k, 0) : end + 1].any()
    assert seen > 200
    spans = scanner.scan("mozila public license mozilla public license")[1]
    assert [s[:4] for s in spans] == [("mpl", 0, 2, 1), ("mpl", 3, 5, 0)]
    assert scanner.scan("mozilla public house, all lights on")[1] == []


def test_license_defined_cases(spark):
    assert license_digest(scan_licenses(odd(spark)), "doc_id").count() == 8
    assert license_digest(scan_licenses(odd(spark).where("false")), "doc_id").count() == 0


# Decontamination


def edits(a: bytes, b: bytes) -> int:
    """Least edits of a in any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def in_words(text) -> bytes:
    return b" " + b"".join(w + b" " for w in regex.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()))


def brute_leaks(docs, items) -> Counter:
    want = Counter()
    for i, t in docs:
        body = in_words(t)
        for k, x in items:
            item = in_words(x)
            size = len(item) - 2
            budget = max(0, min(size // 10, (size - 8) // 8))
            if size > 0 and (e := edits(item, body)) <= budget:
                want[i, k, e] += 1
    return want


def test_decontamination_of_short_items(spark):
    """Items too short for a q-gram are found as whole words only, and longer ones begin and end where words do."""
    items = [(1, "a"), (2, "Ab"), (3, "ab cd"), (4, "question"), (5, "no-no"), (6, "ab"), (7, "!"), (8, "abcdefg"), (9, "été")]
    texts = ["a", "A b", "ab", "xab cd", "ab, CD", "questionnaire", "the question", "question", "no no no", "nono no", "", None, "b\na", "abcdefgh", "abcdefg", "cd ab", "ab", "cd", "l'été"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_leaks(list(enumerate(texts)), items) and got[5, 4, 0] == 0 and got[6, 4, 0] == 1
    row = dc.contaminated(df, spark.createDataFrame([(3, "ab cd")], "item_id long, text string")).where("doc_id = 4").first()
    assert (row["start"], row["end"]) == (0, 5)


def test_decontamination_of_long_texts(spark, monkeypatch):
    """A long document is searched in pieces, its matches are those of the whole."""
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 8))) for _ in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(20)] + [(100, "zz")]
    parts = []
    for i in range(60):
        parts += rng.choices(vocab, k=200) + [rng.choice(items)[1].replace("a", "ax", 1)]
    docs = spark.createDataFrame([(1, "  -- ".join(parts) + " zz"), (2, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    whole = rows()
    for size in (700, 1024):
        monkeypatch.setattr(dc, "PIECE", size)
        monkeypatch.setattr(dc, "POSTINGS", 50)
        assert rows() == whole and len(whole) > 10


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioustrn", k=rng.randrange(2, 7)))
    vocab = [word() for _ in range(50)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(6, 14))).capitalize() + ".") for i in range(12)] + [(50, "qzx"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randrange(40)))
        if i % 2:
            passage = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, len(passage) // 7)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice(["", "q", passage[at] + "q"])
            text = f"{text}, {''.join(passage)} {text}"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, items[0][1].upper()), (102, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_leaks(docs, items)
    got = Counter((r["doc_id"], r["item_id"], r["edits"]) for r in dc.contaminated(df, bench).collect())
    assert got == want and sum(want.values()) > 20 and any(e for _, _, e in want)
    kept = {r["doc_id"] for r in dc.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _, _ in want}


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = tables(spark, "documents", "benchmark")
    pairs = lambda: sorted(map(tuple, dc.contaminated(docs, bench).collect()))
    whole = pairs()
    kept = sorted(r["doc_id"] for r in dc.drop_contaminated(docs, bench).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 5000)
    assert pairs() == whole and len(whole) > 10
    clean = dc.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == kept
    assert dc.contaminated(docs.where("false"), bench).count() == 0 and dc.contaminated(docs, bench.where("false")).count() == 0
    assert dc.contaminated(odd(spark), bench).count() == 0 and dc.drop_contaminated(odd(spark), bench).count() == 8


def test_alignment_reports_the_place():
    item, text = b"the quick brown fox jumps", b"see how the quikc brown fox jumps over"
    e, a, b = dc.align(np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8), 6, 10, 4)
    assert (e, text[a:b]) == (2, b"the quikc brown fox jumps")


# Mix


def test_targets():
    assert source_targets([("a", 100), ("b", 100), (None, 100)], (3, 1, 2), 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert source_targets([("a", 10), ("b", 1000)], (3, 1), 1.5, 2) == [20, 1495]
    assert source_targets([("a", 0), ("b", 10)], (1, 1), 3, 2) == [0, 20] and source_targets([], (1,), 1.5, 2) == []


def test_mix_against_plain_statement(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(60)), rng.choice(["b", "a", "Z", "é", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mix_sources(df.repartition(7)).collect()}
    again = {r["doc_id"]: r["taken"] for r in mix_sources(df.repartition(2)).collect()}
    assert {i: r["taken"] for i, r in got.items()} == again
    size = {i: len(t.split()) for i, t, _ in rows}
    for source in ("Z", "a", "b", "é", None):
        mine = [i for i, _, s in rows if s == source]
        total, target = sum(size[i] for i in mine), got[mine[0]]["target"]
        assert all(got[i]["source_size"] == total and got[i]["size"] == size[i] for i in mine)
        assert abs(sum(got[i]["taken"] for i in mine) - target) <= 60
        assert all(got[i]["taken"] <= 2 * size[i] for i in mine)
        more = [got[i]["copies"] for i in mine]
        assert max(more) - min(more) <= 1
        whole = int(target // total)
        left = target - whole * total
        assert sum(got[i]["probability"] * size[i] for i in mine) == pytest.approx(left)
        rate = max((got[i]["probability"] / size[i] for i in mine if size[i]), default=0)
        assert all(got[i]["probability"] == pytest.approx(min(1, rate * size[i])) for i in mine)
        # The order, stated plainly: random odds over inclusion odds, cut at the place nearest to what is left.
        rank = lambda i: (lambda u, p: u / (1 - u) * (1 - p) / p)((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52, got[i]["probability"])
        words = 0
        assert left > 0 or all(got[i]["copies"] == whole for i in mine if size[i])
        for i in sorted((i for i in mine if size[i] and left > 0), key=rank):
            words += size[i]
            assert got[i]["copies"] == whole + (words - size[i] / 2 <= left)


def test_mix_inclusion_frequencies(spark):
    """Over many equal sources, documents are sampled about as often as their inclusion probability says."""
    sizes = [1, 2, 3, 5, 8, 8, 12, 20, 30, 90] * 3
    rows = [(s * 100 + i, "w " * n, f"s{s:04}") for s in range(600) for i, n in enumerate(sizes)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), share=0.3).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["size"], []).append((r["copies"], r["probability"]))
    assert len(got) == len(rows)
    for size, pairs in by.items():
        p = pairs[0][1]
        assert all(x[1] == pytest.approx(p) for x in pairs) and np.mean([c for c, _ in pairs]) == pytest.approx(p, abs=0.05), size
    chances = [by[n][0][1] for n in sorted(by)]
    assert chances == sorted(chances) and chances[0] < 0.02 < 0.4 < chances[-1] <= 1


def test_mix_defined_cases(spark):
    got = mix_sources(odd(spark).withColumnRenamed("_text", "source")).collect()
    assert len(got) == 8 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mix_sources(odd(spark).withColumnRenamed("_text", "source").where("false")).count() == 0


# URLs


def test_urls_against_plain_statement(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "www", "com", "net", "x-y"])
    rules = [(rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randrange(1, 4))), "/" + "/".join(part() for _ in range(rng.randrange(0, 3)))) for _ in range(300)]
    rules = list({(h, p): v for v, h, p in rules}.items())
    rules = [(v, h, p) for (h, p), v in rules] + [("block", None, "/"), (None, "a", "/"), ("block", "", "/")]
    urls = [None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com?x://b", "http://A.b.COM/a/b?q#f", "x://y://a.com/", "http://.com/a"]
    urls += [f"{rng.choice(['http', 'https'])}://{'.'.join(part() for _ in range(rng.randrange(1, 5)))}{rng.choice(['', '/', '/a/b', '/www/com/x', '?q=/a', '#f'])}" for _ in range(500)]
    df = spark.createDataFrame([(i // 2, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(map(str, url_filter(df, rules_frame(spark, rules)).collect()))
    want = []
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2]
        raw = regex.match(r"[^/?#]*", rest)[0]
        host, path = raw.lower(), regex.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if v and h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append(f"Row(page_id={i // 2}, host={host!r}, path={path!r}, rule={best[3]!r}, verdict={best[2]!r})" if best else f"Row(page_id={i // 2}, host={host!r}, path={path!r}, rule=None, verdict='allow')")
    assert got == sorted(want) and sum("rule=None" not in w for w in want) > 100


def test_url_filter_grows_with_the_list(spark):
    """The filter of a long list still tells nearly all keys that aren't listed, and loses none."""
    n = 3_000_000
    key = lambda name: spark.range(n).select(F.concat(F.lit(name), F.col("id"), F.lit(".com")).alias("host"), F.lit("/").alias("path"))
    listed, blocks = key("a"), block_count(n)
    assert blocks > BROADCAST_BLOCKS
    assert possible(key("b").limit(200_000), listed, blocks).count() < 2_000
    assert possible(listed.limit(200_000), listed, blocks).count() == 200_000


def test_urls_defined_cases(spark):
    pages = spark.createDataFrame([(None, "http://a/"), (None, "http://a/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter(pages, rules_frame(spark, [("block", "A", "/"), ("allow", "a", "/")])).collect()] == ["block"] * 2
    assert {r["verdict"] for r in url_filter(pages, rules_frame(spark, [("block", "a", "/")]).where("false"), default="block").collect()} == {"block"}
    assert url_filter(pages.where("false"), rules_frame(spark, [("block", "a", "/")])).count() == 0
