from __future__ import annotations

import hashlib
import io
import os
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.queries import pdf_of
from lodestone.sources import extract
from lodestone.sources.collect import collect_files, collect_tracked
from lodestone.sources.extract import docx_text, extract_files, html_markdown, is_sparse
from lodestone.sources.globs import excluded_by_roots, find_glob, ignored
from lodestone.sources.pdf import page_texts


@pytest.fixture
def tree(tmp_path):
    for name in ("a.ts", "b.md", "c.bin", "image.png", "node_modules/x.ts", ".git/y.md", ".hidden/z.md", "src/deep.py", "__init__.py", ".env", "x.env", ".foo.ts", "gen/g.ts", "page one.html"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("content of the file\n" * 3)
    (tmp_path / "big.txt").write_bytes(b"x" * 500_000)
    (tmp_path / "fits.txt").write_bytes(b"x" * 499_999)
    (tmp_path / "big.pdf").write_bytes(b"x" * 10_000_000)
    (tmp_path / "fits.pdf").write_bytes(b"x" * 9_000_000)
    return tmp_path


def names(df, top):
    return sorted(r["path"].removeprefix(f"{top}/") for r in df.collect())


def test_collect(spark, tree):
    every = [".foo.ts", "__init__.py", "a.ts", "b.md", "fits.pdf", "fits.txt", "gen/g.ts", "page one.html", "src/deep.py", "x.env"]
    assert names(collect_files(spark, str(tree)), tree) == every
    assert names(collect_files(spark, str(tree), excludes=["gen/", "*.html", "b.md"]), tree) == [x for x in every if x not in ("gen/g.ts", "page one.html", "b.md")]
    assert names(collect_files(spark, str(tree / "a.ts")), tree) == ["a.ts"]
    assert collect_files(spark, str(tree / "missing")).count() == 0
    assert names(collect_files(spark, str(tree), extensions=[".md", ".pdf"]), tree) == ["b.md"]
    assert names(collect_tracked(spark, [str(tree / "src"), str(tree), str(tree / "nowhere")]), tree) == every


@pytest.mark.parametrize(
    ("patterns", "path", "want"),
    [
        (["b.ts"], "x/b.ts", True), (["gen/"], "gen/a.ts", True), (["gen/"], "gen", False), (["*.html"], "a/B.HTML", True), (["src"], "src/a/b.ts", True),
        (["/src"], "x/src/a", False), (["page*"], "page1.md", True), (["src/*"], "src/a.ts", True), (["src/*"], "x/src/a.ts", False), (["a/**/b"], "a/x/y/b", True),
        (["a/**/b"], "a/b", True), (["**/b"], "x/b", True), (["a/**"], "a/x/y", True), (["*.md", "!keep.md"], "keep.md", False), (["d/", "!d/keep.md"], "d/keep.md", True),
        (["f?o.[ab]"], "fxo.b", True), (["f[!x]o"], "fxo", False), ([r"\!x"], "!x", True), (["# x", ""], "# x", False), (["a.c"], "abc", False),
    ],
)
def test_globs(spark, patterns, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(ignored(F.col("p"), patterns)).first()[0] is want


def test_roots_and_find(spark):
    df = spark.createDataFrame([("/w/src/a.ts",), ("/w/b.html",), ("/other/page.html",), ("/w/page1.js",)], "path string")
    out = {r["path"]: r["x"] for r in df.select("path", excluded_by_roots(F.col("path"), ["/w", "/w/src"], ["*.html", "a.ts"]).alias("x")).collect()}
    assert out == {"/w/src/a.ts": True, "/w/b.html": True, "/other/page.html": False, "/w/page1.js": False}
    find = lambda g: [r["path"] for r in find_glob(df, g, "/w").collect()]
    assert find("*.html") == ["/other/page.html", "/w/b.html"]
    assert find("page*") == ["/other/page.html", "/w/page1.js"]
    assert find("src/*") == ["/w/src/a.ts"] and find("none") == []


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_extract(spark, tmp_path):
    raw = "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><h1>Title</h1><p>one <b>two</b></p><pre><code>x = 1\ny</code></pre><ul><li>a</li><li>b</li></ul><script>no()</script><footer>f</footer></body></html>"
    (tmp_path / "a.html").write_text(raw)
    (tmp_path / "b.docx").write_bytes(docx("Hello", "World"))
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "d.pdf").write_bytes(b"no pdf")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.html", "b.docx", "c.txt", "d.pdf", "gone.txt")], "path string")
    got = {r["path"].rsplit("/", 1)[1]: r for r in extract_files(files).collect()}
    html = got["a.html"]
    assert html["hash"] == hashlib.sha256(raw.encode()).hexdigest()[:12] and html["size"] == len(raw)
    assert "# Title" in html["text"] and "```\nx = 1\ny\n```" in html["text"] and "*   a" in html["text"] and "**two**" in html["text"]
    assert not any(x in html["text"] for x in ("menu", "no()", "p{}"))
    assert got["b.docx"]["text"] == "Hello\n\nWorld\n\n" and len(got["b.docx"]["hash"]) == 12
    assert got["c.txt"]["text"] == "plain � text"
    assert got["d.pdf"]["error"] and got["gone.txt"]["error"] and got["gone.txt"]["text"] is None
    assert docx_text(docx("a")) == "a\n\n" and html_markdown("") == ""
    assert is_sparse("x" * 49, 0) and not is_sparse("x" * 50, 1)


def test_hidden_elements_end_with_their_parents():
    """An element that is left open ends where its parent does, whether it is shown or not."""
    assert html_markdown("<div><nav>menu<ul><li>x</div><p>after</p>") == "after"
    assert html_markdown("<div><footer><p>small</div><p>one</p><footer>f<b>g</footer>two") == "one\n\ntwo"
    assert html_markdown("<nav><img src=x><br>menu</nav>text<script>a<b</script>") == "text"


def pdf(*pages, head=b"", font=b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"):
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%b] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), font]
    for i, p in enumerate(pages):
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * i), b"<< /Length %d >>\nstream\n%b\nendstream" % (len(p), p)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % (i, p) for i, p in enumerate(parts, 1)) + b"trailer << /Root 1 0 R %b>>\n%%%%EOF\n" % head


def test_pdf_text_layer():
    one = rb"BT /F1 12 Tf 72 720 Td (Hello \(big\) \101\n) Tj 0 -14 Td [(wor) -20 (ld) -300 (again)] TJ T* <e9e8> Tj ET"
    assert page_texts(pdf(one, b"", b"BT /F1 9 Tf (second) Tj ET % comment")) == ["Hello (big) A\n\nworld again\néè", "", "second"]
    special = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /uni4E2D /parenleft /x] >> >>"
    assert page_texts(pdf(b"BT /F1 1 Tf (ABCD) Tj ET", font=special)) == ["中(xD"]
    assert page_texts(pdf_of("añb\n😀 中")) == ["añb\n😀 中"] and page_texts(pdf_of("")) == [""]
    for bad in (b"no pdf", pdf(one, head=b"/Encrypt 9 0 R ")):
        with pytest.raises(ValueError):
            page_texts(bad)


def test_pdf_packed_objects():
    """Objects in a compressed stream with a predictor, as newer files have them."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /Contents [7 0 R 8 0 R] /Resources << /Font << /F 4 0 R >> /XObject << /X 9 0 R >> >> >>", b"<< /Type /Font /Subtype /TrueType >>"]
    places = [sum(len(p) + 1 for p in inner[:i]) for i in range(len(inner))]
    head = b" ".join(b"%d %d" % (i, at) for i, at in enumerate(places, 1)) + b" "
    body = head + b" ".join(inner) + b" "
    width = 16
    rows = [body[i : i + width].ljust(width) for i in range(0, len(body), width)]
    coded, above = b"", bytes(width)
    for i, row in enumerate(rows):
        kind = (0, 1, 2, 3, 4)[i % 5]
        left = bytes([0]) + row[:-1]
        corner = bytes([0]) + above[:-1]

        def near(a, b, c):
            return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]

        guess = [(0, a, b, (a + b) // 2, near(a, b, c))[kind] for a, b, c in zip(left, above, corner, strict=True)]
        coded += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    raw = zlib.compress(coded)
    stream = lambda head, data: b"<< %b /Length %d >>\nstream\r\n%b\nendstream" % (head, len(data), data)
    packed = stream(b"/Type /ObjStm /N 4 /First %d /Filter [/FlateDecode] /DecodeParms << /Predictor 15 /Columns %d >>" % (len(head), width), raw)
    hexed = stream(b"/Filter /ASCIIHexDecode", b"BT /F 1 Tf (one) Tj".hex().encode())
    parts = {5: packed, 7: hexed, 8: stream(b"", b"ET /X Do"), 9: stream(b"/Subtype /Form /Resources << >>", b"BT (two) Tj ET"), 10: stream(b"/Type /XRef /Root 1 0 R", b"")}
    assert page_texts(b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%b\nendobj\n" % x for x in parts.items())) == ["one\ntwo"]


TOOL = {
    "pdftoppm": '#!/bin/sh\n[ "$1" = -v ] && exit 0\necho "$@" >> "$LOG"\ncase "$(cat "$6")" in *slow*) sleep 9;; *broken*) exit 3;; esac\ntouch "$7-1.png" "$7-2.png"\n',
    "tesseract": '#!/bin/sh\n[ "$1" = --list-langs ] && { echo eng; echo deu; exit 0; }\ncase "$1" in *-1.png) echo "text of the first page, read from its image $4";; *) exit 1;; esac\n',
}


def test_ocr_of_scanned_pages(tmp_path, monkeypatch):
    """Pages without a text layer are rendered and read; a page that fails is empty; rendering is bounded."""
    for name, script in TOOL.items():
        (tmp_path / name).write_text(script)
        (tmp_path / name).chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:{os.environ['PATH']}")
    monkeypatch.setenv("LOG", str(tmp_path / "log"))
    extract.ocr_languages.cache_clear()
    try:
        assert extract.ocr_languages() == "eng"
        scan = pdf(b"q 1 0 0 1 0 0 cm Q", b"")
        assert extract.pdf_text(scan) == "text of the first page, read from its image eng\n\n\n"
        full = "words of a text layer that is long enough to be kept as it is, without any look at images of pages"
        assert extract.pdf_text(pdf_of(full)) == full
        assert extract.ocr_pdf(b"broken", "eng") == "" and extract.ocr_pdf(b"slow", "eng", pages=1, seconds=1) == ""
        assert "-l 7 " in [extract.ocr_pdf(b"x", "eng", pages=7), (tmp_path / "log").read_text()][1]
        assert extract.pdf_text(pdf(b"BT /F1 1 Tf (a layer of about as many words as the image, so it stays) Tj ET", b"")).startswith("a layer")
    finally:
        extract.ocr_languages.cache_clear()


def test_packed_and_extracted_in_slices(spark, monkeypatch):
    """However many files a batch has, few are held at a time; all come back, in order, empty and null ones too."""
    from lodestone import queries as base
    from lodestone.sources import extract

    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(150)]})
    assert [p.num_rows for p in extract.slices(batch)] == [64, 64, 22] and not list(extract.slices(batch.slice(0, 0)))
    texts = [f"text {i}\n\u00e9 line of it \U0001f600" if i % 10 else "" for i in range(150)]
    df = spark.createDataFrame([(f"/f{i}", t) for i, t in enumerate(texts)], "path string, text string").coalesce(1)
    for ext, pack in ((".docx", base.docx_of), (".pdf", base.pdf_of)):
        packs = base._packed(df, ext, pack)
        assert "ArrowEvalPython" not in packs._jdf.queryExecution().executedPlan().toString()
        rows = extract.extract_files(packs).collect()
        assert [r["path"] for r in rows] == [f"/f{i}{ext}" for i in range(150)] and not any(r["error"] for r in rows)
        assert [r["text"].strip().replace("\n\n", "\n") for r in rows] == texts
