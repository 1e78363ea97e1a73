"""Reading files: text, HTML, DOCX, PDF."""

from __future__ import annotations

import hashlib
import io
import os
import re
import subprocess
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .pdf import page_texts

REMOVED = {"script", "style", "nav", "footer"}
BLOCKS = {"p", "div", "section", "article", "header", "main", "aside", "ul", "ol", "table", "tr", "form", "figure", "blockquote", "title", "body", "html", "head"}
#: Files of a batch that a worker holds as Python objects at a time.
SLICE = 64
EMPTY = {"meta", "link", "img", "input", "hr", "br", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Markdown(HTMLParser):
    """Collects Markdown: ATX headings, fenced code, lists, links, emphasis."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []  # elements that aren't closed yet
        self.hidden = 0  # how many of them, from the outermost that is removed on
        self.pre = 0
        self.lists: list[list] = []
        self.links: list[str | None] = []

    def _block(self, n: int = 2) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        if tag not in EMPTY:
            self.open.append(tag)
        if self.hidden or tag in REMOVED:
            self.hidden += tag not in EMPTY
            return
        attrs = dict(attrs)
        if re.fullmatch("h[1-6]", tag):
            self._block()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n* * *\n\n")
        elif tag == "pre":
            self._block()
            self.out.append("```\n")
            self.pre += 1
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag in ("ul", "ol"):
            self._block(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "    " * max(len(self.lists) - 1, 0) + ("*   " if kind[0] == "ul" else f"{kind[1]}.  "))
        elif tag == "a":
            self.links.append(attrs.get("href"))
            if self.links[-1]:
                self.out.append("[")
        elif tag == "img" and attrs.get("src"):
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs['src']})")
        elif tag in BLOCKS:
            self._block()

    def handle_endtag(self, tag):
        if tag in self.open:  # it ends what was opened in it, too
            closed = len(self.open) - self.open[::-1].index(tag) - 1
            outer = len(self.open) - self.hidden
            del self.open[closed:]
            was, self.hidden = self.hidden, max(len(self.open) - outer, 0)
            if was and closed >= outer:
                return
        elif self.hidden:
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            if self.out and not self.out[-1].endswith("\n"):
                self.out.append("\n")
            self.out.append("```")
            self._block()
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._block(1 if self.lists else 2)
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href:
                self.out.append(f"]({href})")
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCKS:
            self._block()

    def handle_data(self, data):
        if self.hidden:
            return
        self.out.append(data if self.pre else re.sub(r"[ \t\r\n]+", " ", data))

    def text(self) -> str:
        parts = re.split(r"(```\n.*?```)", "".join(self.out), flags=re.S)
        for i in range(0, len(parts), 2):
            body = re.sub(r"[ \t]*\n[ \t]*(?![ \t]*(?:\*   |\d+\.  ))", "\n", parts[i])
            parts[i] = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", body))
        return re.sub(r"\n{3,}(?=```)", "\n\n", "".join(parts)).strip()


def html_markdown(raw: str) -> str:
    parser = _Markdown()
    parser.feed(raw)
    parser.close()
    return parser.text()


def html_to_markdown(html: Column) -> Column:
    """HTML as Markdown, without scripts, styles, navigation and footers; null stays null.

    Covers headings, paragraphs, lists, links, emphasis, code and images;
    tables come out as lines."""

    @F.arrow_udf("string")
    def convert(raw: pa.Array) -> pa.Array:
        return pa.array([None if r is None else html_markdown(r) for r in raw.to_pylist()], pa.string())

    return convert(html)


def html_strip(html: Column) -> Column:
    """HTML without the same elements, comments and tags, white space joined: no Python."""
    bare = html
    for tag in sorted(REMOVED):
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, a blank line after each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = ""
        for node in p.iter():
            text += (node.text or "") if node.tag == f"{_W}t" else "\t" if node.tag == f"{_W}tab" else "\n" if node.tag == f"{_W}br" else ""
        out.append(text)
    return "".join(t + "\n\n" for t in out)


@lru_cache(maxsize=1)
def ocr_languages() -> str | None:
    """Languages that the installed OCR tools offer of those wanted, joined; None without the tools."""
    try:
        subprocess.run(["pdftoppm", "-v"], capture_output=True, timeout=30)
        said = subprocess.run(["tesseract", "--list-langs"], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    have = {x.strip() for x in (said.stdout + "\n" + said.stderr).splitlines()}
    return "+".join(x for x in ("jpn", "eng") if x in have) or None


def ocr_pdf(content: bytes, langs: str, pages: int = 200, seconds: int = 60) -> str:
    """Text of the images of the first ``pages`` pages of a PDF; a page that fails or takes longer is empty.

    Rendering has so many seconds a page in all; without images the text is empty."""
    with tempfile.TemporaryDirectory() as top:
        source = os.path.join(top, "in.pdf")
        with open(source, "wb") as f:
            f.write(content)
        try:
            if subprocess.run(["pdftoppm", "-png", "-r", "200", "-l", str(pages), source, os.path.join(top, "p")], capture_output=True, timeout=seconds * pages).returncode:
                return ""
        except subprocess.SubprocessError:
            return ""
        out = []
        for name in sorted(x for x in os.listdir(top) if x.startswith("p-") and x.endswith(".png")):
            try:
                said = subprocess.run(["tesseract", os.path.join(top, name), "-", "-l", langs], capture_output=True, timeout=seconds)
                out.append(said.stdout.decode("utf-8", "replace") if not said.returncode else "")
            except subprocess.SubprocessError:
                out.append("")
        return "\n\n".join(out)


def is_sparse(text: str, pages: int) -> bool:
    return len(text.strip()) < 50 * max(1, pages)


def pdf_text(content: bytes) -> str:
    """Text layer of a PDF, or its OCR if that is longer where the layer is sparse."""
    pages = page_texts(content)
    text = "\n\n".join(pages)
    if is_sparse(text, len(pages)) and (langs := ocr_languages()):
        seen = ocr_pdf(content, langs)
        text = seen if len(seen.strip()) > len(text.strip()) else text
    return text


def _sha12(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:12]


def extract(path: str, content: bytes) -> tuple[str, str, int]:
    """Text, hash and size of a file's bytes, by its extension.

    Binary documents: the hash is of their bytes (as Latin-1 written in UTF-8),
    the size in bytes. Text and HTML: hash and size (UTF-16 units) of the raw text."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".pdf", ".docx"):
        text = pdf_text(content) if ext == ".pdf" else docx_text(content)
        return text, _sha12(content.decode("latin-1").encode()), len(content)
    raw = content.decode("utf-8", "replace")
    text = html_markdown(raw) if ext in (".html", ".htm") else raw
    return text, _sha12(raw.encode()), len(raw.encode("utf-16-le")) // 2


def fingerprint(path: str, content: bytes) -> tuple[str, int]:
    """Hash and size of a file's bytes as :func:`extract` tells them; only binary documents are parsed, to learn whether they can be."""
    if os.path.splitext(path)[1].lower() in (".pdf", ".docx"):
        return extract(path, content)[1:]
    raw = content.decode("utf-8", "replace")
    return _sha12(raw.encode()), len(raw.encode("utf-16-le")) // 2


def extract_rows(rows: Iterable[tuple[str, bytes | None]], prints: bool = False) -> list[dict]:
    """Rows of EXTRACTED; with ``prints`` without texts."""
    out = []
    for path, content in rows:
        try:
            if content is None:
                with open(path, "rb") as f:
                    content = f.read()
            text, digest, size = (None, *fingerprint(path, content)) if prints else extract(path, content)
            out.append({"path": path, "text": text, "hash": digest, "size": size, "error": None})
        except Exception as e:  # unreadable files are counted, not fatal
            out.append({"path": path, "text": None, "hash": None, "size": None, "error": f"{type(e).__name__}: {e}"[:200]})
    return out


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE rows: what is made of a part is gone before the next."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


EXTRACTED = "path string, text string, hash string, size long, error string"
_ARROW = pa.schema([("path", pa.string()), ("text", pa.string()), ("hash", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def fingerprint_files(files: DataFrame) -> DataFrame:
    """``path, hash, size, error`` of files, without their texts."""
    return _extracted(files, True).drop("text")


def extract_files(files: DataFrame) -> DataFrame:
    """``path, text, hash, size, error`` of files; bytes come from a column ``content`` if there is one,
    else executors open the path (a file system that all of them mount)."""
    return _extracted(files, False)


def _extracted(files: DataFrame, prints: bool) -> DataFrame:
    has = "content" in files.columns
    rows = files.select("path", *(["content"] if has else []))

    def read(batches):
        for b in batches:
            for part in slices(b):
                contents = part.column("content").to_pylist() if has else [None] * part.num_rows
                yield pa.RecordBatch.from_pylist(extract_rows(zip(part.column("path").to_pylist(), contents, strict=True), prints), _ARROW)

    return rows.mapInArrow(read, EXTRACTED)
