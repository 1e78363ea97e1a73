"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: White space as ECMAScript trims it, inside a character class (fixed value).
WHITE = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

def _fold_table() -> tuple[dict[str, str], str]:
    """Lower-case letters that are searched as another, by Unicode's own data, and marks that are dropped.

    An ASCII letter with one diacritic is the letter; a letter with a simple case
    folding of its own is that. Marks that such letters decompose into are dropped."""
    letters, marks = {}, set()
    for c in map(chr, range(0x80, 0x1F00)):
        if c != c.lower() or unicodedata.category(c)[0] != "L":
            continue
        folded = c.casefold() if len(c.casefold()) == 1 and c.casefold().islower() else c
        split = unicodedata.normalize("NFD", folded)
        if len(split) == 2 and split[0].isascii() and split[0].isalpha() and unicodedata.category(split[1]) == "Mn":
            letters[c] = split[0]
            marks.add(split[1])
        elif folded != c:
            letters[c] = folded
    return letters, "".join(sorted(marks))


_LETTERS, _MARKS = _fold_table()
#: What is replaced, and by what; characters past the end of the second are dropped.
FOLD_FROM, FOLD_TO = "".join(_LETTERS) + _MARKS, "".join(_LETTERS.values())

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as ECMAScript counts it."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_prefix(text: Column, n: int) -> Column:
    """The first n UTF-16 units; a pair that the cut splits is left out.

    A string whose code points take one unit each is cut directly."""
    taken = F.aggregate(
        F.split(F.substring(text, 1, n), ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(
            F.when(acc["n"] + utf16_length(c) <= n, F.concat(acc["s"], c)).otherwise(acc["s"]).alias("s"),
            (acc["n"] + utf16_length(c)).alias("n"),
        ),
        lambda acc: acc["s"],
    )
    short = F.substring(text, 1, n)
    return F.when(utf16_length(short) <= n, short).otherwise(taken)


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def sha12(text: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the text in UTF-8."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def binary_sha12(content: Column) -> Column:
    """SHA-256 prefix of bytes read as Latin-1 and written as UTF-8."""
    return F.substring(F.sha2(F.encode(F.decode(content, "ISO-8859-1"), "UTF-8"), 256), 1, 12)


def token_estimate(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(utf16_length(text) / 4).cast("int")


def sparse_text(text: Column, pages: Column) -> Column:
    """Whether extracted text is too short for its pages: fewer than 50 units a page."""
    return utf16_length(trim_white(text)) < 50 * F.greatest(F.lit(1), pages)


def fold(text: Column) -> Column:
    """Case folded, Latin diacritics removed, whether in the letter or behind it."""
    lower = F.lower(text)
    # What is replaced lies beyond ASCII.
    return F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.translate(lower, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    """Folded runs of letters, digits and private-use characters."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), 1)


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_LETTERS) | dict.fromkeys(map(ord, _MARKS)))


def token_list(text: str) -> list[str]:
    """The tokens of one text, on the driver."""
    return re.findall("(?:[^\\W_]|[\ue000-\uf8ff])+", fold_text(text))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of the base name, with its dot; a leading dot starts none."""
    return F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1)


def normalize_extension(ext: Column) -> Column:
    """Trimmed, lower-cased, with a leading dot; blank stays empty."""
    bare = F.lower(trim_white(ext))
    return F.when(bare == "", "").when(F.startswith(bare, F.lit(".")), bare).otherwise(F.concat(F.lit("."), bare))


def search_preview(text: Column) -> Column:
    """The first three lines, cut to 200 units."""
    return utf16_prefix(F.array_join(F.slice(F.split(text, "\n", -1), 1, 3), "\n"), 200)
