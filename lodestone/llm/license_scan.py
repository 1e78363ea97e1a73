"""License scans: fuzzy search for short notices."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that are searched word for word, and their labels (fixed values).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Short notices that are searched with edits, and their labels (fixed values).
NOTICES = {
    "general public license": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "attribution sharealike": "cc-by-sa",
    "attribution noncommercial": "cc-by-nc",
    "licensed under the apache license": "apache",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "spdx license identifier": "spdx",
    "this work is licensed under": "licensed",
}

#: One edit is allowed for so many characters of a notice.
CHARS_AN_EDIT = 10

SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("edits", T.IntegerType()), T.StructField("base", T.BooleanType()),
])

#: Bytes to search: A-Z lower-cased, other ASCII that is no letter or digit a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def normalised(text: str) -> bytes:
    """The words, each after one space, and a last space."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    return b" " + b" ".join(words) + b" " if words else b" "


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """``edits`` + 1 pieces and their places: whatever the edits, one piece stays exact."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(notice[a:b], a) for a, b in zip(cut, cut[1:], strict=False)]


class Scanner:
    """Finds base phrases exactly and notices with at most one edit in CHARS_AN_EDIT characters."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], chars_an_edit: int):
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base.items()]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate(notices.items()):
            notice = notice.encode().decode("latin-1")  # one character a byte, as in the text searched
            k = len(notice) // chars_an_edit
            self.notices.append((notice, label, k, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}")))
            for seed, offset in seeds(notice, k):
                at.setdefault(seed, []).append((i, offset))
        for seed, places in at.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """Number of words, and spans: label, first and last word, edits, whether a base phrase."""
        norm = normalised(text or "")
        n_words = norm.count(b" ") - 1
        places: list[tuple[str, int, int, int, bool]] = []  # as spans, but in bytes
        for phrase, label in self.base:
            p = norm.find(phrase)
            while p >= 0:
                places.append((label, p + 1, p + len(phrase) - 1, 0, True))
                p = norm.find(phrase, p + 1)
        flat = norm.decode("latin-1")
        regions: dict[int, list[list[int]]] = {}
        for end, (size, seeds_at) in self.seeds.iter(flat):
            for i, offset in seeds_at:
                notice, _, k, _ = self.notices[i]
                begin = end + 1 - size - offset
                lo, hi = max(begin - k, 0), min(begin + len(notice) + k, len(flat))
                mine = regions.setdefault(i, [])
                if mine and lo <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], hi)
                    mine[-1][0] = min(mine[-1][0], lo)
                else:
                    mine.append([lo, hi])
        for i, mine in regions.items():
            notice, label, k, pattern = self.notices[i]
            left = _joined(mine)
            while left:
                lo, hi = left.pop()
                if hi - lo < len(notice) - k or not (m := pattern.search(flat, lo, hi)):
                    continue
                a, b = m.span()
                left += [(lo, a), (b, hi)]  # what stands beside the best match may match too
                while a < b and flat[a] == " ":
                    a += 1
                while b > a and flat[b - 1] == " ":
                    b -= 1
                places.append((label, a, b, sum(m.fuzzy_counts), False))
        if not places:
            return n_words, []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(spaces, at, side="right")) - 1
        return n_words, sorted((label, word(a), word(b - 1), edits, base) for label, a, b, edits, base in places)


def _joined(regions: list[list[int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(regions):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


@lru_cache(maxsize=4)
def _scanner(base: tuple, notices: tuple, chars_an_edit: int) -> Scanner:
    return Scanner(dict(base), dict(notices), chars_an_edit)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    chars_an_edit: int = CHARS_AN_EDIT,
) -> DataFrame:
    """Search every whole text for license notices.

    Text and notices are compared as words: A-Z lower-cased, other ASCII between
    words one space. A notice of n characters may have n // chars_an_edit edits;
    it is split into one more exact seed than that, by the pigeonhole principle
    one of them survives, an automaton finds the seeds, and the regex library
    matches the notice with bounded errors around them. The best match of a region
    is taken, then what stands on either side of it is searched, so a place
    without a span of its notice overlaps a better one. Base phrases are found
    word for word.

    Returns id, ``n_words``, ``spans`` (label, first and last word from 0, edits,
    base), in that order.

    Defined cases: a null text has no words; overlapping places of a base phrase
    all count; fuzzy matches of one notice do not overlap; equal rows each get a
    row. The longest text is held whole, with its list of spans.
    """
    key = (tuple(base.items()), tuple(notices.items()), chars_an_edit)

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]))
    def scan(text: pa.Array) -> pa.Array:
        scanner = _scanner(*key)
        names = [f.name for f in SPAN]
        rows = []
        for t in text:
            n, spans = scanner.scan(t.as_py())
            rows.append({"n_words": n, "spans": [dict(zip(names, s, strict=True)) for s in spans]})
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span))]))

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), scan(F.col(f"`{text_col}`")).alias("_s"))
    return rows.select(F.col("_id").alias(id_col), F.col("_s.n_words").alias("n_words"), F.col("_s.spans").alias("spans"))


def license_digest(scanned: DataFrame, id_col: str) -> DataFrame:
    """Places, labels and score of each document from its spans.

    The score is that of the best span, 1 / (1 + edits / 4), so 1 for a
    word-for-word phrase; it is 0 without any span."""
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.array_max(F.transform("spans", lambda s: F.when(s["base"], 1.0).otherwise(1.0 / (1.0 + s["edits"] * 0.25))))
    return scanned.select(
        id_col, "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.greatest(F.lit(0.0), score), F.lit(0.0)).alias("score"),
    )
