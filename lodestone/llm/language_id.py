"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grid import STEP, mix
from .shared import held_out

#: Grams in a profile, of a language and of a document.
PROFILE = 300
#: Longest gram, in characters.
LONGEST = 5
#: Most documents of a language that its profile is learnt from: those with the smallest md5 of the identifier.
MAX_DOCS = 2_000
#: Characters handled in one pass; a longer document comes in pieces, cut where no letter is.
PASS_CHARS = 1 << 18

#: Languages whose profiles the driver and the tasks may hold; more is an error, never a cut.
MAX_LANGS = 10_000

PAD = 1
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts as symbols: code points of letters, PAD for a run of others.

    Each text stands between PADs, so words are padded. Returns symbols, the
    place of the PAD before each text with that of the last one, and whether
    a text has a letter."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in lowered], np.int64))]).astype(np.int64)
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    letters = np.add.reduceat(letter.astype(np.int64), starts)[:-1]
    return np.where(letter, code, PAD)[keep].astype(np.int64), (np.cumsum(keep) - 1)[starts], letters > 0


def grams(sym: np.ndarray) -> list[np.ndarray]:
    """64-bit keys of the grams of 1 to LONGEST symbols that start at each symbol; 0 where none does.

    A gram has padding at its ends only and isn't padding alone. A key is a hash
    of the code points, so any alphabet goes."""
    out, key, pad = [], mix(sym.astype(np.uint64)), sym == PAD
    clear = ~pad  # no padding from the second symbol to the last but one
    for n in range(1, LONGEST + 1):
        m = max(len(sym) - n + 1, 0)
        if n > 1:
            key = mix(key[:m] * STEP + sym[n - 1 :].astype(np.uint64))
        if n > 2:
            clear = ~pad[1 : 1 + m] if n == 3 else clear[:m] & ~pad[n - 2 : n - 2 + m]
        some = ~pad if n == 1 else ~(pad[:m] & pad[1 : 1 + m]) if n == 2 else clear[:m]
        out.append(np.where(some, key[:m], np.uint64(0)))
    return out


@dataclass
class Profiles:
    """Language profiles over one vocabulary of grams.

    ``vocab`` holds the grams' keys, sorted; ``ranks[v, l]`` is the rank of gram
    v in language l, or PROFILE where l lacks it."""

    langs: list[str]
    vocab: np.ndarray
    ranks: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        row = 0
        while row < len(texts) and self.langs:
            chars, stop = 0, row
            while stop < len(texts) and (stop == row or chars + len(texts[stop] or "") <= PASS_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            for i, found in enumerate(counts_of([t or "" for t in texts[row:stop]]), row):
                if found is not None:
                    langs[i], scores[i] = self._nearest(*found)
            row = stop
        return langs, scores

    def _nearest(self, uniq: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        # Most frequent first, ties by key: both in one sortable number.
        order = (((np.int64(1) << 31) - 1 - count) << 32) | np.arange(len(uniq))
        if len(order) > PROFILE:
            order = np.partition(order, PROFILE - 1)[:PROFILE]
        order.sort()
        top = uniq[order & 0xFFFFFFFF]
        at = np.minimum(np.searchsorted(self.vocab, top), len(self.vocab) - 1)
        theirs = np.where((self.vocab[at] == top)[:, None], self.ranks[at], PROFILE)
        apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (PROFILE * len(top)))


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = min(at + PASS_CHARS, len(text))
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def counts_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Distinct grams of each text, in order of their keys, with counts; None for a text without a letter."""
    if len(texts) == 1 and len(texts[0]) > PASS_CHARS:
        uniq, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for piece in _pieces(texts[0]):
            for found in counts_of([piece]) if len(piece) <= PASS_CHARS else _counted([piece]):
                if found is not None:
                    keys, at = np.unique(np.concatenate([uniq, found[0]]), return_inverse=True)
                    uniq, count = keys, np.bincount(at, np.concatenate([count, found[1]]), len(keys)).astype(np.int64)
        yield (uniq, count) if len(uniq) else None
    else:
        yield from _counted(texts)


def _counted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    sym, bounds, has = symbols(texts)
    keyed = grams(sym) if has.any() else []
    for i in range(len(texts)):
        if not has[i]:
            yield None
            continue
        lo, hi = bounds[i], bounds[i + 1]  # the PADs around the text
        keys = np.concatenate([g[lo : max(hi + 2 - n, lo)] for n, g in enumerate(keyed, 1)])
        keys.sort()
        first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        count, uniq = np.diff(np.append(first, len(keys))), keys[first]
        yield (uniq[1:], count[1:]) if uniq[0] == 0 else (uniq, count)  # 0: places without a gram


def learn_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> Profiles:
    """Learn a profile for each language of the rows that aren't held out.

    Rows with a null language, id or text are not learnt from. At most
    ``max_docs`` documents a language, by md5 of the id, are counted; counting is
    distributed, and PROFILE grams a language come to the driver. More than
    MAX_LANGS languages raise an error.
    """
    lid = F.col(f"`{id_col}`")
    rows = docs.select(lid.alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    ranked = rows.withColumn("_rank", F.md5(F.col("_id").cast("string").cast("binary"))).withColumn("_bin", F.substring("_rank", 1, 3))
    # Counts of 4096 bins of the order tell where the cut lies; only rows up to its bin are ranked.
    bins = ranked.groupBy("_lang", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_lang").orderBy("_bin")) - F.col("_n")
    cut = bins.withColumn("_before", before).where(F.col("_before") < max_docs).groupBy(F.col("_lang").alias("_of")).agg(F.max("_bin").alias("_cut"))
    found = cut.limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    cut = docs.sparkSession.createDataFrame(found, cut.schema)
    near = ranked.join(F.broadcast(cut), (F.col("_lang") == F.col("_of")) & (F.col("_bin") <= F.col("_cut")))  # a row a language
    sample = near.withColumn("_nth", F.row_number().over(Window.partitionBy("_lang").orderBy("_rank", "_text"))).where(F.col("_nth") <= max_docs).select("_lang", "_text")

    def counted(batches):
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in by[lang]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in by[lang]]), len(keys)).astype(np.int64)
            del by[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist(), strict=True):
                by.setdefault(lang, []).extend(found for found in counts_of([text]) if found is not None)
                if sum(len(k) for k, _ in by[lang]) > PASS_CHARS:
                    yield rows(lang)
        for lang in [lang for lang in by if by[lang]]:
            yield rows(lang)

    counts = sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("shiftrightunsigned(gram, 32)"), F.expr("gram & 4294967295"))  # ties as of unsigned keys
    got = counts.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= PROFILE).collect()
    langs = sorted({r["lang"] for r in got})

    vocab, at = np.unique(np.array([r["gram"] for r in got], np.int64).view(np.uint64), return_inverse=True)
    ranks = np.full((len(vocab), len(langs)), PROFILE, np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    for v, r in zip(at, got, strict=True):
        ranks[v, number[r["lang"]]] = r["rank"] - 1
    return Profiles(langs, vocab, ranks)


def identify_language(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text by out-of-place distance.

    The PROFILE most frequent grams of a document (1 to LONGEST letters, words
    padded, case folded) are ranked; a gram costs the difference of its ranks in
    document and language, or PROFILE where the language lacks it. The language
    with the least sum wins; ties go to the first by name.

    Returns id, ``held_out``, ``lang_pred``, ``score`` (1 less the mean cost over
    PROFILE). A null text, or one without a letter, is ``und`` with score 0, and
    so is every text if no language was learnt. Equal rows each get a row; a null
    identifier has a null ``held_out``.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = profiles.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), predict(F.col(f"`{text_col}`")).alias("_p"))
    return rows.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
