"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .grid import Slice, run_bounds, slices, spans_hash, trim
from .shared import held_out

#: Most labelled rows that are fitted: one a labelled identifier, those with the smallest md5 of it.
MAX_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "symbol", "shout", "stop", "space", "line_words",
    "non_ascii", "distinct_words", "repeat_next", "top_word", "dup_lines", "ends_punct", "longest_word", "same_next", "capitalised",
)

_KIND = {name: np.zeros(256, np.float32) for name in ("upper", "alpha", "digit", "punct", "symbol", "shout", "stop", "space", "high", "newline")}
for _b in range(256):
    _c = chr(_b)
    _KIND["upper"][_b] = _b < 128 and _c.isupper()
    _KIND["alpha"][_b] = _b < 128 and _c.isalpha()
    _KIND["digit"][_b] = _b < 128 and _c.isdigit()
    _KIND["punct"][_b] = 32 < _b < 127 and not _c.isalnum()
    _KIND["symbol"][_b] = _c in "#$%&*+<=>@\\^_`{|}~/[]"
    _KIND["shout"][_b] = _c in "!?"
    _KIND["stop"][_b] = _c in ".,;:"
    _KIND["space"][_b] = _c in " \t\n\r\x0b\x0c"
    _KIND["high"][_b] = _b >= 128
    _KIND["newline"][_b] = _b == 10


def slice_features(s: Slice) -> np.ndarray:
    """One row of FEATURES for each document; zeros for an empty text."""
    out = np.zeros((s.n, len(FEATURES)), np.float64)
    if not len(s.buf):
        return out
    n_bytes = np.diff(s.offs).astype(np.float64)
    full = n_bytes > 0
    at = s.offs[:-1][full]
    per = {}
    for kind, table in _KIND.items():
        per[kind] = np.zeros(s.n)
        per[kind][full] = np.add.reduceat(table[s.buf], at, dtype=np.float64)
    start, end, doc, h = s.words(lower=True)
    n_words = np.bincount(doc, minlength=s.n).astype(np.float64)
    some, letters, byte = np.maximum(n_words, 1), np.maximum(per["alpha"], 1), np.maximum(n_bytes, 1)
    length = (end - start).astype(np.float64)
    order = np.lexsort((h, doc))
    d, w = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
    runs = run_bounds(np.cumsum(new))
    top = np.zeros(s.n)
    if len(d):
        np.maximum.at(top, d[runs[:-1]], np.diff(runs))
    longest = np.zeros(s.n)
    np.maximum.at(longest, doc, length)
    next_same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    byte_same = np.zeros(len(s.buf), np.float32)
    byte_same[1:] = s.buf[1:] == s.buf[:-1]
    same = np.zeros(s.n)
    same[full] = np.add.reduceat(byte_same, at, dtype=np.float64)
    # Lines: spans between newlines and the bounds of documents; empty ones do not count.
    cuts = np.unique(np.concatenate([s.offs, np.flatnonzero(s.buf == 10) + 1]))
    l_start, l_end = cuts[:-1], cuts[1:]
    l_end = l_end - ((l_end > l_start) & (s.buf[np.maximum(l_end, 1) - 1] == 10))
    keep = l_end > l_start
    l_start, l_end = l_start[keep], l_end[keep]
    l_doc = np.searchsorted(s.offs, l_start, side="right") - 1
    l_hash = spans_hash(s.buf, l_start, l_end)
    order = np.lexsort((l_hash, l_doc))
    ld, lh = l_doc[order], l_hash[order]
    again = (ld[1:] == ld[:-1]) & (lh[1:] == lh[:-1])
    lines = np.maximum(np.bincount(l_doc, minlength=s.n), 1)
    cols = {
        "log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n_words), "word_bytes": np.bincount(doc, length, s.n) / some,
        "upper": per["upper"] / letters, "digit": per["digit"] / byte, "punct": per["punct"] / byte, "symbol": per["symbol"] / byte,
        "shout": per["shout"] / byte, "stop": per["stop"] / some, "space": per["space"] / byte, "line_words": n_words / lines,
        "non_ascii": per["high"] / byte, "distinct_words": np.bincount(d[new], minlength=s.n) / some,
        "repeat_next": np.bincount(doc[1:][next_same], minlength=s.n) / some, "top_word": top / some,
        "dup_lines": np.bincount(ld[1:][again], minlength=s.n) / lines,
        "ends_punct": np.bincount(doc, _KIND["punct"][s.buf[end - 1]], s.n) / some, "longest_word": np.log1p(longest),
        "same_next": same / byte, "capitalised": np.bincount(doc, _KIND["upper"][s.buf[start]], s.n) / some,
    }
    for i, name in enumerate(FEATURES):
        out[:, i] = cols[name]
    return out


def text_features(text: pa.Array) -> np.ndarray:
    parts = [slice_features(s) for s in slices(text)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Lookup tables: a score is a sum of one entry for each feature and chosen pair."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for p in self.pairs for f in p}
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of a shallow tree on a binned feature: intervals of bins, split greedily by gain."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo < 2:
                continue
            m = np.arange(lo + 1, hi)
            gl, hl, ga, ha = cg[m] - cg[lo], ch[m] - ch[lo], cg[hi] - cg[lo], ch[hi] - ch[lo]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], int(m[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    step = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return step


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, pair_bins: int = 8, n_pairs: int = 6, leaves: int = 3, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: each round gives every feature in turn one shallow tree on
    the logistic gradient, added to its table; then the pairs with the largest
    gain on what is left are boosted in the same way on a coarse grid.

    Without rows the score is 0.5; with labels of one kind it stays near that label."""
    n_f = x.shape[1] if x.ndim == 2 else len(FEATURES)
    edges = [_edges(x[:, f], bins) if len(x) else np.zeros(0) for f in range(n_f)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse_edges = [_edges(x[:, f], pair_bins) if len(x) else np.zeros(0) for f in range(n_f)]
    if not len(x):
        return AdditiveModel(edges, 0.0, tables, [], coarse_edges, [])
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_1 / (1 - rate_1)))
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    margin = np.full(len(x), base)
    for _ in range(rounds):
        for f in range(n_f):
            p = 1 / (1 + np.exp(-margin))
            size = len(tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size), leaves, ridge)
            tables[f] += step
            margin += step[at[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse_edges)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        p = 1 / (1 + np.exp(-margin))
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1]), shape

    gains = []
    for a in range(n_f):
        for b in range(a + 1, n_f):
            _, g, h, _ = grid(a, b)
            gains.append((float((g**2 / (h + ridge)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:n_pairs]]
    pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in pairs]
    for _ in range(rounds // 5):
        for i, (a, b) in enumerate(pairs):
            cell, g, h, shape = grid(a, b)
            g2, h2 = g.reshape(shape), h.reshape(shape)
            # Depth two: split one feature, then each side by the other.
            first = _tree(g2.sum(1), h2.sum(1), 2, ridge)
            step = np.zeros(shape)
            side = first == first[0]
            for part in (side, ~side):
                if part.any():
                    step[part] = _tree(g2[part].sum(0), h2[part].sum(0), 2, ridge)
            pair_tables[i] += rate * step
            margin += (rate * step).ravel()[cell]
    return AdditiveModel(edges, base, tables, pairs, coarse_edges, pair_tables)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on labelled rows that aren't held out (crc32 of the id mod 5 is not 0).

    At most ``max_rows`` labelled rows are fitted, those whose identifiers have
    the smallest md5; only their features come to the driver. Labels with a null
    identifier or a null label are ignored; of several labels of one document the
    largest counts, of several documents with one identifier the one whose
    features are least. Features are of the text alone.
    """
    lid, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    picked = (
        labels.where(lid.isNotNull() & label.isNotNull() & ~held_out(lid))
        .groupBy(lid.alias("_id")).agg(F.max(label.cast("int")).alias("_y"))
        .withColumn("_rank", F.md5(F.col("_id").cast("string").cast("binary")))
        .orderBy("_rank").limit(max_rows)
    )
    rows = docs.select(lid.alias("_doc"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))

    def featured(batches):
        for b in batches:
            x = text_features(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_rank"), b.column("_y"), pa.array(list(x), pa.list_(pa.float64()))], ["rank", "y", "x"])

    # One row an identifier, so no more rows than labels were picked.
    told = rows.select("_rank", "_y", "_text").mapInArrow(featured, "rank string, y int, x array<double>")
    got = told.groupBy("rank").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), len(FEATURES))
    rank = np.array(got.column("rank").to_pylist(), dtype="U32")
    order = np.lexsort((*x.T[::-1], rank)) if len(got) else np.zeros(0, np.int64)  # the same order in every run
    model = fit_additive(x[order], got.column("y").to_numpy().astype(np.float64)[order])
    del got, x, rank
    trim()
    return model


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """Score in 0 to 1 of a text column; null counts as empty. Texts are read whole."""

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(t)), pa.float64())

    return score(text)


def classify_quality(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Score every whole text.

    Returns id, ``held_out``, ``score``, ``predicted`` (1 if score >= threshold).
    Null and empty texts get the score of a text without words; a null
    identifier has a null ``held_out``; equal rows each get a row.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), quality_score(model, F.col(f"`{text_col}`")).alias("_score"))
    return rows.select(
        F.col("_id").alias(id_col),
        held_out(F.col("_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
