"""Embedders: text to a vector of unit length."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .text import token_list, tokens

#: Dimensions of stored vectors by default.
DIM = 384
#: Texts of one forward pass of a model.
MODEL_BATCH = 64
#: Texts that are hashed at a time, and words whose buckets a worker remembers.
ROWS, HELD_WORDS = 512, 1 << 16

Model = Callable[[list[str]], np.ndarray]


def hashing_embedding(text: Column, dim: int = DIM) -> Column:
    """Counts of tokens in ``dim`` buckets (of the token's MD5), scaled to unit length.

    Deterministic and without a model; close vectors share words, nothing more.
    A text without tokens is a zero vector."""
    places: dict[str, int] = {}

    def place(w: str) -> int:
        at = places.get(w)
        if at is None:
            if len(places) >= HELD_WORDS:
                places.clear()
            at = places[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
        return at

    @F.arrow_udf("array<float>")
    def embed(words: pa.Array) -> pa.Array:
        vectors = np.zeros((len(words), dim), np.float32)
        for at in range(0, len(words), ROWS):  # distinct words are looked at once in so many texts, and only theirs are Python's
            part = words.slice(at, ROWS)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = part.flatten().dictionary_encode()
            bucket = np.fromiter((place(w) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            cells = np.repeat(np.arange(len(part)) * dim, sizes) + bucket[coded.indices.to_numpy()]
            out = np.bincount(cells, minlength=len(part) * dim).reshape(len(part), dim).astype(np.float64)
            norm = np.sqrt((out * out).sum(1, keepdims=True))
            np.divide(out, norm, out=vectors[at : at + ROWS], where=norm > 0, casting="same_kind")
        return pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dim, dtype=np.int32)), pa.array(vectors.ravel(), pa.float32()))

    return embed(tokens(text))


def hash_embed(text: str, dim: int = DIM) -> list[float]:
    """The same on the driver, for a query."""
    out = np.zeros(dim)
    for w in token_list(text):
        out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
    norm = float(np.sqrt((out * out).sum()))
    return [float(x) for x in (out / norm if norm else out).astype(np.float32)]


def model_embedder(load: Callable[[], Model]) -> Callable[[Column, int], Column]:
    """What an engine takes as ``embed_column``: vectors of the model that ``load`` makes."""
    return lambda text, dim: model_embedding(text, load, dim)


def model_embedding(text: Column, load: Callable[[], Model], dim: int | None = None) -> Column:
    """Vectors of a model that ``load`` makes, once a Python worker; MODEL_BATCH texts a pass, in order.

    ``load`` runs on executors, for instance to open an ONNX session there. A
    null text is embedded as an empty one; an empty batch asks the model nothing.
    With ``dim``, vectors of another length raise an error."""
    held: list[Model] = []

    @F.arrow_udf("array<float>")
    def embed(texts: pa.Array) -> pa.Array:
        rows = [t or "" for t in texts.to_pylist()]
        if rows and not held:
            held.append(load())
        out = []
        for i in range(0, len(rows), MODEL_BATCH):
            part = np.asarray(held[0](rows[i : i + MODEL_BATCH]), np.float32)
            if part.ndim != 2 or len(part) != len(rows[i : i + MODEL_BATCH]) or dim not in (None, part.shape[1]):
                raise ValueError(f"a model must give one vector of {dim or 'one'} length a text, not an array of shape {part.shape}")
            out.extend(part.tolist())
        return pa.array(out, pa.list_(pa.float32()))

    return embed(text)
