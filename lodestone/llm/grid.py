"""Texts of an Arrow batch as flat numpy arrays: bytes, words, hashes.

All work is done on the UTF-8 buffer of a batch, cut into slices of whole
documents of about SLICE bytes, so memory is bounded by the batch and by the
longest single document.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Multipliers and keys of the hashes (fixed values: results of different tasks must agree).
SPREAD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F)
STEP = np.uint64(SPREAD[1])
#: Spans of more bytes are hashed one by one, by a keyed byte hash.
LONG = 64

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Slice:
    """Some consecutive documents: ``buf`` bytes, ``offs`` of n + 1 document bounds, ``first`` row in the batch.

    A piece of a long document is alone; ``base`` is where it starts in the document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int, base: int = 0):
        self.buf, self.offs, self.first, self.n, self.base = buf, offs, first, len(offs) - 1, base

    def bounds(self, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, and start, end and document of each word."""
        buf = _LOWER[self.buf] if lower else self.buf
        n = len(buf)
        if not n:
            none = np.zeros(0, np.int64)
            return buf, none, none, none
        space = _SPACE[buf]
        edge = np.ones(n + 1, bool)
        edge[1:] = False
        edge[self.offs] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, space[:-1]
        start = np.flatnonzero(~space & (before | edge[:-1]))
        before[-1], before[:-1] = True, space[1:]
        end = np.flatnonzero(~space & (before | edge[1:])) + 1
        return buf, start, end, np.searchsorted(self.offs, start, side="right") - 1

    def words(self, lower: bool, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, document and 64-bit hash of each word; hashes of another ``key`` are independent."""
        buf, start, end, doc = self.bounds(lower)
        return start, end, doc, spans_hash(buf, start, end, key)


def plain(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one space behind each; where each starts, with the end."""
    offs = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(offs[-1], 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[offs[1:] - 1] = False
    out[inside] = buf[np.flatnonzero(inside) + np.repeat(start - offs[:-1], end - start)] if len(start) else 0
    return out, offs


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, past the end zeros, as a view of one number a place."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """64-bit hash of each byte span.

    Eight bytes at a time go through a bijection of the state, so spans of up to
    eight bytes have no collision among those of their length; spans of more
    than LONG bytes are hashed by blake2b."""
    size = end - start
    view = eights(buf)
    h = mix(size.astype(np.uint64) * STEP + np.uint64(SPREAD[key]))
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (view[start[live] + at] & _MASK[np.minimum(left, 8)]))
        at += 8
        live = live[left > 8]
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8, key=bytes([key])).digest(), "little")
    return h


def grams_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` values; the caller drops runs that cross documents.

    Runs are put together from runs of powers of two; every step is mixed, so
    the hash is no polynomial."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if k & size:
            out = power[:n] if out is None else mix(out * STEP + power[done : done + n])
            done += size
        if done == k:
            return mix(out + np.uint64(k))
        power = mix(power[:-size] * STEP + power[size:])
        size *= 2


def byte_grams_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes, for choosing anchors; runs of equal hash needn't be equal."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    view = eights(buf)
    places = [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])] if k >= 8 else [0]
    out = np.zeros(n, np.uint64)
    factor = SPREAD[0]
    for p in places:
        part = view[p : p + n] * np.uint64(factor)
        out += part if k >= 8 else (view[:n] & _MASK[k]) * np.uint64(factor)
        factor = factor * SPREAD[1] & ((1 << 64) - 1)
    return mix(out)


def slices(text: pa.Array, size: int = SLICE, overlap: int | None = None) -> Iterator[Slice]:
    """Documents of an Arrow string array (null: empty) in slices of whole documents.

    With an ``overlap``, a document of more than ``size`` bytes comes in pieces that have so many bytes in common."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("").cast(pa.large_string())
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None and text.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        stop = int(np.searchsorted(offs, offs[row] + size, side="left"))
        stop = min(max(stop, row + 1), len(text))
        if overlap is not None and stop > row + 1 and offs[stop] - offs[stop - 1] > size:
            stop -= 1  # a long document is alone
        if overlap is None or offs[stop] - offs[row] <= size or stop > row + 1:
            yield Slice(data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row], row)
        else:
            lo, hi = int(offs[row]), int(offs[stop])
            for at in range(lo, max(hi - overlap, lo + 1), size):
                end = min(at + size + overlap, hi)
                yield Slice(data[at:end], np.array([0, end - at], np.int64), row, at - lo)
        row = stop


_TO_SPACE = bytes(32 if _SPACE[b] else b for b in range(256))


def joined_words(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    out = text.translate(_TO_SPACE).strip(b" ")
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def word_ids(raw: bytes) -> np.ndarray:
    """A number for each word of a text of words that each have a space behind them; equal words have equal numbers."""
    buf = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(buf == 32) + 1
    offs = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offs), pa.py_buffer(raw)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def run_names(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of ``k`` values; equal runs have equal numbers and no others have.

    Runs of powers of two are named by the names of their halves."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    name, size = ids, 1
    while size < k:
        step = min(size, k - size)
        pair = name[:-step] * np.int64(int(name.max()) + 1) + name[step:]
        name = np.unique(pair, return_inverse=True)[1]
        size += step
    return name


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def trim() -> None:
    """Give free memory back to the system: workers wait for their next task without it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
