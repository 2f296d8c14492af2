"""Vectorised words, hashes and shingles over the UTF-8 buffers of Arrow text columns.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed and
carriage return. Everything below works on whole texts; ``chunks`` only decides how many texts are
held in arrays at a time, never where a text ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts of about this many bytes are worked on together.
CHUNK_BYTES = 2_000_000

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other (a bijection per salt)."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) % 2**64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(factor: int) -> np.ndarray:
        out = np.full(size, factor % 2**64, dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(pow(_BASE, -1, 2**64))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    return _powers(1 << max(16, int(size).bit_length()))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offset of each text in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64) + 64)
    first = 0
    while first < n:
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + size, "right")))
        yield batch.slice(first, last - first)
        first = last


@dataclass
class Words:
    """Words of several texts: bytes, first and past-last byte, and where each text's words begin."""

    raw: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.ptr) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


def split(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = IS_SPACE) -> Words:
    """Find the words of all texts at once; ``gap`` marks the bytes between words."""
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return Words(raw, off, none, none, np.zeros(len(off), np.int64))
    inside = ~gap[raw]
    fresh = np.ones(n, bool)
    np.logical_not(inside[:-1], out=fresh[1:])
    fresh[off[:-1][off[:-1] < n]] = True
    last = np.ones(n, bool)
    np.logical_not(inside[1:], out=last[:-1])
    last[off[1:][off[1:] > 0] - 1] = True
    start = np.flatnonzero(inside & fresh)
    end = np.flatnonzero(inside & last) + 1
    return Words(raw, off, start, end, np.searchsorted(start, off))


def words_of(column: pa.Array, lower: bool = True) -> Words:
    raw, off = utf8(column)
    return split(LOWER[raw] if lower else raw, off)


class Spans:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start])


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Spans(raw)(start, end) if len(start) else np.empty(0, U64)


def word_hash(words: Words) -> np.ndarray:
    return span_hash(words.raw, words.start, words.end)


def window_hash(hashes: np.ndarray, ptr: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width`` consecutive words, and where each text's windows begin."""
    counts = np.maximum(np.diff(ptr) - width + 1, 0)
    out_ptr = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(out_ptr[-1]) + np.repeat(ptr[:-1] - out_ptr[:-1], counts)
    total = np.zeros(len(at), U64)
    for k in range(width):
        total += hashes[at + k] * U64((_BASE * (2 * k + 3) ** 5 | 1) % 2**64)
    return mix(total, width), out_ptr


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text, sorted and distinct, and where each text's begin.

    A text with fewer words than ``width`` has its whole word sequence as its only shingle; a text
    without words has none.
    """
    h = word_hash(words)
    out, ptr = window_hash(h, words.ptr, width)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [
            mix(window_hash(h[words.ptr[d] : words.ptr[d + 1]], np.array([0, counts[d]]), int(counts[d]))[0], 977)
            for d in short
        ]
        out = np.insert(out, ptr[short], np.concatenate(whole))
        ptr = ptr + np.concatenate([[0], np.cumsum((counts > 0) & (counts < width))])
    return distinct(out, ptr)


def distinct(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort each text's values and drop repeats."""
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[ptr[:-1][ptr[:-1] < len(values)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[ptr]


def per_doc(ufunc: np.ufunc, values: np.ndarray, ptr: np.ndarray, empty: int = 0) -> np.ndarray:
    """Reduce each text's values; texts without any get ``empty``."""
    out = np.full(len(ptr) - 1, empty, dtype=values.dtype)
    some = np.flatnonzero(np.diff(ptr) > 0)
    if len(some):
        out[some] = ufunc.reduceat(values, ptr[some])
    return out


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.astype(U64, copy=False).view(np.int64)
