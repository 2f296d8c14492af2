"""Elias-Fano sequences and a two-level n-gram trie over memory-mapped arrays."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U64 = np.uint64
#: Bits between two samples of a bitmap's running count.
SAMPLE = 256
#: Queries resolved together inside sampled blocks.
TOGETHER = 1 << 15


class MappedArrays:
    """Arrays in one memory-mapped file that has no name and goes with the process."""

    def __init__(self, **arrays: np.ndarray):
        at, places = 0, {}
        with tempfile.TemporaryFile() as file:
            for name, values in arrays.items():
                values = np.ascontiguousarray(values)
                pad = -at % 8
                file.write(b"\0" * pad)
                at += pad
                places[name] = (at, values.dtype, len(values))
                file.write(values.tobytes())
                at += values.nbytes
            file.write(b"\0" * 8)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        for name, (start, kind, size) in places.items():
            setattr(self, name, np.frombuffer(self.map, kind, size, start))


class EliasFano:
    """A non-decreasing sequence: low bits packed side by side, high bits as gaps in a bitmap."""

    def __init__(self, values: np.ndarray, bits: int):
        n = len(values)
        values = values.astype(U64)
        self.n = n
        self.low_bits = max(0, bits - max(1, n).bit_length() + 1)
        high = (values >> U64(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(n, np.int64)
        self.buckets = (1 << (bits - self.low_bits)) if bits - self.low_bits < 62 else 0
        flags = np.zeros(-(-(n + self.buckets + 1) // SAMPLE) * SAMPLE, np.uint8)
        flags[high + np.arange(n)] = 1
        ones = flags.reshape(-1, SAMPLE).sum(1, dtype=np.int64)
        length = len(flags)
        self.mapped = MappedArrays(
            bitmap=np.packbits(flags),
            ones=np.concatenate([[0], np.cumsum(ones)]),
            low=self._pack(values),
        )
        self.zeros = np.arange(length // SAMPLE + 1) * SAMPLE - self.mapped.ones

    def _pack(self, values: np.ndarray) -> np.ndarray:
        width = self.low_bits
        words = np.zeros(self.n * width // 64 + 2, U64)
        if width and self.n:
            low = values & U64((1 << width) - 1)
            bit = np.arange(self.n, dtype=np.int64) * width
            word, shift = bit >> 6, (bit & 63).astype(U64)
            np.bitwise_or.at(words, word, low << shift)
            over = shift.astype(np.int64) + width > 64
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (U64(64) - shift[over]))
        return words

    def _low(self, index: np.ndarray) -> np.ndarray:
        width = self.low_bits
        if not width:
            return np.zeros(len(index), U64)
        bit = index * width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        value = self.mapped.low[word] >> shift
        over = shift > 0
        value[over] |= self.mapped.low[word[over] + 1] << (U64(64) - shift[over])
        return value & U64((1 << width) - 1) if width < 64 else value

    def _select(self, rank: np.ndarray, one: bool) -> np.ndarray:
        """Position of the bit with ``rank`` of its kind before it."""
        counts = self.mapped.ones if one else self.zeros
        out = np.empty(len(rank), np.int64)
        blocks = self.mapped.bitmap.reshape(-1, SAMPLE // 8)
        for first in range(0, len(rank), TOGETHER):
            own = rank[first : first + TOGETHER]
            block = np.searchsorted(counts, own, "right") - 1
            bits = np.unpackbits(blocks[block], axis=1)
            if not one:
                bits ^= 1
            nth = np.cumsum(bits, axis=1, dtype=np.uint16)
            inside = np.argmax(nth == (own - counts[block] + 1)[:, None], axis=1)
            out[first : first + TOGETHER] = block * SAMPLE + inside
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        high = (self._select(index, True) - index).astype(U64)
        return (high << U64(self.low_bits)) | self._low(index)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1; the sequence is strictly increasing."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = (values >> U64(self.low_bits)).astype(np.int64)
        first = np.zeros(len(values), np.int64)
        some = high > 0
        first[some] = self._select(high[some] - 1, False) - (high[some] - 1)
        last = self._select(high, False) - high
        low = values & U64((1 << self.low_bits) - 1)
        while (open_ := np.flatnonzero(first < last)).size:
            middle = (first[open_] + last[open_]) // 2
            less = self._low(middle) < low[open_]
            first[open_[less]] = middle[less] + 1
            last[open_[~less]] = middle[~less]
        inside = np.flatnonzero(first < self.n)
        inside = inside[self.get(first[inside]) == values[inside]]
        out[inside] = first[inside]
        return out


#: Probabilities are kept as 16-bit steps of their decimal logarithm down to this.
FLOOR = -9.0
STEPS = 65534


def quantise(probability: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 for positive probabilities."""
    scaled = np.rint((np.maximum(np.log10(probability), FLOOR) / FLOOR) * STEPS)
    return (65535 - scaled).astype(np.uint16)


def restore(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; code 0 stands for none."""
    out = np.power(10.0, (65535 - codes.astype(np.float64)) / STEPS * FLOOR)
    out[codes == 0] = 0
    return out


class NgramTrie:
    """Contexts, and for each its successors in ascending order with quantised probabilities.

    Built from distinct (context, successor) pairs sorted by both. A query finds its context in the
    first level, reads the range of its successors from monotone pointers, and searches the
    successor inside that range only.
    """

    def __init__(self, context: np.ndarray, successor: np.ndarray, probability: np.ndarray):
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        starts = np.flatnonzero(new)
        self.contexts = EliasFano(context[starts], 64)
        pointers = np.concatenate([starts, [len(context)]])
        self.pointers = EliasFano(pointers, max(1, int(len(context)).bit_length()))
        self.level = MappedArrays(successor=successor.astype(np.uint32), code=quantise(probability))

    def look_up(self, context: np.ndarray, counts: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs that come as distinct contexts, their numbers of successors, and these."""
        out = np.zeros(len(successor), np.uint16)
        node = self.contexts.find(context)
        known = np.flatnonzero(node >= 0)
        first = np.zeros(len(context), np.int64)
        last = np.zeros(len(context), np.int64)
        first[known] = self.pointers.get(node[known]).astype(np.int64)
        last[known] = self.pointers.get(node[known] + 1).astype(np.int64)
        low, high = np.repeat(first, counts), np.repeat(last, counts)
        end = high.copy()
        every = np.flatnonzero(low < high)
        while every.size:
            middle = (low[every] + high[every]) // 2
            less = self.level.successor[middle] < successor[every]
            low[every[less]] = middle[less] + 1
            high[every[~less]] = middle[~less]
            every = every[low[every] < high[every]]
        inside = np.flatnonzero(low < end)
        inside = inside[self.level.successor[low[inside]] == successor[inside]]
        out[inside] = self.level.code[low[inside]]
        return out
