"""Elias-Fano sequences in a flat layout that can be memory-mapped, with vectorised search."""

from __future__ import annotations

import numpy as np

_WORDS = 8  # 64-bit words between two entries of the directory


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits in a row, in 64-bit words, and one word of padding."""
    n_words = (len(values) * width + 63) // 64 + 1
    if not width or not len(values):
        return np.zeros(n_words, np.uint64)
    out = np.zeros(n_words, np.uint64)
    step = 64 * 4096  # a multiple of 64 values starts at a word
    for a in range(0, len(values), step):
        v = values[a : a + step]
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)
        out[a * width // 64 : a * width // 64 + len(packed)] = packed
    return out


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The position of the k-th set bit (from 0) of each word."""
    at = np.zeros(len(word), np.int64)
    k = k.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
        right = k >= low
        k = np.where(right, k - low, k)
        word = np.where(right, word >> np.uint64(width), word)
        at += np.where(right, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of n integers below 2**64: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low, high, ones, zeros):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """universe: above all values."""
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        upper = (universe - 1 >> low_bits) + 1 if universe else 1
        bits = n + upper + 1
        high = np.zeros(-(-bits // 512) * 64, np.uint8)
        position = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        step = np.zeros(len(high) * 8, np.uint8)
        step[position] = 1
        high = np.packbits(step, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64).reshape(-1, _WORDS).sum(1)
        ones = np.concatenate(([0], np.cumsum(count))).astype(np.uint64)
        zeros = np.arange(len(ones), dtype=np.uint64) * np.uint64(64 * _WORDS) - ones
        return cls(n, low_bits, _pack_bits(values & np.uint64((1 << low_bits) - 1), low_bits), high, ones, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.uint64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def of(cls, head, low, high, ones, zeros) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, ones, zeros)

    def _select(self, directory: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
        block = np.searchsorted(directory, k.astype(np.uint64), "right") - 1
        rest = k.astype(np.int64) - directory[block].astype(np.int64)
        word = block * _WORDS
        for _ in range(_WORDS - 1):
            w = self.high[word]
            n = np.bitwise_count(w if ones else ~w).astype(np.int64)
            on = rest >= n
            if not on.any():
                break
            rest = np.where(on, rest - n, rest)
            word = word + on
        w = self.high[word]
        return word * 64 + _select_in_word(w if ones else ~w, rest)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        left = (np.uint64(64) - shift) & np.uint64(63)
        value = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << left, np.uint64(0))
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at these indices."""
        i = np.asarray(i, np.int64)
        high = self._select(self.ones, i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(i)

    def bucket(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a high part below each of these."""
        high = high.astype(np.int64)
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        out[some] = self._select(self.zeros, high[some] - 1, False) - (high[some] - 1)
        return out

    def successor(self, value: np.ndarray, first=None, end=None) -> np.ndarray:
        """The index of the first element at or above each value, within [first, end) where these are given."""
        value = value.astype(np.uint64)
        high = value >> np.uint64(self.low_bits)
        low = value & np.uint64((1 << self.low_bits) - 1)
        a, b = self.bucket(high), self.bucket(high + np.uint64(1))
        if first is not None:
            a, b = np.clip(a, first, end), np.clip(b, first, end)
        while (open_ := np.flatnonzero(a < b)).size:
            mid = (a[open_] + b[open_]) // 2
            less = self.low_of(mid) < low[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
        return a

    def find(self, value: np.ndarray, first=None, end=None) -> np.ndarray:
        """The index of an element equal to each value, or -1."""
        value = value.astype(np.uint64)
        top = int(self.access(np.array([self.n - 1]))[0]) if self.n else -1
        out = np.full(len(value), -1, np.int64)
        if top < 0:
            return out
        some = np.flatnonzero(value <= np.uint64(top))
        at = self.successor(value[some], None if first is None else first[some], None if end is None else end[some])
        inside = at < (self.n if end is None else end[some])
        at_in = at[inside]
        same = self.access(at_in) == value[some][inside]
        out[some[inside][same]] = at_in[same]
        return out
