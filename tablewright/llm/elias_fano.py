"""Elias-Fano coded monotone sequences over numpy arrays, laid out so that a memory map can be read in place."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_NTH = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _NTH[_b, _k] = _p


BLOCK = 1 << 15


_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)


def _byte_sums(word: np.ndarray) -> np.ndarray:
    """Words whose k-th byte counts the set bits of bytes 0 to k of each word."""
    two = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    four = (two & np.uint64(0x3333333333333333)) + ((two >> np.uint64(2)) & np.uint64(0x3333333333333333))
    return ((four + (four >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit of each 64-bit word."""
    k = k.astype(np.uint64)
    sums = _byte_sums(word)
    full = ((k * _BYTES | _TOPS) - sums) & _TOPS  # bytes that end before the bit
    at = ((full >> np.uint64(7)) * _BYTES) >> np.uint64(56) << np.uint64(3)
    before = (sums << np.uint64(8)) >> at & np.uint64(255)
    return at.astype(np.int64) + _NTH[(word >> at) & np.uint64(255), k - before]


def search(value: Callable[[np.ndarray], np.ndarray], lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Index of the first element of each range [lo, hi) that is not below ``want``; hi if there is none. Elements rise within a range."""
    lo, hi = lo.copy(), hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) >> 1
        less = value(mid) < want[live]
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    return lo


class EliasFano:
    """A non-decreasing sequence of n unsigned numbers in about 2 + log2(range / n) bits each.

    The low bits of each number are packed; the high parts are a unary bit vector with a running count of
    ones and zeros for each 64-bit word, so element access and successor search take a few steps in any order.
    """

    def __init__(self, n: int, low_bits: int, upper: np.ndarray, ones: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.upper, self.ones, self.zeros, self.low = n, low_bits, upper, ones, zeros, low

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        size = -(-(n + (top >> low_bits) + 2) // 64) * 64
        bits = np.zeros(size, np.uint8)
        bits[high + np.arange(n)] = 1
        upper = np.packbits(bits, bitorder="little").view(np.uint64)
        if size >= 1 << 32:
            raise ValueError("a sequence must have fewer than 2^32 upper bits; take more shards")
        ones = np.concatenate([[0], np.cumsum(_ONES[upper.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64))[:-1]])
        zeros = 64 * np.arange(len(ones)) - ones
        low = []
        for at in range(0, n if low_bits else 0, BLOCK):  # a block's bits fill whole bytes
            rest = values[at : at + BLOCK]
            plane = np.empty((len(rest), low_bits), np.uint8)
            for bit in range(low_bits):
                plane[:, bit] = (rest >> np.uint64(bit)) & np.uint64(1)
            low.append(np.packbits(plane.reshape(-1), bitorder="little"))
        return cls(n, low_bits, upper, ones.astype(np.uint32), zeros.astype(np.uint32), np.concatenate([*low, np.zeros(8, np.uint8)]))

    def to_bytes(self) -> bytes:
        pad = -len(self.low) % 8
        return struct.pack("<4Q", self.n, self.low_bits, len(self.upper), len(self.low) + pad) + self.upper.tobytes() + self.ones.tobytes() + self.zeros.tobytes() + self.low.tobytes() + bytes(pad)

    @classmethod
    def read(cls, raw: memoryview, at: int) -> tuple["EliasFano", int]:
        """The sequence that begins at ``at`` of ``raw``, over the mapped bytes, and where it ends."""
        n, low_bits, words, low = struct.unpack_from("<4Q", raw, at)
        at += 32
        upper = np.frombuffer(raw, np.uint64, words, at)
        ones = np.frombuffer(raw, np.uint32, words, at + 8 * words)
        zeros = np.frombuffer(raw, np.uint32, words, at + 12 * words)
        at += 16 * words
        return cls(n, low_bits, upper, ones, zeros, np.frombuffer(raw, np.uint8, low, at)), at + low

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        eight = self.low[(bit >> 3)[:, None] + np.arange(8)]
        word = np.ascontiguousarray(eight).view(np.uint64).reshape(-1)
        return (word >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by index."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = 64 * word + _select_in_word(self.upper[word], i - self.ones[word].astype(np.int64))
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a high part below ``high``."""
        k = np.maximum(high - 1, 0)
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        place = 64 * word + _select_in_word(~self.upper[word], k - self.zeros[word].astype(np.int64))
        return np.where(high > 0, place - k, 0)

    def _range(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which of ``x`` are in the range of the high parts, the elements that share their high part, and their low bits."""
        high = x >> np.uint64(self.low_bits)
        at = np.flatnonzero(high < np.uint64(64 * len(self.upper) - self.n - 1))
        high = high[at].astype(np.int64)
        return at, self._before(high), self._before(high + 1), x[at] & np.uint64((1 << self.low_bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is not below each x; n if there is none."""
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        out = np.full(len(x), self.n, np.int64)
        at, lo, hi, want = self._range(np.asarray(x, np.uint64))
        out[at] = search(self.lows, lo, hi, want)
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each x, else -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        at, lo, hi, want = self._range(np.asarray(x, np.uint64))
        lo = search(self.lows, lo, hi, want)
        hit = np.flatnonzero(lo < hi)
        hit = hit[self.lows(lo[hit]) == want[hit]]
        out[at[hit]] = lo[hit]
        return out
