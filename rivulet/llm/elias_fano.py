"""Monotone integer sequences in Elias-Fano form, read in place.

A sequence of n values below u keeps the low l = log2(u / n) bits of each value
packed, and the high parts in unary: 2 + l bits per value.  A stored sequence is one
buffer; it is read through views of that buffer, never unpacked.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 15
HEADER = 3     # n, low bits, bytes of the high part


def encode(values: np.ndarray) -> bytes:
    """Buffer of a non-decreasing uint64 sequence."""
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    low_bits = max(0, (top // max(1, n)).bit_length() - 1)
    low_bits = min(low_bits, 56)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    buckets = (int(high[-1]) if n else 0) + 1
    unary = np.zeros((n + buckets + 64) // 64 * 8, np.uint8)
    if n:
        at = high + np.arange(n)           # a one per value, a zero closes each bucket
        for lo in range(0, n, PIECE):
            p = at[lo:lo + PIECE]
            np.bitwise_or.at(unary, p >> 3, (1 << (p & 7)).astype(np.uint8))
    packed = [np.empty(0, np.uint8)]
    if low_bits and n:
        shifts = np.arange(low_bits, dtype=np.uint64)
        for lo in range(0, n, PIECE):      # PIECE values fill whole bytes
            bits = ((values[lo:lo + PIECE, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
    head = np.array([n, low_bits, len(unary)], "<i8").tobytes()
    return head + unary.tobytes() + np.concatenate(packed).tobytes() + bytes(8)


class Sequence:
    """Views of an encoded sequence."""

    def __init__(self, buffer):
        self.n, self.low_bits, size = (int(x) for x in np.frombuffer(buffer, "<i8", HEADER))
        start = 8 * HEADER
        self.words = np.frombuffer(buffer, "<u8", size // 8, start)
        low = np.frombuffer(buffer, np.uint8, offset=start + size)
        self.low = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))     # 8 bytes from any byte on
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))                            # directories: ones and zeros before each word
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @staticmethod
    def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the one of that rank (from 0) in each word."""
        at = np.zeros(len(word), np.int64)
        rank = rank.copy()
        for width in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << width) - 1)
            below = np.bitwise_count(word & mask).astype(np.int64)
            right = rank >= below
            rank -= np.where(right, below, 0)
            at += np.where(right, width, 0)
            word = np.where(right, word >> np.uint64(width), word & mask)
        return at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        w = np.searchsorted(self.ones, i, side="right") - 1
        at = w * 64 + self._select_in_word(self.words[w], i - self.ones[w])
        return ((at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _bucket_start(self, high: np.ndarray) -> np.ndarray:
        """Values whose high part is below ``high`` (from 0 to all buckets)."""
        rank = high - 1                     # the zero that closes the bucket before
        w = np.searchsorted(self.zeros, rank, side="right") - 1
        w = np.minimum(w, len(self.words) - 1)
        at = w * 64 + self._select_in_word(~self.words[w], rank - self.zeros[w])
        return np.where(high > 0, np.minimum(at - rank, self.n), 0)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the place of the first value not below it (n if none)."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        buckets = int(self.zeros[-1])
        high = np.minimum(x >> np.uint64(self.low_bits), np.uint64(buckets - 1)).astype(np.int64)
        lo, hi = self._bucket_start(high), self._bucket_start(np.minimum(high + 1, buckets - 1))
        want = x & np.uint64((1 << self.low_bits) - 1)
        beyond = (x >> np.uint64(self.low_bits)) > np.uint64(buckets - 1)
        lo = np.where(beyond, self.n, lo)
        hi = np.where(beyond, self.n, hi)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):                   # within a bucket the low parts are in order
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, or -1."""
        at = self.successor(x)
        found = at < self.n
        ok = np.flatnonzero(found)
        found[ok] = self.get(at[ok]) == x[ok]
        return np.where(found, at, -1)
