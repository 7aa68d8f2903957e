"""Elias-Fano sequences in numpy: monotone integers in about ``2 + log2(universe / n)`` bits each, read many at a time.

All arrays of a sequence are plain buffers, so they can be slices of a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

#: Place of the r-th set bit of a byte.
_PLACE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _PLACE[_b, _r] = _p


def _nth_bit(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each 64-bit integer: in which half, quarter and eighth it is, then a table."""
    out, r = np.zeros(len(x), np.int64), r.astype(np.int64)
    for width in (32, 16, 8):
        here = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        over = r >= here
        r -= here * over
        shift = over * width
        out += shift
        x = x >> shift.astype(np.uint64)
    return out + _PLACE[(x & np.uint64(255)).astype(np.int64), np.minimum(r, 7)]


class EliasFano:
    def __init__(self, n: int, low_bits: int, lows: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        """``ones`` and ``zeros`` count the bits before each 64-bit word of ``high``."""
        self.n, self.low_bits, self.lows, self.high, self.ones, self.zeros = n, low_bits, lows, high, ones, zeros
        self._unaligned = np.ndarray((max(0, len(lows) - 7),), "<u8", buffer=lows, strides=(1,)) if len(lows) >= 8 else None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """From integers in order, each below ``universe``."""
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        lows = np.zeros((n * low_bits + 7) // 8 + 8, np.uint8)
        step = 8 * 8192
        for at in range(0, n if low_bits else 0, step):
            part = values[at : at + step]
            bits = (part[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(bits.ravel(), bitorder="little")
            lows[at * low_bits // 8 : at * low_bits // 8 + len(packed)] = packed
        bits = np.zeros(-(-(n + (universe >> low_bits) + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        per_word = bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(per_word)[:-1]])
        return cls(n, low_bits, lows, high, ones, np.arange(len(ones)) * 64 - ones)

    def parts(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.low_bits]), "lows": self.lows, "high": self.high, "ones": self.ones, "zeros": self.zeros}

    @classmethod
    def of(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(parts["meta"][0]), int(parts["meta"][1]), parts["lows"], parts["high"], parts["ones"], parts["zeros"])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        return self._unaligned[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _one(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        return word * 64 + _nth_bit(self.high[word], i - self.ones[word])

    def _zero(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, i, "right") - 1
        return word * 64 + _nth_bit(~self.high[word], i - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return (self._one(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """For each value the place of the first one that isn't smaller (``n`` if all are)."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of :meth:`successor`, and whether the value itself is there."""
        at, end, low = self._search(values)
        hit = at < end
        hit[hit] = self._low(at[hit]) == low[hit]
        return at, hit

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, where their buckets (values with an equal upper part) end, and lower parts."""
        top = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        before = np.where(top > 0, self._zero(np.maximum(top - 1, 0)), -1)  # the zero that ends the bucket before
        end = self._next_zero(before + 1) - top
        left, right = before - top + 1, end.copy()
        active = np.flatnonzero(left < right)
        while active.size:
            mid = (left[active] + right[active]) >> 1
            less = self._low(mid) < low[active]
            left[active[less]] = mid[less] + 1
            right[active[~less]] = mid[~less]
            active = active[left[active] < right[active]]
        return left, end, low

    def _next_zero(self, at: np.ndarray) -> np.ndarray:
        """Place of the first zero bit of the upper parts from ``at`` on."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        rest = ~self.high[np.minimum(word, len(self.high) - 1)] >> bit
        out = at + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        if (far := np.flatnonzero(rest == 0)).size:  # none in this word
            ones = self.ones[word[far]] + np.bitwise_count(self.high[word[far]]).astype(np.int64)
            out[far] = self._zero((word[far] + 1) * 64 - ones)
        return out
