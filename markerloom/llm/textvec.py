"""Words and their hashes for a whole Arrow batch at once, without a Python loop over words.

A word is a maximal run of bytes outside ``0x20, 0x09-0x0D`` (all of which are single bytes in UTF-8).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For :func:`words`: A-Z in lower case; and the same with ASCII punctuation as white space.
PLAIN = _LOWER.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0x20
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = 0xD6E8FEB86659FD93
#: For a second hash of the same words.
OTHER_BASE = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base & _MASK))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


SLICE = 1 << 17
_POWERS = powers(int(_BYTE_BASE), SLICE)


@dataclass
class Words:
    """Words of the texts of a batch; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word; ``SLICE`` bytes are worked on at a time, whatever the size of the batch."""
        out = np.empty(len(self.starts), np.uint64)
        begin = 0
        while begin < len(out):
            first = int(self.starts[begin])
            end = int(np.searchsorted(self.ends, first + SLICE, "right"))
            if end > begin:
                data = self.data[first : self.ends[end - 1]]
                starts = self.starts[begin:end] - first
                at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
                values = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[at]
                values[SPACE[data]] = 0
                out[begin:end] = np.add.reduceat(values, starts)
            else:  # one word that is longer
                end, total = begin + 1, 0
                for at in range(first, int(self.ends[begin]), SLICE):
                    data = self.data[at : min(at + SLICE, int(self.ends[begin]))]
                    total += int(((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)]).sum(dtype=np.uint64)) * pow(int(_BYTE_BASE), at - first, 1 << 64)
                out[begin] = total & _MASK
            begin = end
        return mixed(out + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words(texts: pa.Array, lower: bool = True, table: np.ndarray | None = None) -> Words:
    """The words of a string array; a null text has none. ``lower`` maps A-Z only; ``table`` maps bytes in its place."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = table[raw] if table is not None else _LOWER[raw] if lower else raw
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = ~space, ~space
    begins[1:] &= space[:-1] | cut[1:-1]
    ends[:-1] &= space[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """A hash for each run of k words, by its first word; runs may cross texts, which the caller leaves out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= np.uint64(base)
            out += hashes[j : n + j]
        return mixed(out)
    sums = _sums(hashes, base)
    return mixed((sums[k:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n))


def _sums(hashes: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=out[1:])
    return out


def spans_of(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """A hash for each run of words ``begin`` to ``end`` (excluded), of any lengths."""
    sums, back = _sums(hashes, base), powers(pow(base, -1, 1 << 64), len(hashes))
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
