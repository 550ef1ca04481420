"""Word shingles of whole texts as sorted arrays of 64-bit hashes.

A text is lower-cased in A-Z only and cut into words ``[^\\x20\\x09-\\x0D]+``.
On UTF-8 both need single bytes only, because no byte of a longer character is
ASCII.  A text with fewer words than the shingle width has its whole word
sequence as its only shingle; a null text or one without words has none.

Words are hashed for a whole batch at once: with P[i] the sum of
``T[byte] * R**i`` over the bytes before i, the bytes of a word give
``(P[end] - P[start]) / R**start`` in 64-bit arithmetic (R is odd and so has an
inverse).  Equal sets of hashes are taken as equal sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from varigrid.llm.common import text_parts

#: Odd multipliers of the mixing function (the 64-bit finaliser constants of splitmix64).
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns the texts of an Arrow column into sorted arrays of distinct shingle hashes."""

    def __init__(self, width: int):
        self.width = width
        table = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
        table[65:91] = table[97:123]
        self.byte = table
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = int(mix(np.array([7], np.uint64))[0] | np.uint64(1))
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, r in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                p = np.full(n, np.uint64(r))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of some texts, and each text's first word (texts + 1)."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n + 1)
        word = ~self.space[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begins = offsets[:-1][offsets[:-1] < n]
        first[begins] = word[begins]
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = word[ends]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=sums[1:])
        h = mix((sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64))
        return h, np.searchsorted(s, offsets, "left")

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        k = self.width
        for _, _, offsets, data in text_parts(column):
            w, at = self.words(offsets, data)
            acc = np.full(max(0, len(w) - k + 1), np.uint64(k))
            for i in range(k):
                acc = mix(acc + _STEP + w[i : i + len(acc)])
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a >= k:
                    yield np.unique(acc[a : b - k + 1])
                elif b > a:
                    one = np.full(1, np.uint64(b - a))
                    for i in range(a, b):
                        one = mix(one + _STEP + w[i : i + 1])
                    yield one
                else:
                    yield w[:0]


def digest(shingles: np.ndarray) -> bytes:
    """128-bit identity of a set: equal sets, equal digests; empty for the empty set."""
    return xxhash.xxh3_128_digest(np.ascontiguousarray(shingles)) if len(shingles) else b""


def least_overlap(n, m, percent: int):
    """Smallest intersection with ``100 * inter >= percent * union``."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Elements of a set of n among which any partner must share one."""
    return n - -(-percent * n // 100) + 1 if n else 0
