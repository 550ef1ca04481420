"""Words of whole texts for an Arrow batch at once, as places and as exact strings.

A word is a longest run of bytes that are no separators.  Separators are ASCII,
so that cutting UTF-8 at them never cuts a character.  A-Z is lower-cased, no
other letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from varigrid.llm.common import text_parts
from varigrid.llm.shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Part:
    """Words of some texts: their codes in ``distinct``, the rows (texts + 1) and the pieces that they stand in."""

    def __init__(self, first: int, codes: np.ndarray, distinct: pa.Array, at: np.ndarray, piece: np.ndarray):
        self.first, self.codes, self.distinct, self.at, self.piece = first, codes, distinct, at, piece

    def rows(self) -> np.ndarray:
        """Each word's text, counted from the batch's first."""
        return np.repeat(np.arange(self.first, self.first + len(self.at) - 1), np.diff(self.at))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each of ``distinct``."""
        return string_hashes(self.distinct)


def string_hashes(strings: pa.Array) -> np.ndarray:
    words = strings.cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


class Cutter:
    """Cuts texts at ``separators``; what stands between two ``breaks`` is one piece."""

    def __init__(self, separators: bytes, breaks: bytes = b""):
        self.word, self.breaks = np.ones(256, bool), np.zeros(256, bool)
        self.word[list(separators + breaks)] = False
        self.breaks[list(breaks)] = True
        self.broken = bool(breaks)

    def parts(self, column: pa.Array, most_bytes: int) -> Iterator[Part]:
        for i, _, offsets, data in text_parts(column, most_bytes):
            word = self.word[data]
            first = word.copy()
            first[1:] &= ~word[:-1]
            begins = offsets[:-1][offsets[:-1] < len(data)]
            first[begins] = word[begins]
            last = word.copy()
            last[:-1] &= ~word[1:]
            ends = offsets[1:][offsets[1:] > 0] - 1
            last[ends] = word[ends]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            at = np.searchsorted(s, offsets, "left")
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            piece = np.cumsum(self.breaks[data], dtype=np.int64)[s] + text if self.broken and len(s) else text
            bounds = np.zeros(len(s) + 1, np.int32)
            np.cumsum(e - s, out=bounds[1:])
            kept = pa.py_buffer(_LOWER[data[word]])
            found = pa.StringArray.from_buffers(len(s), pa.py_buffer(bounds), kept).dictionary_encode()
            yield Part(i, found.indices.to_numpy().astype(np.int64), found.dictionary, at, piece)


def distinct_codes(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """The codes numbered anew from 0, and how many there are."""
    found = pa.array(codes).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), len(found.dictionary)


def chained(acc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of sequences, each with one more word at its end."""
    return mix(acc * np.uint64(3) + _STEP + hashes)


# -- sets of hashes as a bitmap of fixed size ----------------------------------


def bitmap(rows: dict[int, int], bits: int) -> np.ndarray:
    """64-bit words of a bitmap from (word, its bits) pairs."""
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    if rows:
        out[np.fromiter(rows.keys(), np.int64, len(rows))] = np.fromiter(rows.values(), np.int64, len(rows)).view(np.uint64)
    return out


def place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def within(held: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = place(hashes, bits)
    return (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
