"""Character n-grams of whole texts, hashed, for a whole Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from varigrid.llm.common import text_parts
from varigrid.llm.shingles import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


@cache
def letters() -> np.ndarray:
    """Per code point its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letter_streams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: their letters in lower case, a single 0 for any run of
    other characters and at both ends of a text; and where each text starts (texts + 1)."""
    table = letters()
    for _, _, offsets, data in text_parts(column):
        code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = heads[offsets]
        n = len(starts) - 1
        # room for a 0 before each text and one after the last
        stream = np.zeros(len(code) + n + 1, np.uint32)
        begins = starts + np.arange(n + 1)
        room = np.ones(len(stream), bool)
        room[begins] = False
        stream[room] = table[code]
        keep = np.ones(len(stream), bool)
        keep[1:] = (stream[1:] != 0) | (stream[:-1] != 0)
        keep[begins] = True
        # a text ends with its own 0 or with the next one's
        cum = np.concatenate([[0], np.cumsum(keep)])
        yield stream[keep], cum[begins]


def gram_hashes(stream: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each place of a stream but the last ``size - 1``."""
    acc = np.full(max(0, len(stream) - size + 1), np.uint64(size))
    for i in range(size):
        acc = mix(acc + _STEP + stream[i : i + len(acc)])
    return (acc >> np.uint64(64 - bits)).astype(np.int64)


def gram_ladder(stream: np.ndarray, least: int, most: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(size, buckets) for each size from ``least`` to ``most``; a size's hashes extend those of the one before."""
    acc = np.full(len(stream), np.uint64(1))
    for i in range(most):
        acc = mix(acc[: max(0, len(stream) - i)] + _STEP + stream[i:])
        if i + 1 >= least:
            yield i + 1, (mix(acc + np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64)
