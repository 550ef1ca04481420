"""Clips letter by letter: small helpers on the Arrow batches of a task, a read at a time.

As expressions these are nested array functions, which Spark interprets a letter at a time.  What follows
from an alignment alone is worked out once for alignments that recur.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from varigrid.functions.compared import _piece, _rows
from varigrid.functions.letters import _OPS, against, placed


@lru_cache(1 << 14)
def expanded(cigar: str) -> tuple[str, int, int]:
    """A letter for each place of an alignment, and how many M and S it begins and ends with."""
    text = "".join([op * int(n) for n, op in _OPS.findall(cigar)])
    return text, len(text) - len(text.lstrip("MS")), len(text) - len(text.rstrip("MS"))


def run_lengths(text: str) -> str:
    return "".join([f"{sum(1 for _ in same)}{op}" for op, same in groupby(text)])


@lru_cache(1 << 14)
def joined(cigar: str) -> str:
    return run_lengths(expanded(cigar)[0])


@lru_cache(1 << 14)
def cut(cigar: str, gone: tuple[int, ...]) -> str:
    """An alignment with some letters clipped; if no M is left, the last clipped base before anything else is one."""
    text = list(expanded(cigar)[0])
    for i in gone:
        text[i] = "S"
    new = "".join(text)
    return run_lengths(new if "M" in new else re.sub("^(S*)S", r"\1M", new))


def marked(pos: int | None, cigar: str | None, bases: str | None, context: str | None, start: int | None) -> str | None:
    if cigar is None:
        return None
    known = context if pos is not None and start is not None else None
    found = []
    for n, op, place, base in placed(cigar, pos or 0):
        if op in "M=X":
            read, ref = against(bases or "", base, n, known, place - (start or 0))
            found.append("=" * n if read == ref else "".join(["=" if a == b else "X" for a, b in zip(read, ref)]))
        elif op in "IS":
            found.append("U" * n)
    return "".join(found)


@arrow_udf(T.StringType())
def marks(pos: pa.Array, cigar: pa.Array, bases: pa.Array, context: pa.Array, start: pa.Array) -> pa.Array:
    return pa.array([marked(*r) for r in _rows(pos, cigar, bases, context, start)], pa.string())


@arrow_udf(T.StringType())
def merged(cigar: pa.Array) -> pa.Array:
    """Alignments whose neighbouring operations of a kind are one."""
    return pa.array([None if c is None else joined(c) for c in cigar.to_pylist()], pa.string())


@cache
def put_back(clip_matches: bool, mess: bool, only_n: bool, bases_a_mismatch: int):
    """Alignments from (cigar, marks, prefix, suffix, prefix_n, suffix_n) of ``clips.reclipped``."""

    def one(cigar: str | None, marks: str | None, prefix: int | None, suffix: int | None, prefix_n: int | None, suffix_n: int | None) -> str | None:
        if cigar is None or (prefix == 0 and suffix == 0):
            return cigar
        t, ahead, behind = expanded(cigar)
        n = len(t)
        if not n:
            return cigar
        # a null says nothing: it neither bounds a clip nor has marks
        least = lambda most, clip: most if clip is None else min(most, clip)
        first, last = least(ahead + 1, prefix) if ahead < n else 0, least(behind + 1, suffix) if behind < n else 0
        wrong = lambda i: _piece(marks, i + 1, 1) == "X"
        # places of the letters that may be clipped
        near = (2 if mess else 1) if first > ahead else 0
        left = [i for i in range(min(first, ahead - near)) if t[i] == "M"]
        start = n - last
        right = [i for i in range(0 if last <= behind else 2, last) if t[start + i] == "M"]
        to_l, to_r = None if marks is None or prefix is None else prefix - first, None if marks is None else len(marks) - last
        if only_n:
            gone_l = [i for i in left if prefix_n is not None and i < prefix_n]
            gone_r = [i for i in right if to_r is not None and suffix_n and suffix_n > 0 and to_r + i >= len(marks) - suffix_n]
        else:
            bad_l = [i for i in range(first) if wrong(to_l + i)] if to_l is not None else []
            bad_r = [i for i in range(last) if wrong(to_r + i)] if to_r is not None else []
            messy_l = prefix is not None and len(bad_l) > prefix / bases_a_mismatch
            messy_r = suffix is not None and len(bad_r) > suffix / bases_a_mismatch
            inner = max(set(bad_l).intersection(left), default=-1)
            outer = min(set(bad_r).intersection(right), default=n)
            gone_l = left if clip_matches or messy_l else [i for i in left if i <= inner]
            gone_r = right if messy_r else [i for i in right if i >= outer]
        return cut(cigar, (*gone_l, *[start + i for i in gone_r]))

    @arrow_udf(T.StringType())
    def of(cigar: pa.Array, marks: pa.Array, prefix: pa.Array, suffix: pa.Array, prefix_n: pa.Array, suffix_n: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in _rows(cigar, marks, prefix, suffix, prefix_n, suffix_n)], pa.string())

    return of
