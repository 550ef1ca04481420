"""Strings held against each other letter by letter: small helpers on the Arrow batches of a task.

As expressions these are nested array functions, which Spark interprets a letter at a time.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_INT = T.IntegerType()
_ENDS, _BEST = (T.StructType([T.StructField(n, t) for n, t in f]) for f in ([("head", _INT), ("tail", _INT)], [("n", _INT), ("unit", T.StringType())]))


def _rows(*columns: pa.Array):
    return zip(*[c.to_pylist() for c in columns])


def differing(a: str | None, b: str | None) -> int:
    if a is None or b is None or a == b:
        return 0
    return sum([x != y and x != "N" and y != "N" for x, y in zip(a, b)])


def alike(a: str | None, b: str | None) -> int | None:
    """Letters that two strings begin with alike; a null is like anything."""
    if a is None or b is None:
        return None if a is b else len(a if b is None else b)
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def ends(ref: str | None, alt: str | None) -> tuple[int | None, int | None]:
    """Letters that two alleles begin and, before that, end with alike, one letter kept of each."""
    least = lambda *texts: min([len(t) for t in texts if t is not None], default=0)
    if ref is None and alt is None:
        return None, None
    back = lambda t: t and t[::-1]
    tail = min(alike(back(ref), back(alt)), least(ref, alt) - 1)
    r, a = (t and t[: len(t) - tail] for t in (ref, alt))
    return min(alike(r, a), least(r, a) - 1), tail


def _piece(text: str, at: int, n: int) -> str:
    """``n`` letters from a place (1-based, from the end if negative) as SQL's substring gives them."""
    first = at - 1 if at > 0 else len(text) + at if at else 0
    return text[max(first, 0) : max(first + n, 0)]


def copies(context: str | None, at: int | None, unit: str | None) -> int:
    """Consecutive copies of a unit through or beside a place (1-based) of a context."""
    if context is None or at is None or not unit:
        return 0
    k, n = len(unit), 0
    most = max(1, len(context) // k)
    for _ in range(most):
        if at <= k or _piece(context, at - k, k) != unit:
            break
        at -= k
    while n < most and _piece(context, at, k) == unit:
        at, n = at + k, n + 1
    return n


@arrow_udf(_INT)
def hamming(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([differing(x, y) for x, y in _rows(a, b)], pa.int32())


@arrow_udf(_INT)
def prefix(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([alike(x, y) for x, y in _rows(a, b)], pa.int32())


@arrow_udf(_ENDS)
def shared_ends(ref: pa.Array, alt: pa.Array) -> pa.Array:
    found = [ends(r, a) for r, a in _rows(ref, alt)]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)], ["head", "tail"])


@arrow_udf(_INT)
def repeats(context: pa.Array, at: pa.Array, unit: pa.Array) -> pa.Array:
    return pa.array([copies(c, i, u) for c, i, u in _rows(context, at, unit)], pa.int32())


def _units(bases: str, sizes) -> list[str]:
    return [bases[:k] for k in sizes if k <= len(bases)] + [bases[-k:] for k in sizes if k <= len(bases)]


@cache
def best_repeat(most_unit: int):
    """(n, unit) of the unit with the most copies, the first of equal ones."""

    @arrow_udf(_BEST)
    def of(context: pa.Array, at: pa.Array, bases: pa.Array) -> pa.Array:
        counts, units = [], []
        for c, i, b in _rows(context, at, bases):
            n, unit = max([(copies(c, i, u), u) for u in dict.fromkeys(_units(b or "", range(most_unit, 0, -1)))], key=lambda x: x[0], default=(0, ""))
            counts.append(n)
            units.append(unit if n else "")
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(units, pa.string())], ["n", "unit"])

    return of


@cache
def repeats_beside(most_unit: int):
    """The most copies of a unit through a place or the next."""

    @arrow_udf(_INT)
    def of(context: pa.Array, at: pa.Array, alt: pa.Array) -> pa.Array:
        found = [[copies(c, j, u) for u in set(_units(b or "", range(1, most_unit + 1))) for j in (i, i + 1)] if i is not None else [] for c, i, b in _rows(context, at, alt)]
        return pa.array([max(f, default=0) for f in found], pa.int32())

    return of
