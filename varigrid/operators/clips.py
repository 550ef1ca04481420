"""Clips put back after a realignment, as far as the bases under them still disagree with the reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varigrid.functions import clipped

#: Fixed value: so many clipped bases may have one mismatch before the clip counts as messy.
BASES_A_MISMATCH = 12


def base_marks(read: Column) -> Column:
    """A letter for each base of a read (pos, cigar, bases, context, context_start): ``=`` match, ``X`` mismatch or N, ``U`` not mapped."""
    return clipped.marks(read["pos"].cast("long"), read["cigar"], read["bases"], read["context"], read["context_start"].cast("long"))


def reclipped(cigar: Column, marks: Column, prefix: Column, suffix: Column, clip_matches: bool = False, mess: bool = True, only_n: bool = False, prefix_n: Column | None = None, suffix_n: Column | None = None) -> Column:
    """A realigned read's alignment with its former clips of ``prefix`` and ``suffix`` bases put back where they are still needed.

    Clips end before the first insertion or deletion from their side, and an alignment
    without any stays.  A clip with more than one mismatch in BASES_A_MISMATCH comes
    back whole, else from its innermost mismatch outwards.  The base beside an
    insertion or deletion stays as an anchor; two bases do at the start, where clips
    stand for ``mess``.  ``clip_matches`` brings the clip at the start back in any case, ``only_n`` brings back
    nothing but outer N (``prefix_n``, ``suffix_n`` of them).  One base is always left mapped.
    """
    none = F.lit(0)
    prefix_n, suffix_n = prefix_n if prefix_n is not None else none, suffix_n if suffix_n is not None else none
    numbers = [n.cast("int") for n in (prefix, suffix, prefix_n, suffix_n)]
    return clipped.put_back(clip_matches, mess, only_n, BASES_A_MISMATCH)(cigar, marks, *numbers)
