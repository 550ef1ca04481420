"""Strings of bases and alignment operations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varigrid.functions import compared

#: Operations that take bases of the read, of the reference.
ON_READ, ON_REFERENCE = "MIS=X", "MDN=X"


def cigar(text: Column) -> Column:
    """Array of (len, op) of an alignment string."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    return F.zip_with(*parts, lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))


def span(ops: Column, kinds: str) -> Column:
    """Bases that the operations of some kinds take."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["len"])


def clip(ops: Column, at_end: bool = False) -> Column:
    """Soft-clipped bases at an end, inside a hard clip."""
    hard = F.filter(ops, lambda x: x["op"] != "H")
    edge = F.element_at(hard, -1 if at_end else 1)
    return F.when((F.size(hard) > 0) & (edge["op"] == "S"), edge["len"]).otherwise(0)


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def reversed_cigar(ops: Column) -> Column:
    return F.reverse(ops)


def expanded(ops: Column) -> Column:
    """One letter for each place of an alignment string."""
    return F.array_join(F.transform(ops, lambda x: F.repeat(x["op"], x["len"])), "")


def position_map(ops: Column, start: Column) -> Column:
    """Per base of the read its place in the reference, -1 where it has none."""
    def step(acc: Column, x: Column) -> Column:
        places = F.when(x["op"].isin(*"M=X"), F.transform(F.sequence(F.lit(0), x["len"] - 1), lambda i: (acc["at"] + i).cast("long"))).when(
            x["op"].isin("I", "S"), F.array_repeat(F.lit(-1).cast("long"), x["len"])).otherwise(F.array().cast("array<long>"))
        moved = F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)
        return F.struct((acc["at"] + moved).alias("at"), F.concat(acc["map"], places).alias("map"))

    return F.aggregate(ops, F.struct(start.cast("long").alias("at"), F.array().cast("array<long>").alias("map")), step, lambda a: a["map"])


def directions(text: Column) -> Column:
    """Per base 0, 1 or 2 from a run-length text of F, R and S such as 3F5S2R."""
    runs = F.zip_with(F.regexp_extract_all(text, F.lit(r"(\d+)[FRS]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\d+([FRS])"), F.lit(1)), lambda n, d: F.array_repeat(F.when(d == "F", 0).when(d == "R", 1).otherwise(2), n.cast("int")))
    return F.flatten(runs)


def aligned_overlap(ops: Column, start: Column, lo: Column, hi: Column) -> Column:
    """Aligned bases of a read within lo..hi."""
    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["len"] - 1
        shared = F.when(x["op"].isin(*"M=X"), F.greatest(F.lit(0), F.least(end, hi) - F.greatest(acc["at"], lo) + 1)).otherwise(0)
        return F.struct((acc["at"] + F.when(x["op"].isin(*ON_REFERENCE), x["len"]).otherwise(0)).alias("at"), (acc["n"] + shared).alias("n"))

    return F.aggregate(ops, F.struct(start.cast("long").alias("at"), F.lit(0).cast("long").alias("n")), step, lambda a: a["n"])


def shared_prefix(a: Column, b: Column) -> Column:
    """Bases that two strings begin with alike."""
    return compared.prefix(a, b)


def shared_suffix(a: Column, b: Column) -> Column:
    return shared_prefix(F.reverse(a), F.reverse(b))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """Struct (pos, ref, alt) without a shared end and then a shared start, one base kept of each."""
    shared = compared.shared_ends(ref, alt)
    r, a = (F.left(x, F.length(x) - shared["tail"]) for x in (ref, alt))
    return F.struct((pos + shared["head"]).alias("pos"), F.substring(r, shared["head"] + 1, F.length(r)).alias("ref"), F.substring(a, shared["head"] + 1, F.length(a)).alias("alt"))


def repeat_unit(text: Column) -> Column:
    """The shortest string that repeated gives the text."""
    n = F.length(text)
    fits = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: (n % k == 0) & (F.repeat(F.left(text, k), (n / k).cast("int")) == text))
    return F.when(n > 0, F.left(text, F.element_at(fits, 1))).otherwise(text)


def run_at_start(text: Column, letters: str) -> Column:
    """Leading characters out of some letters."""
    return F.length(F.regexp_extract(text, f"^[{letters}]*", 0))


def longest_homopolymer(text: Column) -> Column:
    """Length of the longest run of one character."""
    runs = F.regexp_extract_all(text, F.lit(r"((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def most_repeats(text: Column, unit: str) -> Column:
    """The most consecutive times that a unit occurs."""
    runs = F.regexp_extract_all(text, F.lit(f"((?:{unit})+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: (F.length(r) / len(unit)).cast("int"))), F.lit(0))


def tandem(text: Column, most_unit: int = 3) -> Column:
    """Whether a text is one unit of up to so many bases over and over, cut off anywhere."""
    n = F.length(text)
    periods = [(n > k) & (F.substring(text, F.lit(k + 1), n) == F.left(text, n - k)) for k in range(1, most_unit + 1)]
    found = periods[0]
    for p in periods[1:]:
        found = found | p
    return found


def one_base_share(text: Column) -> Column:
    """Share of the commonest of A, C, G and T."""
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise(F.greatest(*[F.length(text) - F.length(F.replace(text, F.lit(b), F.lit(""))) for b in "ACGT"]) / n)


def repeat_context(context: Column, at: Column, unit: Column) -> Column:
    """Consecutive copies of a unit in a reference context, through or beside a place (1-based)."""
    return compared.repeats(context, at.cast("int"), unit)


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings differ as far as both go; N differs from nothing."""
    return compared.hamming(a, b)


def md_substitutions(md: Column) -> Column:
    """Number of substituted bases in a mismatch tag; deleted bases after ``^`` don't count."""
    return F.length(F.regexp_replace(F.regexp_replace(md, r"\^[A-Z]+", ""), "[^A-Z]", ""))


def allele_code(base: Column) -> Column:
    """A, G, C, T, N and a deletion as 0 to 5; anything else is N."""
    return F.when(base == "A", 0).when(base == "G", 1).when(base == "C", 2).when(base == "T", 3).when(base == "-", 5).otherwise(4)


def repeats_around(context: Column, at: Column, alt: Column, most_unit: int = 5) -> Column:
    """The most consecutive copies of any prefix or suffix of inserted or deleted bases, of up to ``most_unit`` bases, at a place (1-based) of a context."""
    return compared.repeats_beside(most_unit)(context, at.cast("int"), alt)


def orientation(reverse: Column, mate_reverse: Column, pos: Column, mate_pos: Column) -> Column:
    """FR, RF, FF or RR of a pair by which mate comes first."""
    first = pos <= mate_pos
    a, b = F.when(first, reverse).otherwise(mate_reverse), F.when(first, mate_reverse).otherwise(reverse)
    return F.concat(F.when(a, "R").otherwise("F"), F.when(b, "R").otherwise("F"))


def duplex_class(stitched: Column, orientation_text: Column, forward_families: Column, reverse_families: Column) -> Column:
    """One of eight kinds of collapsed read: duplex or simplex by its families (tags XV and XW), stitched or by orientation."""
    duplex = (F.coalesce(forward_families, F.lit(0)) > 0) & (F.coalesce(reverse_families, F.lit(0)) > 0)
    side = F.when(stitched, "stitched").otherwise("unstitched")
    simplex = F.when(orientation_text == "FR", "simplex_forward").when(orientation_text == "RF", "simplex_reverse").otherwise("simplex_other")
    return F.concat(F.when(duplex, "duplex").otherwise(simplex), F.lit("_"), side)


def supplementary(tag: Column) -> Column:
    """Array of (chrom, pos, strand, cigar, mapq, nm) of a supplementary-alignment tag."""
    parts = F.filter(F.split(tag, ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        F.get(F.split(x, ","), F.lit(0)).alias("chrom"), F.get(F.split(x, ","), F.lit(1)).cast("long").alias("pos"), F.get(F.split(x, ","), F.lit(2)).alias("strand"),
        F.get(F.split(x, ","), F.lit(3)).alias("cigar"), F.get(F.split(x, ","), F.lit(4)).cast("int").alias("mapq"), F.get(F.split(x, ","), F.lit(5)).cast("int").alias("nm")))


def run_lengths(letters: Column) -> Column:
    """An alignment string from one letter a place; ``expanded`` turned round."""
    return F.array_join(F.transform(F.regexp_extract_all(letters, F.lit(r"((.)\2*)"), F.lit(1)), lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def duplication(context: Column, at: Column, inserted: Column) -> Column:
    """Whether inserted bases repeat the reference right after or before a place (1-based), give or take two."""
    n = F.length(inserted)
    same = [F.substring(context, at + 1 + d, n) == inserted for d in range(-2, 3)] + [F.substring(context, F.greatest(F.lit(1), at + 1 - n + d), n) == inserted for d in range(-2, 3)]
    found = same[0]
    for s in same[1:]:
        found = found | s
    return (n >= 3) & found


def has_operation(ops: Column, kinds: str) -> Column:
    """Whether an alignment has an operation of some kinds."""
    return F.exists(ops, lambda x: x["op"].isin(*kinds))


def tags(text: Column) -> Column:
    """A read's tags, tab-separated as name:type:value, as a map from name to value."""
    parts = F.filter(F.split(text, "\t"), lambda x: x != "")
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(F.left(x, F.lit(2)), F.substring(x, F.lit(6), F.length(x)))))


def tag(held: Column, name: str) -> Column:
    """A tag's value, null where a read has none; ``XN`` is the amplicon's name."""
    return F.try_element_at(held, F.lit(name))


def with_tag(held: Column, name: str, value: Column) -> Column:
    """The tags with one set anew; a null value takes it away."""
    rest = F.map_filter(held, lambda k, _: k != name)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def indel_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """``chrom:pos ref>alt``; keys of several indels are joined with a bar."""
    return F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit(" "), ref, F.lit(">"), alt)


def indels_of_key(key: Column) -> Column:
    """Array of (chrom, pos, ref, alt) of a key."""
    part = lambda x, i: F.regexp_extract(x, r"^(.*):(\d+) ([A-Z]+)>([A-Z]+)$", i)
    return F.transform(F.split(key, r"\|"), lambda x: F.struct(part(x, 1).alias("chrom"), part(x, 2).cast("long").alias("pos"), part(x, 3).alias("ref"), part(x, 4).alias("alt")))


def wildcard_equal(a: Column, b: Column) -> Column:
    """Whether two strings of one length agree wherever neither has N."""
    return (F.length(a) == F.length(b)) & (hamming(a, b) == 0)


def support_direction(kind: Column, start: Column, length: Column, dirs: Column) -> Column:
    """Direction (0, 1 or 2) in which a read supports an allele whose first base is at ``start`` (0-based) of the read.

    ``kind`` is snv, reference, deletion, insertion or mnv.  A deletion takes the direction of the
    base before it, of the one after it where that is 2; longer alleles are 2 if any of their
    bases is.  Null where a direction changes inside an allele without a base of direction 2.
    """
    at = lambda i: F.get(dirs, i)
    inside = F.slice(dirs, start + 1, F.greatest(length, F.lit(1)))
    first, last = F.get(inside, F.lit(0)), F.get(F.reverse(inside), F.lit(0))
    through = F.when(F.exists(inside, lambda d: d == 2), 2).when(first == last, first)
    gap = F.when(start == 0, at(F.lit(0))).when(start == F.size(dirs), at(F.size(dirs) - 1)).when(at(start - 1) == 2, at(start)).otherwise(at(start - 1))
    return F.when(kind.isin("snv", "reference"), at(start)).when(kind == "deletion", gap).otherwise(through)


def bridge_anchored(bases: Column, dirs: Column) -> Column:
    """Whether what two mates share says where they belong: three bases at most, or no repeat of a unit of up to three."""
    letters = F.split(bases, "")
    shared = F.array_join(F.filter(F.zip_with(letters, dirs, lambda b, d: F.when(d == 2, b)), lambda b: b.isNotNull()), "")
    return (F.length(shared) <= 3) | ~tandem(shared)


def repeat_with_unit(context: Column, at: Column, bases: Column, most_unit: int = 5) -> Column:
    """(n, unit): the most consecutive copies of a prefix or suffix of ``bases`` through a place (1-based) of a context.

    Of units with as many copies a prefix comes before a suffix, a longer one before a shorter.
    """
    return compared.best_repeat(most_unit)(context, at.cast("int"), bases)


def flanked_by_repeats(bases: Column, unit: Column, at: Column) -> Column:
    """Whether a deletion's unit stands on both sides of it in a read, whose base before the deletion is at ``at`` (0-based)."""
    k = F.length(unit)
    return (at >= k) & (F.substring(bases, at + 2 - k, k) == unit) & (F.substring(bases, at + 2, k) == unit)


def sketchy_anchor(bases: Column, unit: Column, at: Column) -> Column:
    """Whether all of a read on one side of a deletion is its unit over and over, cut off at the read's end.

    ``at`` (0-based) is the base before the deletion.  Steps of a unit's length to the left count only
    where a whole unit fits before the read's end; the last one, shorter than a unit, is held against the unit's end.
    """
    n, k = F.length(bases), F.length(unit)
    rest = F.substring(bases, at + 2, n)
    right = (F.length(rest) > 0) & (rest == F.left(F.repeat(unit, (F.floor(n / k) + 1).cast("int")), F.length(rest)))
    steps = F.filter(F.sequence(at + 1, F.lit(1), -k), lambda i: i + k < n)
    left = (F.size(steps) > 0) & F.forall(steps, lambda i: F.substring(bases, i, F.least(i, k)) == F.right(unit, F.least(i, k)))
    return right | left
