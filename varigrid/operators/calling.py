"""From counted alleles to filtered calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions import sequence, stats
from varigrid.operators.summaries import with_reference


@dataclass(frozen=True)
class CallOptions:
    """Defaults of a somatic run; a filter of None is off."""

    noise_q: int = 20
    max_q: int = 100
    min_frequency: float = 0.01
    min_q: int = 20
    q_filter: int | None = 30
    min_depth: int = 10
    no_call_filter: float | None = 0.6
    strand_bias: float | None = 0.5
    frequency_filter: float | None = None
    repeat_filter: tuple[int, int, float] | None = (5, 9, 0.35)
    indel_repeats: int | None = None
    both_strands: bool = False
    gvcf: bool = True


def allele_type(ref: Column, alt: Column) -> Column:
    """ref, snv, mnv, ins, del, or complex by the lengths of REF and ALT."""
    r, a = F.length(ref), F.length(alt)
    first = F.substring(ref, 1, 1) == F.substring(alt, 1, 1)
    return (
        F.when((alt == ".") | (alt == ref), "ref").when((r == 1) & (a == 1), "snv").when(r == a, "mnv")
        .when((r == 1) & first, "ins").when((a == 1) & first, "del").otherwise("complex")
    )


def frequency(support: Column, coverage: Column) -> Column:
    """Support in coverage as a 32-bit number, at most 1 and 0 without coverage."""
    return F.when(coverage == 0, F.lit(0.0)).otherwise(F.least(support / coverage, F.lit(1.0))).cast("float")


def no_call_fraction(no_calls: Column, coverage: Column) -> Column:
    total = no_calls + coverage
    return F.when(total == 0, F.lit(0.0)).otherwise(no_calls / total).cast("float")


def scored(alleles: DataFrame, options: CallOptions = CallOptions()) -> DataFrame:
    """Adds vf, vq, nc_fraction and sb to alleles (dp, ad, nc, ad_by_dir, dp_by_dir)."""
    rows = alleles.withColumns({"vf": frequency(F.col("ad"), F.col("dp")), "nc_fraction": no_call_fraction(F.col("nc"), F.col("dp"))})
    rows = rows.withColumn("vq", stats.variant_q(F.col("ad"), F.col("dp"), options.noise_q, options.max_q))
    return rows.withColumn("sb", stats.strand_bias(F.col("ad_by_dir"), F.col("dp_by_dir"), options.noise_q, options.strand_bias or 1.0))


def callable_rows(scored_rows: DataFrame, options: CallOptions = CallOptions()) -> DataFrame:
    """Rows worth reporting: the reference always, others with depth (unless gVCF), frequency and quality."""
    deep = F.lit(True) if options.gvcf else F.col("dp") >= options.min_depth
    seen = (F.col("vf") >= F.lit(options.min_frequency).cast("float")) & (F.col("vq") >= options.min_q)
    return scored_rows.filter((F.col("alt") == F.col("ref")) | (deep & seen))


def filters(options: CallOptions = CallOptions(), reference: Column | None = None) -> Column:
    """The filters of a scored row in reporting order, as an array of names."""
    alt = ~reference if reference is not None else F.lit(True)
    tags = [
        F.when(F.col("dp") < options.min_depth, "LowDP"),
        F.when((F.col("vq") < options.q_filter) & (F.col("dp") != 0), f"q{options.q_filter}") if options.q_filter is not None else None,
        F.when(alt & (F.col("nc_fraction") > F.lit(options.no_call_filter).cast("float")), "NC") if options.no_call_filter is not None else None,
        F.when(alt & ~F.col("sb.acceptable"), "SB") if options.strand_bias is not None else None,
        F.when(alt & (F.col("vf") < F.lit(options.frequency_filter).cast("float")), "LowVariantFreq") if options.frequency_filter is not None else None,
    ]
    return F.array_compact(F.array(*[t for t in tags if t is not None]))


def merged_filters(calls: DataFrame) -> DataFrame:
    """(chrom, pos, filters): the different filters of all alleles at a locus."""
    return calls.groupBy("chrom", "pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("filters"))


def with_forced(calls: DataFrame, forced: DataFrame) -> DataFrame:
    """All calls, and forced alleles (chrom, pos, ref, alt) that weren't called, tagged ForcedReport."""
    wanted = forced.filter(F.col("alt").rlike("^[ACGTacgt]+$") & F.col("ref").rlike("^[ACGTacgt]+$"))
    wanted = wanted.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).filter("ref <> alt").distinct()
    missing = wanted.join(calls, ["chrom", "pos", "ref", "alt"], "left_anti")
    return calls.withColumn("forced", F.lit(False)).unionByName(missing.withColumns({"filters": F.array(F.lit("ForcedReport")), "forced": F.lit(True)}), allowMissingColumns=True)


def without_covered_references(calls: DataFrame) -> DataFrame:
    """Reference rows go where a locus has an alternative that was not forced."""
    locus = Window.partitionBy("chrom", "pos")
    real = F.max(((F.col("alt") != F.col("ref")) & ~F.col("forced")).cast("int")).over(locus)
    return calls.withColumn("_real", real).filter((F.col("alt") != F.col("ref")) | (F.col("_real") == 0)).drop("_real")


def by_frequency(vf: str = "vf"):
    """Alleles of a locus from the most frequent on, ties by REF and ALT."""
    return Window.partitionBy("chrom", "pos").orderBy(F.desc(vf), "ref", "alt")


def top_two(calls: DataFrame) -> DataFrame:
    """The two most frequent alternatives of a locus; the second goes if more is left beside all of the locus's alternatives than it has."""
    locus = Window.partitionBy("chrom", "pos")
    rest = 1.0 - F.sum(F.col("vf").cast("double")).over(locus)
    ranked = calls.withColumns({"rank": F.row_number().over(by_frequency()), "_rest": rest})
    # five decimals: the order of a sum must not decide
    return ranked.filter((F.col("rank") == 1) | (F.col("rank") == 2) & (F.round("_rest", 5) <= F.round(F.col("vf").cast("double"), 5))).drop("_rest")


def phase_sets(calls: DataFrame) -> DataFrame:
    """Adds phase_set: 0 for the reference, 1, 2, ... for alternatives in order of frequency."""
    is_ref = F.col("alt") == F.col("ref")
    order = Window.partitionBy("chrom", "pos", is_ref).orderBy(F.desc("vf"), "ref", "alt")
    return calls.withColumn("phase_set", F.when(is_ref, 0).otherwise(F.row_number().over(order)))


def repeat_tag(context: Column, at: Column, ref: Column, alt: Column, vf: Column, unit: int = 5, copies: int = 9, limit: float = 0.35) -> Column:
    """``R5x9`` where an allele's bases recur so often at its place in a reference context, and it is no more frequent than the limit; else null.

    A substitution counts as a deletion and an insertion: the lesser of both counts.
    """
    gone = F.when(F.length(ref) > 1, F.substring(ref, 2, 1000)).otherwise(ref)
    new = F.when(F.length(alt) > 1, F.substring(alt, 2, 1000)).otherwise(alt)
    kind = allele_type(ref, alt)
    a, b = sequence.repeats_around(context, at, gone, unit), sequence.repeats_around(context, at, new, unit)
    n = F.when(kind == "ins", b).when(kind == "del", a).otherwise(F.least(a, b))
    return F.when((n >= copies) & (vf < F.lit(limit).cast("float")), f"R{unit}x{copies}")


def indel_repeat_tag(context: Column, at: Column, ref: Column, alt: Column, most: int) -> Column:
    """``R8`` and the like where the unit that an indel's bases consist of recurs so often at its place; else null."""
    kind = allele_type(ref, alt)
    bases = F.when(kind == "ins", F.substring(alt, 2, 1000)).when(kind == "del", F.substring(ref, 2, 1000))
    unit = sequence.repeat_unit(bases)
    n = F.greatest(sequence.repeat_context(context, at, unit), sequence.repeat_context(context, at + 1, unit))
    return F.when(kind.isin("ins", "del") & (n >= most), f"R{most}")


def with_context_tags(calls: DataFrame, reference: DataFrame, options: CallOptions = CallOptions(), biased: DataFrame | None = None, flank: int = 100, block: int = 1000) -> DataFrame:
    """Calls (chrom, pos, ref, alt, vf, filters, sb) with the filters that need more than their counts.

    ``RMxN`` and, if ``indel_repeats`` is set, ``RN`` come from the ``reference`` (contig, start, bases)
    ``flank`` places either side, ``AB`` from ``biased`` (chrom, pos, biased), and ``SB`` with
    ``both_strands`` where one strand alone carries the allele.  References get none.
    """
    rows = with_reference(calls, reference, F.col("pos") - flank, F.col("pos") + F.length("ref") + flank, block)
    at = (F.col("pos") - F.col("context_start") + 1).cast("int")
    alternative = (F.col("alt") != ".") & (F.col("alt") != F.col("ref"))
    tags = []
    if options.both_strands:
        tags.append(F.when(~F.col("sb.both"), "SB"))
    if biased is not None:
        rows = rows.join(biased.select("chrom", "pos", F.col("biased").alias("_biased")), ["chrom", "pos"], "left")
        tags.append(F.when(F.col("_biased"), "AB"))
    if options.indel_repeats is not None:
        tags.append(indel_repeat_tag(F.col("context"), at, F.col("ref"), F.col("alt"), options.indel_repeats))
    if options.repeat_filter is not None:
        unit, copies, limit = options.repeat_filter
        tags.append(repeat_tag(F.col("context"), at, F.col("ref"), F.col("alt"), F.col("vf"), unit, copies, limit))
    more = F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>")
    rows = rows.withColumn("filters", F.when(alternative, F.array_union("filters", more)).otherwise(F.col("filters")))
    return rows.drop("context", "context_start", "_biased")


def with_known(candidates: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds ``known``: whether an allele is among the known ones (chrom, pos, ref, alt)."""
    marked = priors.select("chrom", "pos", "ref", "alt").distinct().withColumn("known", F.lit(True))
    return candidates.join(marked, ["chrom", "pos", "ref", "alt"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def tagged(calls: DataFrame, name: str, when: Column) -> DataFrame:
    """Calls with one more filter where a condition holds, such as LowGQ."""
    return calls.withColumn("filters", F.when(when, F.array_union("filters", F.array(F.lit(name)))).otherwise(F.col("filters")))


def elided(calls: DataFrame, gvcf: bool) -> DataFrame:
    """Without homozygous references unless gVCF, and without reference-like no-calls in any case."""
    reference = F.col("alt") == "."
    return calls.filter(~((F.lit(not gvcf) & (F.col("genotype") == "0/0")) | (reference & (F.col("genotype") == "./."))))
