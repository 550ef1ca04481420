"""Variants near each other on the same molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varigrid.operators import blocks, intervals
from varigrid.operators.pairs import DUPLICATE, PROPER, has

#: Neighbours are nearer than this.
GAP = 50


def neighborhoods(sites: DataFrame, gap: int = GAP) -> DataFrame:
    """Adds ``nbhd`` to sites (chrom, pos): runs in which each is less than ``gap`` from the one before; lone sites go."""
    rows = blocks.running(sites, ["chrom"], "pos", ["pos"], F.col("pos"), "_before")
    new = F.when(F.col("pos") - F.col("_before") < gap, 0).otherwise(1)
    runs = blocks.running(rows, ["chrom"], "pos", ["pos"], new, "nbhd", "sum", own=True).drop("_before")
    return runs.withColumn("_n", F.count("*").over(Window.partitionBy("chrom", "nbhd"))).filter("_n >= 2").drop("_n")


def ranges(sites: DataFrame) -> DataFrame:
    """(chrom, nbhd, first, last, sites): first and last place that a neighborhood's alleles touch."""
    end = F.col("pos") + F.greatest(F.length("ref"), F.length("alt")) - 1
    return sites.groupBy("chrom", "nbhd").agg(F.min("pos").alias("first"), F.max(end).alias("last"), F.count("*").alias("sites"))


def site_states(observed: DataFrame) -> DataFrame:
    """(chrom, nbhd, read, pos, state) from bases of reads at sites: alt, ref, other, or N for no data."""
    base = F.col("base")
    state = F.when(base == "N", "N").when(base == F.col("alt"), "alt").when(base == F.col("ref"), "ref").otherwise("X")
    return observed.select("chrom", "nbhd", "read", "pos", state.alias("state"))


def signatures(states: DataFrame) -> DataFrame:
    """(chrom, nbhd, signature, n): reads with the same states at the same sites, counted.

    A signature is ``pos:state`` in order; reads of no data are left out.
    """
    reads = states.filter("state <> 'N'").groupBy("chrom", "nbhd", "read").agg(F.array_sort(F.collect_set(F.struct("pos", "state"))).alias("sites"))
    text = F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["pos"].cast("string"), s["state"])), ",")
    return reads.groupBy("chrom", "nbhd", text.alias("signature")).agg(F.count("*").alias("n"))


def depths(signed: DataFrame) -> DataFrame:
    """(chrom, nbhd, pos, depth, support) from signatures and their numbers."""
    rows = signed.select("chrom", "nbhd", "n", F.explode(F.split("signature", ",")).alias("s")).withColumn("s", F.split("s", ":"))
    return rows.groupBy("chrom", "nbhd", F.get("s", F.lit(0)).cast("long").alias("pos")).agg(F.sum("n").alias("depth"), F.sum(F.when(F.get("s", F.lit(1)) == "alt", F.col("n")).otherwise(0)).alias("support"))


def weights(signed: DataFrame) -> DataFrame:
    """Adds ``weight``: a signature's share of its neighborhood's reads."""
    return signed.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("chrom", "nbhd")))


def one_state(states: DataFrame) -> DataFrame:
    """(chrom, nbhd, read, pos, state): a read's state at a site, where it has several the first of X, alt and ref; N is left out.

    States are numbers meanwhile, so that rows meet in a hash aggregate and are not sorted for it.
    """
    number = F.when(F.col("state") == "X", 0).when(F.col("state") == "alt", 1).otherwise(2)
    least = states.filter("state <> 'N'").groupBy("chrom", "nbhd", "read", "pos").agg(F.min(number).alias("_least"))
    return least.select("chrom", "nbhd", "read", "pos", F.when(F.col("_least") == 0, "X").when(F.col("_least") == 1, "alt").otherwise("ref").alias("state"))


def together(states: DataFrame) -> DataFrame:
    """(chrom, nbhd, pos_a, pos_b, both, a_known, p): of the reads that carry a and know b, the share that carries b.

    A read is one row with the sites that it carries and knows, and gives its own pairs: states are read once and
    meet no copy of themselves.  A read's sites are bounded by those of a neighborhood.  Rows of no read or neighborhood give none.
    """
    carried, pos = F.when(F.col("state") == "alt", F.col("pos")), F.col("pos")
    reads = states.filter("state <> 'N'").na.drop(subset=["chrom", "nbhd", "read"]).groupBy("chrom", "nbhd", "read").agg(F.collect_set(carried).alias("_carried"), F.collect_set(pos).alias("_known"))
    met = reads.filter(F.size("_carried") > 0).select("chrom", "nbhd", "_carried", "_known", F.explode("_carried").alias("pos_a"))
    met = met.select("chrom", "nbhd", "pos_a", "_carried", F.explode("_known").alias("pos_b")).filter("pos_a <> pos_b")
    b = F.array_contains("_carried", F.col("pos_b")).cast("int")
    return met.select("chrom", "nbhd", "pos_a", "pos_b", b.alias("b")).groupBy("chrom", "nbhd", "pos_a", "pos_b").agg(F.sum("b").alias("both"), F.count("*").alias("a_known"), F.avg("b").alias("p"))


def merged_calls(original: DataFrame, phased: DataFrame, used: DataFrame) -> DataFrame:
    """Original calls that no phased allele has used up, and the phased ones, each line once."""
    kept = original.join(used.select("chrom", "pos", "ref", "alt").distinct(), ["chrom", "pos", "ref", "alt"], "left_anti")
    return kept.unionByName(phased, allowMissingColumns=True).dropDuplicates(["chrom", "pos", "ref", "alt"])


def phasable(calls: DataFrame, passing_only: bool = False, het_only: bool = False, chroms: list[str] | None = None) -> DataFrame:
    """Calls (chrom, ref, alt, genotype, filters) that may be phased: no references, no-calls or odd alleles."""
    keep = (F.col("alt") != ".") & (F.col("alt") != F.col("ref")) & F.col("alt").rlike("^[ACGT]+$") & ~F.col("genotype").isin("./.", "0/0", "0/.")
    if het_only:
        keep = keep & F.col("genotype").isin("0/1", "1/2")
    if passing_only:
        keep = keep & (F.size("filters") == 0)
    return calls.filter(keep & F.col("chrom").isin(chroms) if chroms else keep)


def with_passing(sites: DataFrame, least: int = 1) -> DataFrame:
    """Sites (chrom, nbhd, filters) of neighborhoods with enough passing ones, or with passing ones alone."""
    order = Window.partitionBy("chrom", "nbhd")
    good, bad = F.sum((F.size("filters") == 0).cast("int")).over(order), F.sum((F.size("filters") > 0).cast("int")).over(order)
    return sites.withColumns({"_good": good, "_bad": bad}).filter((F.col("_good") >= least) | (F.col("_bad") == 0)).drop("_good", "_bad")


def clipped_support(calls: DataFrame, clips: DataFrame) -> DataFrame:
    """Calls (chrom, pos, alt, support) with the reads added whose soft clip agrees with ALT.

    ``clips`` (chrom, pos, bases, at_end) has for each clip the place where it
    begins and its bases: one at a read's end must begin ALT there, one at its
    start must end it there.
    """
    end = F.col("pos") + F.length("alt") - 1
    keyed = calls.select("*", F.col("pos").alias("_start"), end.alias("_end"))
    c = clips.select("chrom", F.col("pos").alias("_at"), F.col("bases").alias("_bases"), F.col("at_end").alias("_at_end"))
    forward = keyed.join(c.filter("_at_end"), (keyed["chrom"] == c["chrom"]) & (keyed["_start"] == c["_at"]) & (F.col("alt").startswith(F.col("_bases")) | F.col("_bases").startswith(F.col("alt")))).drop(c["chrom"])
    back = keyed.join(c.filter("not _at_end"), (keyed["chrom"] == c["chrom"]) & (keyed["_end"] == c["_at"]) & (F.col("alt").endswith(F.col("_bases")) | F.col("_bases").endswith(F.col("alt")))).drop(c["chrom"])
    more = forward.unionByName(back).groupBy("chrom", "pos", "alt").agg(F.count("*").alias("_n"))
    return calls.join(more, ["chrom", "pos", "alt"], "left").withColumn("support", F.col("support") + F.coalesce("_n", F.lit(0))).drop("_n")


def reads_near(reads: DataFrame, regions: DataFrame, min_mapq: int = 1, duplicates: bool = False, proper_only: bool = False, look_ahead: int = 0) -> DataFrame:
    """Pairs (a, b) of a read (chrom, start, stop, flag, mapq) and a neighborhood (chrom, first, last) whose reads it is one of.

    It ends no earlier than the first place and begins no later than ``look_ahead`` after the last.
    """
    keep = F.col("mapq") >= min_mapq
    if not duplicates:
        keep = keep & ~has(F.col("flag"), DUPLICATE)
    if proper_only:
        keep = keep & has(F.col("flag"), PROPER)
    wide = regions.withColumns({"start": F.col("first"), "stop": F.col("last") + look_ahead})
    return intervals.overlapping(reads.filter(keep), wide, ["chrom"])


def clipped_within(read: Column, first: Column, last: Column) -> Column:
    """Whether a read (start, stop, start_clip, end_clip) is soft-clipped at a place from ``first`` to ``last``."""
    return ((read["start_clip"] > 0) & read["start"].between(first, last)) | ((read["end_clip"] > 0) & read["stop"].between(first, last))


def first_neighborhoods(regions: DataFrame, most: int) -> DataFrame:
    """The first neighborhoods by chromosome and place: a limit for looking into a run."""
    return regions.orderBy("chrom", "first").limit(most)


def merged_sites(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, ref, alt): per site what its last member (member, ref, alt) knows; N is unknown."""
    known = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "N", F.col("member"))), F.lit("N")).alias(c)
    return members.groupBy(*by).agg(known("ref"), known("alt"))


def without_worst(clusters: DataFrame, most: int, by: list[str]) -> DataFrame:
    """Clusters (weight) without those of the least weight of their group, if these are ``most`` or fewer."""
    least = clusters.groupBy(*by).agg(F.min("weight").alias("_least"))
    ties = clusters.join(least, by).filter("weight = _least").groupBy(*by).agg(F.min("weight").alias("_least"), F.count("*").alias("_ties"))
    kept = (F.col("weight") > F.col("_least")) | (F.col("_ties") > most)
    return clusters.join(ties, by).filter(kept).drop("_least", "_ties")


def reconciled(calls: DataFrame) -> DataFrame:
    """Calls (chrom, pos, ref, alt, forced) without forced alleles that were found anyway.

    A locus where nothing but the reference was found keeps its forced alleles all.
    """
    found = calls.filter(~F.col("forced"))
    variant = found.groupBy("chrom", "pos").agg(F.max(F.col("ref") != F.col("alt")).alias("_variant"))
    same = found.select("chrom", "pos", "ref", "alt").distinct().withColumn("_same", F.lit(True))
    seen = calls.join(same, ["chrom", "pos", "ref", "alt"], "left").join(variant, ["chrom", "pos"], "left")
    return seen.filter(~F.coalesce(F.col("forced") & F.col("_same") & F.col("_variant"), F.lit(False))).drop("_same", "_variant")
