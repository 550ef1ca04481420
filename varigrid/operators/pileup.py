"""Counts of base observations by position, and what they say of alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(base: Column, q: Column, least: int = 20) -> Column:
    """The base, or N where its quality is too low."""
    return F.when(q < least, "N").otherwise(base)


def base_counts(obs: DataFrame) -> DataFrame:
    """(chrom, pos, base, dir, n): summed on each task before anything is shuffled."""
    return obs.groupBy("chrom", "pos", "base", "dir").agg(F.count("*").alias("n"))


def base_errors(obs: DataFrame) -> DataFrame:
    """Summed error probabilities per position and base."""
    return obs.groupBy("chrom", "pos", "base").agg(F.sum(F.pow(F.lit(10.0), -F.col("q") / 10.0)).alias("errors"), F.count("*").alias("n"))


def anchor(left: Column, right: Column, most: int = 5) -> Column:
    """Which end of its read a base is nearer to, and how far, in ``2 * most + 1`` kinds.

    The nearer end's distance, ``most`` from there on; distances to the right end count down from ``2 * most``.
    """
    from_right = F.when(right >= most, most).otherwise(2 * most - right)
    return F.when(left >= right, from_right).when(left >= most, most).otherwise(left)


def anchored_counts(obs: DataFrame, left: Column, right: Column, least: int, most: int, tracked: int = 5) -> DataFrame:
    """(chrom, pos, base, n, anchored): all reads, and those whose anchor kind is in least..most."""
    kind = anchor(left, right, tracked)
    return obs.groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"), F.sum(kind.between(least, most).cast("long")).alias("anchored"))


def alleles(obs: DataFrame, *by: str) -> DataFrame:
    """Per position: coverage dp, support ad, reference support rd, unknown bases nc, and ad and dp by direction."""
    n = lambda what: F.sum(what.cast("long"))
    base, known = F.col("base"), F.col("base") != "N"
    by_dir = lambda what: F.array(*[n(what & (F.col("dir") == d)) for d in range(3)])
    return obs.groupBy(*by, "chrom", "pos", "ref", "alt").agg(
        n(known).alias("dp"), n(base == F.col("alt")).alias("ad"), n(base == F.col("ref")).alias("rd"), n(~known).alias("nc"),
        by_dir(base == F.col("alt")).alias("ad_by_dir"), by_dir(known).alias("dp_by_dir"),
    )


def amplicon_counts(obs: DataFrame) -> DataFrame:
    """(chrom, pos, amplicon, coverage, support): known bases and those of the alternative allele."""
    return obs.filter("base <> 'N'").groupBy("chrom", "pos", "amplicon").agg(F.count("*").alias("coverage"), F.sum((F.col("base") == F.col("alt")).cast("long")).alias("support"))


def spanning_coverage(at_start: Column, at_end: Column, take_least: Column | bool) -> Column:
    """Coverage by direction of an allele between two places, and in all, from their counts by direction.

    Stitched reads of either place are halved between the strands, the odd one
    to the forward strand.  Deletions and longer alleles average the places;
    an insertion on unstitched input takes the lesser.
    """
    forward = lambda c: F.get(c, 0) + F.ceil(F.get(c, 2) / 2)
    reverse = lambda c: F.get(c, 1) + F.floor(F.get(c, 2) / 2)
    least = F.lit(take_least) if isinstance(take_least, bool) else take_least
    join = lambda a, b: F.when(least, F.least(a, b).cast("double")).otherwise((a + b) / 2.0)
    f, r = join(forward(at_start), forward(at_end)), join(reverse(at_start), reverse(at_end))
    return F.struct(f.cast("int").alias("forward"), r.cast("int").alias("reverse"), (f + r).cast("int").alias("total"))


def candidate_sums(candidates: DataFrame, *open_ends: str) -> DataFrame:
    """Equal candidates as one with their supports added; with their open ends if those count."""
    return candidates.groupBy("chrom", "pos", "ref", "alt", *open_ends).agg(F.sum("support").alias("support"))


def gapped_reference(mnvs: DataFrame) -> DataFrame:
    """(chrom, pos, n): support of reference bases inside longer alleles (chrom, pos, ref, alt, support)."""
    inside = mnvs.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("ref") - 1)))
    same = F.substring("ref", F.col("i") + 1, F.lit(1)) == F.substring("alt", F.col("i") + 1, F.lit(1))
    return inside.filter(same).groupBy("chrom", (F.col("pos") + F.col("i")).alias("pos")).agg(F.sum("support").alias("n"))


#: The kinds of collapsed reads.
COLLAPSED = tuple(f"{a}_{b}" for a in ("duplex", "simplex_forward", "simplex_reverse", "simplex_other") for b in ("stitched", "unstitched"))


def collapsed_counts(reads: DataFrame, *by: str) -> DataFrame:
    """Reads (kind) of each kind of collapsed read, a column a kind."""
    return reads.groupBy(*by).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in COLLAPSED])


def exact_coverage(candidates: DataFrame, reads: DataFrame, bin_width: int = 100) -> DataFrame:
    """Candidates (chrom, pos, ref, alt) with the reads (chrom, start, stop, dir) that span them from the base before to the base after, by direction.

    A range join in bins; a pair counts in the candidate's own bin, so none counts twice.  Reads of the same
    places and direction are counted before they meet candidates, so depth adds no pairs.
    """
    keyed = candidates.withColumns({"_lo": F.col("pos") - 1, "_hi": F.col("pos") + F.length("ref"), "_bin": F.floor(F.col("pos") / bin_width)})
    alike = reads.groupBy("chrom", "start", "stop", "dir").agg(F.count("*").alias("_n"))
    spread = alike.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("stop") / bin_width)))).alias("r")
    on = (F.col("c.chrom") == F.col("r.chrom")) & (F.col("c._bin") == F.col("r._bin")) & (F.col("start") <= F.col("_lo")) & (F.col("stop") >= F.col("_hi"))
    met = keyed.alias("c").join(spread, on, "left")
    n = lambda d: F.coalesce(F.sum(F.when(F.col("dir") == d, F.col("_n"))), F.lit(0).cast("long"))
    return met.groupBy("c.chrom", "pos", "ref", "alt").agg(F.array(*[n(d) for d in range(3)]).alias("spanning"))


def reference_candidates(obs: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(chrom, pos, support): reference support by position, with 0 at positions of the regions (chrom, start, stop) without a row."""
    seen = obs.groupBy("chrom", "pos").agg(F.count_if(F.col("base") == F.col("ref")).alias("support"))
    if regions is None:
        return seen
    spine = regions.select("chrom", F.explode(F.sequence("start", "stop")).alias("pos")).distinct()
    return spine.join(seen, ["chrom", "pos"], "full_outer").na.fill(0, ["support"])
