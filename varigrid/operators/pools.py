"""Two samples of one source compared and combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.functions import stats

KEY = ["chrom", "pos", "ref", "alt"]


def venn(a: DataFrame, b: DataFrame) -> dict[str, DataFrame]:
    """Alleles of both samples and of one alone, with the columns of the first named."""
    return {
        "a_and_b": a.join(b.select(*KEY).distinct(), KEY, "left_semi"),
        "b_and_a": b.join(a.select(*KEY).distinct(), KEY, "left_semi"),
        "a_not_b": a.join(b, KEY, "left_anti"),
        "b_not_a": b.join(a, KEY, "left_anti"),
    }


def loci(a: DataFrame, b: DataFrame) -> DataFrame:
    """All loci of either sample with how many alleles each has there."""
    count = lambda df, name: df.groupBy("chrom", "pos").agg(F.count("*").alias(name))
    return count(a, "n_a").join(count(b, "n_b"), ["chrom", "pos"], "full_outer").na.fill(0, ["n_a", "n_b"])


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Alleles (chrom, pos, ref, alt, dp, ad, ...) of two samples side by side, as structs ``a`` and ``b``.

    Where a sample only has the reference at a locus, it meets all of the
    other's alleles; else alleles meet their like, and others no one.
    """
    lone = lambda df: df.groupBy("chrom", "pos").agg((F.count("*") == 1).alias("_one"), F.max(F.col("alt") == F.col("ref")).alias("_ref")).select("chrom", "pos", (F.col("_one") & F.col("_ref")).alias("lone"))
    x = a.join(lone(a), ["chrom", "pos"]).select("chrom", "pos", F.struct(*a.columns).alias("a"), F.col("lone").alias("lone_a"))
    y = b.join(lone(b), ["chrom", "pos"]).select("chrom", "pos", F.struct(*b.columns).alias("b"), F.col("lone").alias("lone_b"))
    either = x.join(y, ["chrom", "pos"]).filter("lone_a or lone_b").select("chrom", "pos", "a", "b")
    lone_loci = x.filter("lone_a").select("chrom", "pos").union(y.filter("lone_b").select("chrom", "pos")).distinct()
    both_loci = lone_loci.join(x.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi").join(y.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")
    rest = lambda df: df.join(both_loci, ["chrom", "pos"], "left_anti")
    p = rest(x).select("chrom", "pos", F.col("a.ref").alias("ref"), F.col("a.alt").alias("alt"), "a")
    q = rest(y).select("chrom", "pos", F.col("b.ref").alias("ref"), F.col("b.alt").alias("alt"), "b")
    return either.unionByName(p.join(q, KEY, "full_outer").select("chrom", "pos", "a", "b"))


def comparison(a_is_ref: Column, b_is_ref: Column, a_there: Column, b_there: Column, same_alt: Column) -> Column:
    return (
        F.when(~a_there | ~b_there, "cannot_combine").when(a_is_ref & b_is_ref, "both_reference")
        .when(a_is_ref | b_is_ref, "one_each").when(same_alt, "same_alternate").otherwise("cannot_combine")
    )


def pool_bias(a_support: Column, a_coverage: Column, b_support: Column, b_coverage: Column, noise_q: int = 20, threshold: float = 0.5) -> Column:
    """The strand-bias score with pools as strands: struct (score, scaled within -100..0, biased)."""
    none = F.lit(0).cast("long")
    sb = stats.strand_bias(F.array(a_support, b_support, none), F.array(a_coverage, b_coverage, none), noise_q, threshold)
    return F.struct(sb["score"].alias("score"), F.greatest(F.lit(-100.0), F.least(F.lit(0.0), sb["scaled"])).alias("scaled"), (~sb["acceptable"]).alias("biased"))


def combined_noise(a: Column, b: Column) -> Column:
    """The quality of the mean of two error probabilities."""
    return stats.p_to_q((stats.q_to_p(a) + stats.q_to_p(b)) / 2)


def consensus(pairs: DataFrame, min_frequency: float = 0.01, frequency_filter: float = 0.03, min_depth: int = 10, noise_q: int = 20) -> DataFrame:
    """One call for each pair (a, b): counts added, genotype, quality, filters.

    Rows come from ``paired`` on alleles with ref, alt, dp, ad, rd.
    """
    f = lambda side, name: F.coalesce(F.col(f"{side}.{name}"), F.lit(0).cast("long"))
    there = {s: F.col(s).isNotNull() for s in "ab"}
    is_ref = {s: F.coalesce(F.col(f"{s}.alt") == F.col(f"{s}.ref"), F.lit(False)) for s in "ab"}
    case = comparison(is_ref["a"], is_ref["b"], there["a"], there["b"], F.col("a.alt") == F.col("b.alt"))
    rows = pairs.withColumn("kind", case)
    main = F.when(there["a"] & ~is_ref["a"], F.col("a")).when(there["b"] & ~is_ref["b"], F.col("b")).when(there["a"], F.col("a")).otherwise(F.col("b"))
    alt_ad = {s: F.when(is_ref[s], F.lit(0).cast("long")).otherwise(f(s, "ad")) for s in "ab"}
    dp, ad = f("a", "dp") + f("b", "dp"), alt_ad["a"] + alt_ad["b"]
    rd = f("a", "rd") + f("b", "rd")
    rows = rows.select("chrom", "pos", "kind", main["ref"].alias("ref"), main["alt"].alias("alt"), dp.alias("dp"), ad.alias("ad"), rd.alias("rd"), pool_bias(alt_ad["a"], f("a", "dp"), alt_ad["b"], f("b", "dp"), noise_q).alias("pb"), there["a"].alias("in_a"), there["b"].alias("in_b"), *[(f(s, "dp")).alias(f"dp_{s}") for s in "ab"])
    vf = F.when(F.col("dp") == 0, 0.0).otherwise(F.col("ad") / F.col("dp")).cast("float")
    low, bar = F.lit(min_frequency).cast("float"), F.lit(frequency_filter).cast("float")
    poor = (F.col("dp_a") < min_depth) & (F.col("dp_b") < min_depth)
    sure_ref = F.when(F.col("dp") < min_depth, "./.").otherwise("0/0")
    alt_gt = F.when(vf < low, F.when(poor, "./.").otherwise("0/0")).when(vf < bar, "./.").when(F.col("rd") / F.col("dp") >= low, "0/1").otherwise("1/1")
    rows = rows.withColumns({"vf": vf, "genotype": F.when(F.col("kind") == "both_reference", sure_ref).otherwise(alt_gt)})
    became_ref = F.col("genotype").isin("0/0") | ((F.col("kind") == "both_reference") & (F.col("genotype") == "./."))
    rows = rows.withColumns({"alt": F.when(became_ref, F.lit(".")).otherwise(F.col("alt")), "ref": F.when(became_ref, F.substring("ref", 1, 1)).otherwise(F.col("ref"))})
    support = F.when(F.col("kind") == "both_reference", F.col("rd")).otherwise(F.col("ad"))
    biased = F.col("kind").isin("one_each", "cannot_combine") | ((F.col("kind") == "same_alternate") & F.col("pb.biased"))
    return rows.withColumns({"vq": stats.variant_q(support, F.col("dp"), noise_q), "filters": F.array_compact(F.array(F.when(F.col("dp") < min_depth, "LowDP"), F.when(biased, "PB")))})


def merged_references(consensus_rows: DataFrame) -> DataFrame:
    """One reference row for each locus of several: the greatest bias, the least quality."""
    refs = consensus_rows.filter("alt = '.'").groupBy("chrom", "pos", "ref").agg(F.max("dp").alias("dp"), F.min("vq").alias("vq"), F.max("pb.scaled").alias("pb_scaled"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("filters"))
    return refs.withColumn("alt", F.lit("."))
