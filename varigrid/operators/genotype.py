"""Genotypes per locus under somatic, haploid, diploid and adaptive models."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions import stats

# Starting means and priors of the three allele states.
SNV_MEANS, SNV_PRIORS = (0.037, 0.439, 0.976), (0.755, 0.154, 0.0919)
INDEL_MEANS, INDEL_PRIORS = (0.037, 0.443, 0.905), (0.962, 0.0266, 0.0114)
#: Depth that counts as evidence for each state, and the depth that counts are scaled to.
EFFECTIVE_DEPTH = (25, 25, 10)
MOST_DEPTH = 1000


@dataclass(frozen=True)
class Diploid:
    minor: float = 0.20
    major: float = 0.70
    sum: float = 0.80


def ploidy(chrom: Column, default: str = "diploid", male: bool | None = None) -> Column:
    """Model of a chromosome: somatic for the mitochondrial one, haploid for a male's sex chromosomes."""
    name = F.regexp_replace(F.lower(chrom), "^chr", "")
    sex = F.lit("haploid") if male else F.lit(default)
    return F.when(name.isin("m", "mt"), "somatic").when(name.isin("x", "y"), sex).otherwise(F.lit(default))


def somatic(is_ref: Column, vf: Column, ref_vf: Column, depth: Column, min_depth: int = 10, min_frequency: float = 0.01) -> Column:
    m = F.lit(min_frequency).cast("float")
    of_ref = F.when(vf < m, "./.").when(1 - vf > m, "0/.").otherwise("0/0")
    of_alt = F.when(ref_vf >= m, "0/1").when(1 - vf > m, "1/.").otherwise("1/1")
    return F.when(depth < min_depth, "./.").when(is_ref, of_ref).otherwise(of_alt)


def haploid(is_ref: Column, vf: Column, depth: Column, min_depth: int = 10, major: float = 0.70) -> Column:
    enough = (depth >= min_depth) & (vf > F.lit(major).cast("float"))
    return F.when(~enough, ".").when(is_ref, "0").otherwise("1")


def diploid(loci: DataFrame, model: Diploid = Diploid(), min_depth: int = 10) -> DataFrame:
    """(chrom, pos, genotype, filters, kept): per locus from rows (chrom, pos, ref, alt, vf, ref_vf, dp) of its alternatives.

    ``kept`` lists the alternatives the genotype names, the most frequent first.
    """
    minor, major, total = (F.lit(x).cast("float") for x in (model.minor, model.major, model.sum))
    rows = loci.groupBy("chrom", "pos").agg(
        F.max("dp").alias("dp"), F.max("ref_vf").alias("ref_vf"),
        F.sort_array(F.collect_list(F.when(F.col("vf") >= minor, F.struct((-F.col("vf")).alias("order"), "ref", "alt", "vf")))).alias("alts"),
    )
    n, v = F.size("alts"), lambda i: F.get("alts", F.lit(i))["vf"]
    last = F.get("alts", n - 1)
    snv = (F.length(last["ref"]) == 1) & (F.length(last["alt"]) == 1)
    has_ref = F.col("ref_vf") >= minor
    many = snv & ((has_ref & (v(0) + F.col("ref_vf") < total)) | (v(0) + v(1) < total))
    het = F.when(n == 1, F.when(has_ref, "0/1").otherwise("1/.")).when(many, "./.").when(has_ref, "0/1").otherwise("1/2")
    called = F.when(F.col("dp") < min_depth, "./.").when(n == 0, "0/0").when(v(0) <= major, het).otherwise("1/1")
    rows = rows.withColumn("genotype", called)
    allowed = F.when(F.col("genotype").isin("1/2", "./."), 2).when(F.col("genotype") == "0/0", 0).otherwise(1)
    return rows.select(
        "chrom", "pos", "genotype",
        F.when((n >= 2) & (v(0) <= major) & many, F.array(F.lit("MultiAllelicSite"))).otherwise(F.array().cast("array<string>")).alias("filters"),
        F.transform(F.slice("alts", 1, allowed), lambda a: a["alt"]).alias("kept"),
    )


def scaled_depth(support: Column, depth: Column) -> tuple[Column, Column]:
    """Counts of at most ``MOST_DEPTH`` reads; larger ones keep their ratio, cut off."""
    big = depth > MOST_DEPTH
    return F.when(big, (support / depth * MOST_DEPTH).cast("int")).otherwise(support.cast("int")), F.when(big, MOST_DEPTH).otherwise(depth.cast("int"))


def adaptive(rows: DataFrame, means: tuple = SNV_MEANS, priors: tuple = SNV_PRIORS) -> DataFrame:
    """Adds state (0, 1, 2), genotype and gq to rows (ad, dp) by a binomial mixture.

    The state is the most probable one at the (scaled) depth.  Its quality comes
    from the posterior with each state's evidence limited to its effective depth.
    """
    k, n = scaled_depth(F.col("ad"), F.col("dp"))
    rows = rows.withColumns({"_k": k, "_n": n})
    logs = [stats.log_binomial(F.col("_k"), F.col("_n"), float(m)) + F.log(F.lit(float(p))) for m, p in zip(means, priors, strict=True)]
    rows = rows.withColumn("_logs", F.array(*logs))
    state = (F.array_position("_logs", F.array_max("_logs")) - 1).cast("int")
    rows = rows.withColumn("state", state)
    vf = F.col("_k") / F.greatest(F.col("_n"), F.lit(1))
    limited = []
    for m, p, most in zip(means, priors, EFFECTIVE_DEPTH, strict=True):
        depth = F.least(F.col("_n"), F.lit(most))
        limited.append(F.exp(stats.log_binomial(F.bround(vf * depth).cast("int"), depth, float(m)) + F.log(F.lit(float(p)))))
    rows = rows.withColumn("_weights", F.array(*limited))
    total = F.aggregate("_weights", F.lit(0.0), lambda a, x: a + x)
    own = F.get("_weights", F.col("state"))
    q = F.when(total == own, 100.0).otherwise(F.bround(-10.0 * F.log10((total - own) / total)))
    rows = rows.withColumn("gq", F.least(F.lit(100.0), q).cast("int"))
    genotype = F.when(F.col("dp") < 10, "./.").otherwise(F.get(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.col("state")))
    return rows.withColumn("genotype", genotype).drop("_k", "_n", "_logs", "_weights")


def registry() -> dict:
    """Genotypers by ploidy model; add one to plug it in."""
    return {"somatic": somatic, "haploid": haploid, "diploid": diploid, "adaptive": adaptive}


def pruned(rows: DataFrame, genotype: str = "genotype") -> DataFrame:
    """As many alternatives of a locus as its genotype names, the most frequent first."""
    allowed = F.when(F.col(genotype) == "1/2", 2).when(F.col(genotype).isin("0/0", "0/."), 0).otherwise(1)
    order = Window.partitionBy("chrom", "pos").orderBy(F.desc("vf"), "ref", "alt")
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= allowed).drop("_rank")


def forced_genotypes(calls: DataFrame) -> DataFrame:
    """Calls (chrom, pos, ref, alt, genotype, gq, no_call, forced) of diploid loci with what forced alleles take from the others.

    A forced allele is 0/0 beside a reference call, ./. beside a no-call or nothing, else */*.  At a locus
    with one, all have the least quality of those not forced, 0 without any.
    """
    own = ~F.col("forced")
    locus = calls.groupBy("chrom", "pos").agg(
        F.max("forced").alias("_any"), F.coalesce(F.max(F.when(own, F.col("ref") == F.col("alt"))), F.lit(False)).alias("_ref"),
        F.coalesce(F.max(F.when(own, F.col("no_call"))), F.lit(True)).alias("_none"), F.coalesce(F.min(F.when(own, F.col("gq"))), F.lit(0)).alias("_least"),
    )
    given = F.when(F.col("_none"), "./.").when(F.col("_ref"), "0/0").otherwise("*/*")
    rows = calls.join(locus, ["chrom", "pos"])
    rows = rows.withColumns({"genotype": F.when(F.col("forced"), given).otherwise(F.col("genotype")), "gq": F.when(F.col("_any"), F.col("_least")).otherwise(F.col("gq"))})
    return rows.drop("_any", "_ref", "_none", "_least")


def fitted_or(calls: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """Calls (chrom, pos) with the fitted model's columns where it has the locus, else their own."""
    known = fitted.select("chrom", "pos", *[F.col(c).alias(f"_{c}") for c in columns])
    rows = calls.join(known, ["chrom", "pos"], "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


#: Depth beyond which two alternatives' quality isn't worked out, the most it can be, and the prior of two references.
MOST_TWO_DEPTH, MOST_GQ, REFERENCE_PRIOR = 500, 100.0, 0.99


def two_alternatives(counts: Column, depth: Column, means: tuple = (SNV_MEANS, SNV_MEANS)) -> Column:
    """(gq, posteriors) of a locus with two alternatives, from the reads of [reference, first, second].

    The six states are, by the first alternative's copies under none of the second: 0, 1, 2; under one: 0, 1;
    under two: 0.  Posteriors are qualities.  The depth must be the counts' sum: null otherwise.  Beyond
    ``MOST_TWO_DEPTH`` reads all are the most, that of one copy of each 0.
    """
    logs = []
    for second, first in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)):
        p1, p2 = means[0][first], means[1][second]
        rest = 1 - p1 - p2
        if rest <= 0:
            rest = 1 - p1 if first == 2 else 1 - p2 if second == 2 else 1 - means[0][2]
        prior = REFERENCE_PRIOR if first == second == 0 else (1 - REFERENCE_PRIOR) / 5
        term = F.lit(math.log(prior))
        for i, p in enumerate((rest, p1, p2)):
            term = term + F.get(counts, F.lit(i)) * F.lit(math.log(p))
        logs.append(term)
    q = lambda p: F.when(p < 1e-300, MOST_GQ).otherwise(F.least(F.lit(MOST_GQ), -10 * F.log10(p)))
    fields = [f"s{i}" for i in range(6)]
    summed = lambda x, names: sum((x[n] for n in names), F.lit(0.0))
    # each step reads the one before as a struct, so none is worked out twice
    shares = lambda x: stats.bound(totals, **{n: F.exp(x[n] - x["top"]) for n in fields})
    totals = lambda x: stats.bound(rated, **{n: x[n] for n in fields}, total=summed(x, fields), others=summed(x, [n for n in fields if n != "s4"]))
    rated = lambda x: F.struct(F.bround(q(x["others"] / x["total"])).cast("int").alias("gq"), F.array(*[q(x[n] / x["total"]) for n in fields]).alias("posteriors"))
    worked = stats.bound(lambda x: stats.bound(shares, **{n: x[n] for n in fields}, top=F.greatest(*[x[n] for n in fields])), **dict(zip(fields, logs, strict=True)))
    most = F.struct(F.lit(int(MOST_GQ)).alias("gq"), F.array(*[F.lit(0.0 if i == 4 else MOST_GQ) for i in range(6)]).alias("posteriors"))
    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x) == depth
    return F.when(depth > MOST_TWO_DEPTH, most).when(whole, worked)
