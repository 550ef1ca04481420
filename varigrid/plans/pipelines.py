"""Whole programs as chains of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.functions import stats
from varigrid.operators import calling, clustering, genotype, intervals, mixture, phasing, pileup, pools, recalibrate


def call_somatic(obs: DataFrame, options: calling.CallOptions = calling.CallOptions(), reference: DataFrame | None = None, biased: DataFrame | None = None) -> DataFrame:
    """Base observations to genotyped, filtered somatic calls, one row an allele.

    With a ``reference`` (contig, start, bases) repeats are filters too, and with ``biased``
    (chrom, pos, biased) amplicons are.
    """
    rows = calling.scored(pileup.alleles(obs), options)
    ref_vf = calling.frequency(F.col("rd"), F.col("dp"))
    gt = genotype.somatic(F.lit(False), F.col("vf"), ref_vf, F.col("dp"), options.min_depth, options.min_frequency)
    rows = rows.withColumns({"filters": calling.filters(options), "genotype": gt})
    gq = stats.somatic_gq(F.col("vq"), F.col("vf").cast("double"), F.col("dp"), F.col("genotype").isin("1/1", "1/.", "0/0"), options.min_frequency)
    rows = rows.withColumn("gq", gq)
    return rows if reference is None else calling.with_context_tags(rows, reference, options, biased)


def compare_pools(obs: DataFrame) -> DataFrame:
    """Consensus of the two pools of base observations (pool 0 and 1)."""
    a, b = (pileup.alleles(obs.filter(F.col("pool") == p)).filter("ad > 0") for p in (0, 1))
    return pools.consensus(pools.paired(a, b))


def recalibrate_quality(calls: DataFrame) -> DataFrame:
    """Calls with qualities that a suspicious mutation spectrum leaves them."""
    loci = calls.count()
    return recalibrate.requalified(calls, recalibrate.suspicious(recalibrate.spectrum(calls), F.lit(loci)))


def adaptive_genotypes(calls: DataFrame) -> DataFrame:
    """Calls genotyped by a mixture that is fitted to them."""
    model = mixture.fit(mixture.training_rows(calls))
    return genotype.adaptive(calls, model.means, model.priors)


def roi_filter(calls: DataFrame, regions: DataFrame, expanded: bool = False) -> DataFrame:
    return (intervals.inside_expanded if expanded else intervals.inside)(calls, regions)


def phase(obs_at_sites: DataFrame, sites: DataFrame, reference: DataFrame, most: int | None = None) -> DataFrame:
    """Alleles of neighbouring sites from the reads' states at them, called anew; ``reference`` (chrom, pos, base) fills the gaps."""
    found = clustering.clusters(phasing.signatures(phasing.site_states(obs_at_sites)), most)
    return clustering.recalled(clustering.phased_alleles(found, sites, reference)[0])
