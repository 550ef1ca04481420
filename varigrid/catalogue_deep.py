"""Statistics at depths from ten to a million reads, each with its SQL.

A part gives a locus: its depth, the reads that carry an allele, some deviations
from what noise of quality 20 would give, and the same by strand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from varigrid.catalogue import query
from varigrid.functions import stats

DEEP_SQL = """
SELECT pos, depth, support, depth // 2 AS fc, depth - depth // 2 AS rc, support // 2 + (support - support // 2) * (pos % 2) AS fs, (support - support // 2) * (1 - pos % 2) AS rs
FROM (SELECT pos, depth, CAST(greatest(0, floor(depth * 0.01::DOUBLE + z * sqrt(depth * 0.01::DOUBLE))) AS BIGINT) AS support
      FROM (SELECT p_partkey AS pos, CAST(10 + (p_partkey * 7919) % 1000000 AS BIGINT) AS depth, CAST(p_size % 13 - 6 AS DOUBLE) AS z FROM part) a) b"""


def deep_loci(spark, sf_dir):
    """(pos, depth, support, fc, rc, fs, rs) as in DEEP_SQL."""
    c = F.col
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(c("p_partkey").alias("pos"), (10 + (c("p_partkey") * 7919) % 1000000).cast("long").alias("depth"), (c("p_size") % 13 - 6).cast("double").alias("z"))
    noise = c("depth") * F.lit(0.01)
    rows = rows.select("pos", "depth", F.greatest(F.lit(0), F.floor(noise + c("z") * F.sqrt(noise))).cast("long").alias("support"))
    half = F.expr("support div 2")
    fs = half + (c("support") - half) * (c("pos") % 2)
    return rows.select("*", F.expr("depth div 2").alias("fc"), F.expr("depth - depth div 2").alias("rc"), fs.alias("fs"), (c("support") - fs).alias("rs"))


def terms_sql(low: str, high: str, mean: str) -> str:
    """Sum of Poisson terms, in log space, of what lies within sixty deviations of the mean."""
    first = f"CAST(greatest({low}, floor({mean} - 60 * sqrt({mean}) - 60), 0) AS BIGINT)"
    last = f"CAST(least({high}, ceil({mean} + 60 * sqrt({mean}) + 60)) AS BIGINT)"
    return f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda i: exp(i * ln({mean}) - {mean} - lgamma(i + 1)))), 0.0)"


def cdf_sql(k: str, mean: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN 0.0 ELSE least(1.0, {terms_sql('0', f'trunc({k})', mean)}) END)"


NOISE = "(depth * 0.01::DOUBLE)"


@query(f"""SELECT pos, depth, support, round({cdf_sql('support', NOISE)}, 4) AS cdf,
  CASE WHEN support <= 0 THEN 0 ELSE CAST(round_even(greatest(0.0, least(100.0, -10 * log10(greatest(1e-300, least(1.0, {terms_sql('support', 'depth', NOISE)}))))), 0) AS INTEGER) END AS vq
FROM ({DEEP_SQL}) d""")
def deep_variant_quality(spark, sf_dir):
    """Poisson probabilities and variant qualities, at a cost that the depth doesn't change."""
    s, d = F.col("support"), F.col("depth")
    return deep_loci(spark, sf_dir).select("pos", "depth", "support", F.round(stats.poisson_cdf(s, d * F.lit(0.01)), 4).alias("cdf"), stats.variant_q(s, d).alias("vq"))


def _real(s: str, c: str) -> str:
    return f"(CASE WHEN {s} = 0 THEN power(0.99::DOUBLE, {c}) ELSE {cdf_sql(f'({s} - 1)', f'({c} * 0.01::DOUBLE)')} END)"


@query(f"""SELECT pos, round(score, 4) AS score, fs > 0 AND rs > 0 AS both, score < 0.5 AS acceptable FROM (
  SELECT *, CASE WHEN fc = 0 OR rc = 0 THEN 0.0 WHEN o = 0 THEN 1.0 ELSE greatest(f * (1 - r), r * (1 - f)) / o END AS score FROM (
    SELECT *, {_real('fs', 'fc')} AS f, {_real('rs', 'rc')} AS r, {_real('support', 'depth')} AS o FROM ({DEEP_SQL}) d) e WHERE o = 0 OR o > 1e-6) g""")
def deep_strand_bias(spark, sf_dir):
    """Strand bias; loci whose reads are all but surely noise are left out, as their score is a ratio of two nothings."""
    c = F.col
    whole = stats.poisson_cdf(c("support") - 1, c("depth") * F.lit(0.01))
    kept = deep_loci(spark, sf_dir).withColumn("o", F.when(c("support") == 0, F.pow(F.lit(0.99), c("depth"))).otherwise(whole)).filter("o = 0 OR o > 1e-6")
    sb = stats.strand_bias(F.array("fs", "rs", F.lit(0).cast("long")), F.array("fc", "rc", F.lit(0).cast("long")))
    return kept.select("pos", sb.alias("sb")).select("pos", F.round("sb.score", 4).alias("score"), "sb.both", "sb.acceptable")


TOP = "(0.011::DOUBLE * depth)"


@query(f"""SELECT pos, CASE WHEN {TOP} < 5 OR {TOP} <= support THEN false ELSE {cdf_sql('support', TOP)} < 0.01 END AS biased,
  CASE WHEN seen >= depth * 0.012::DOUBLE THEN 0 ELSE CAST(round_even(greatest(0.0, least(100.0, -10 * log10(power(10.0, -10.0) + {cdf_sql('seen', '(depth * 0.012::DOUBLE)')}))), 0) AS INTEGER) END AS gq
FROM (SELECT *, (1.0::DOUBLE - (1.0::DOUBLE - support / depth)) * depth AS seen FROM ({DEEP_SQL}) d) e""")
def deep_genotype_quality(spark, sf_dir):
    """Amplicon bias against a fellow's 1.1 percent, and the quality of homozygous calls against which ``support`` reads speak."""
    s, d = F.col("support"), F.col("depth")
    biased = stats.amplicon_biased(s, s / d, d, F.lit(0.011))
    return deep_loci(spark, sf_dir).select("pos", biased.alias("biased"), stats.somatic_gq(F.lit(100), 1.0 - s / d, d, F.lit(True), 0.012).alias("gq"))


def binomial_terms_sql(k: str, n: str, p: float) -> str:
    spread = f"(60 * sqrt({n} * {p * (1 - p)!r}::DOUBLE) + 60)"
    first, last = f"CAST(greatest(0, floor({n} * {p!r} - {spread})) AS BIGINT)", f"CAST(least({k}, {n}) AS BIGINT)"
    ways = f"lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1)"
    return f"coalesce(list_sum(list_transform(range({first}, {last} + 1), lambda i: exp({ways} + i * ln({p!r}::DOUBLE) + ({n} - i) * ln(1 - {p!r}::DOUBLE)))), 0.0)"


@query(f"""SELECT pos, k, round(least(1.0, {binomial_terms_sql('k', 'depth', 0.01)}), 4) AS cdf,
  round((lgamma(depth + 1) - lgamma(k + 1) - lgamma(depth - k + 1) + k * ln(0.4::DOUBLE) + (depth - k) * ln(0.6::DOUBLE)) / depth, 6) AS log_share
FROM (SELECT pos, depth, support AS k FROM ({DEEP_SQL}) d) e""")
def deep_binomial(spark, sf_dir):
    """Binomial probabilities by the incomplete beta function, and log probabilities by Stirling's series."""
    k, d = F.col("k"), F.col("depth")
    rows = deep_loci(spark, sf_dir).withColumnRenamed("support", "k")
    return rows.select("pos", "k", F.round(stats.binomial_cdf(k, d, 0.01), 4).alias("cdf"), F.round(stats.log_binomial(k, d, 0.4) / d, 6).alias("log_share"))
