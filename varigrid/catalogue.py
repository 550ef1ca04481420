"""The named queries of the variant operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.functions import letters, records, sequence, stats
from varigrid.operators import calling, candidates, clustering, genotype, intervals, mixture, pairs, phasing, pileup, pools, realign, recalibrate
from varigrid.plans import pipelines, views
from varigrid.plans.views import ALLELES_SQL, INTERVALS_SQL, OBS_SQL
from varigrid.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# -- SQL of the formulas -------------------------------------------------------


def poisson_sql(k: str, mean: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(0, CAST(trunc({k}) AS BIGINT) + 1), lambda i: exp(i * ln({mean}) - {mean} - lgamma(i + 1))))) END)"


def variant_q_sql(ad: str, dp: str, q: float = 20) -> str:
    mean = f"({dp} * {10 ** (-q / 10)!r}::DOUBLE)"
    return f"(CASE WHEN {ad} <= 0 OR {dp} <= 0 THEN 0 ELSE CAST(round_even(greatest(0.0, least(100.0, -10 * log10(greatest(1e-300, 1 - {poisson_sql(f'{ad} - 1', mean)})))), 0) AS INTEGER) END)"


def vf_sql(ad: str, dp: str) -> str:
    return f"CAST(CASE WHEN {dp} = 0 THEN 0.0 ELSE least({ad}::DOUBLE / {dp}::DOUBLE, 1.0) END AS FLOAT)"


def binomial_sql(k: str, n: str, p: float) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}::DOUBLE) + ({n} - {k}) * ln(1 - {p}::DOUBLE))"


BY_DIR = ", ".join(f"sum(CASE WHEN base = alt AND dir = {d} THEN 1 ELSE 0 END) AS a{d}, sum(CASE WHEN base <> 'N' AND dir = {d} THEN 1 ELSE 0 END) AS d{d}" for d in range(3))
STRAND_SQL = f"""
SELECT *, a0 + a2 // 2 AS fs, a1 + a2 // 2 AS rs, d0 + d2 // 2 AS fc, d1 + d2 // 2 AS rc FROM (
  SELECT chrom, pos, ref, alt, sum(CASE WHEN base <> 'N' THEN 1 ELSE 0 END) AS dp, sum(CASE WHEN base = alt THEN 1 ELSE 0 END) AS ad,
         sum(CASE WHEN base = ref THEN 1 ELSE 0 END) AS rd, sum(CASE WHEN base = 'N' THEN 1 ELSE 0 END) AS nc, {BY_DIR}
  FROM ({OBS_SQL}) o GROUP BY chrom, pos, ref, alt) x"""


def real_sql(s: str, c: str) -> str:
    return f"(CASE WHEN {s} = 0 THEN power(0.99::DOUBLE, {c}) ELSE greatest(0.0, {poisson_sql(f'{s} - 1', f'({c} * 0.01::DOUBLE)')}) END)"


def none_sql(s: str, c: str) -> str:
    return f"(1.0 - {real_sql(s, c)})"


BIAS_SQL = f"""
SELECT *, CASE WHEN fc = 0 OR rc = 0 THEN 0.0 WHEN o = 0 THEN 1.0 ELSE greatest(f * (1 - r), r * (1 - f)) / o END AS score FROM (
  SELECT *, {real_sql('fs', 'fc')} AS f, {real_sql('rs', 'rc')} AS r, {real_sql('ad', 'dp')} AS o FROM ({STRAND_SQL}) s) z"""

CALLS_SQL = f"""
SELECT *, {variant_q_sql('ad', 'dp')} AS vq, {vf_sql('ad', 'dp')} AS vf, {vf_sql('rd', 'dp')} AS ref_vf,
       CAST(CASE WHEN nc + dp = 0 THEN 0.0 ELSE nc::DOUBLE / (nc + dp)::DOUBLE END AS FLOAT) AS ncf FROM ({BIAS_SQL}) b"""


def alleles(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return pileup.alleles(views.obs(spark, sf_dir), *by)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calling.scored(alleles(spark, sf_dir))


def joined(filters: str) -> F.Column:
    return F.array_join(filters, ";")


# -- counts --------------------------------------------------------------------


@query(f"SELECT chrom, pos, base, dir, count(*) AS n FROM ({OBS_SQL}) o GROUP BY chrom, pos, base, dir")
def pileup_counts(spark, sf_dir):
    return pileup.base_counts(views.obs(spark, sf_dir))


@query(f"SELECT chrom, pos, base, round(sum(power(10.0::DOUBLE, -q / 10.0::DOUBLE)), 6) AS errors, count(*) AS n FROM ({OBS_SQL}) o GROUP BY chrom, pos, base")
def base_error_sum(spark, sf_dir):
    return pileup.base_errors(views.obs(spark, sf_dir)).withColumn("errors", F.round("errors", 6))


@query(f"""SELECT chrom, pos, base, count(*) AS n, sum(CASE WHEN kind BETWEEN 2 AND 8 THEN 1 ELSE 0 END)::BIGINT AS anchored FROM (
  SELECT *, CASE WHEN l >= r THEN (CASE WHEN r >= 5 THEN 5 ELSE 10 - r END) WHEN l >= 5 THEN 5 ELSE l END AS kind
  FROM (SELECT *, amplicon AS l, 7 - amplicon AS r FROM ({OBS_SQL}) o) a) b GROUP BY chrom, pos, base""")
def anchor_counts(spark, sf_dir):
    return pileup.anchored_counts(views.obs(spark, sf_dir), F.col("amplicon"), 7 - F.col("amplicon"), 2, 8)


@query(f"SELECT chrom, pos, ref, alt, dp::BIGINT AS dp, ad::BIGINT AS ad, rd::BIGINT AS rd, nc::BIGINT AS nc, {vf_sql('ad', 'dp')} AS vf FROM ({ALLELES_SQL}) a")
def snv_alleles(spark, sf_dir):
    return alleles(spark, sf_dir).select("chrom", "pos", "ref", "alt", "dp", "ad", "rd", "nc", calling.frequency(F.col("ad"), F.col("dp")).alias("vf"))


@query(f"SELECT chrom, pos, {variant_q_sql('ad', 'dp')} AS vq FROM ({ALLELES_SQL}) a")
def variant_qscore(spark, sf_dir):
    return alleles(spark, sf_dir).select("chrom", "pos", stats.variant_q(F.col("ad"), F.col("dp")).alias("vq"))


@query(f"SELECT chrom, pos, round(score, 6) AS score, fs > 0 AND rs > 0 AS both, score < 0.5 AS acceptable FROM ({BIAS_SQL}) b")
def strand_bias(spark, sf_dir):
    sb = stats.strand_bias(F.col("ad_by_dir"), F.col("dp_by_dir"))
    return alleles(spark, sf_dir).select("chrom", "pos", sb.alias("sb")).select("chrom", "pos", F.round("sb.score", 6).alias("score"), "sb.both", "sb.acceptable")


@query(f"""SELECT chrom, pos, count(*) AS amplicons, count(*) >= 2 AND bool_or(biased) AS biased FROM (
  SELECT *, CASE WHEN top * coverage < 5 OR top * coverage <= support OR vf > 0.1 THEN false ELSE {poisson_sql('support', '(top * coverage)')} < 0.01 END AS biased FROM (
    SELECT *, max(vf) OVER (PARTITION BY chrom, pos) AS top FROM (
      SELECT chrom, pos, amplicon, count(*) AS coverage, sum(CASE WHEN base = alt THEN 1 ELSE 0 END) AS support,
             sum(CASE WHEN base = alt THEN 1 ELSE 0 END)::DOUBLE / count(*)::DOUBLE AS vf
      FROM ({OBS_SQL}) o WHERE base <> 'N' GROUP BY chrom, pos, amplicon) a) b) c GROUP BY chrom, pos""")
def amplicon_bias(spark, sf_dir):
    counts = pileup.amplicon_counts(views.obs(spark, sf_dir)).withColumn("vf", F.col("support") / F.col("coverage"))
    top = counts.withColumn("top", F.max("vf").over(Window.partitionBy("chrom", "pos")))
    biased = top.withColumn("biased", stats.amplicon_biased(F.col("support"), F.col("vf"), F.col("coverage"), F.col("top")))
    return biased.groupBy("chrom", "pos").agg(F.count("*").alias("amplicons"), ((F.count("*") >= 2) & F.bool_or("biased")).alias("biased"))


# -- calls ---------------------------------------------------------------------

FILTERS_SQL = """array_to_string(list_filter([CASE WHEN dp < 10 THEN 'LowDP' END, CASE WHEN vq < 30 AND dp <> 0 THEN 'q30' END,
  CASE WHEN ncf > 0.6::FLOAT THEN 'NC' END, CASE WHEN NOT score < 0.5 THEN 'SB' END], lambda x: x IS NOT NULL), ';')"""


@query(f"SELECT chrom, pos, ref, alt, {FILTERS_SQL} AS filters FROM ({CALLS_SQL}) c")
def allele_filters(spark, sf_dir):
    return calls(spark, sf_dir).select("chrom", "pos", "ref", "alt", joined(calling.filters()).alias("filters"))


SOMATIC_SQL = "CASE WHEN dp < 10 THEN './.' WHEN ref_vf >= 0.01::FLOAT THEN '0/1' WHEN 1 - vf > 0.01::FLOAT THEN '1/.' ELSE '1/1' END"


@query(f"""SELECT chrom, pos, ref, alt, dp::BIGINT AS dp, ad::BIGINT AS ad, vf, vq, genotype, filters,
  CASE WHEN genotype NOT IN ('1/1', '1/.', '0/0') THEN vq WHEN (1 - vf::DOUBLE) * dp >= 0.01 * dp THEN 0
       ELSE CAST(round_even(greatest(0.0, least(100.0, -10 * log10(power(10.0::DOUBLE, -vq / 10.0::DOUBLE) + {poisson_sql('((1 - vf::DOUBLE) * dp)', '(0.01::DOUBLE * dp)')}))), 0) AS INTEGER) END AS gq
FROM (SELECT *, {SOMATIC_SQL} AS genotype, {FILTERS_SQL} AS filters FROM ({CALLS_SQL}) c) d""")
def somatic_calls(spark, sf_dir):
    rows = pipelines.call_somatic(views.obs(spark, sf_dir))
    return rows.select("chrom", "pos", "ref", "alt", "dp", "ad", "vf", "vq", "genotype", joined("filters").alias("filters"), "gq")


HAPLOID_SQL = "CASE WHEN dp < 10 OR NOT vf > 0.7::FLOAT THEN '.' ELSE '1' END"


@query(f"SELECT chrom, pos, {HAPLOID_SQL} AS genotype FROM ({CALLS_SQL}) c")
def haploid_genotype(spark, sf_dir):
    return calls(spark, sf_dir).select("chrom", "pos", genotype.haploid(F.lit(False), F.col("vf"), F.col("dp")).alias("genotype"))


DIPLOID_SQL = f"""SELECT *, CASE WHEN dp < 10 THEN './.' WHEN vf < 0.2::FLOAT THEN '0/0' WHEN vf <= 0.7::FLOAT THEN (CASE WHEN ref_vf >= 0.2::FLOAT THEN '0/1' ELSE '1/.' END) ELSE '1/1' END AS genotype
FROM ({CALLS_SQL}) c"""


@query(f"SELECT chrom, pos, genotype, CASE WHEN genotype IN ('0/0') THEN '' ELSE alt END AS kept FROM ({DIPLOID_SQL}) d WHERE genotype <> './.'")
def diploid_genotype(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("ref_vf", calling.frequency(F.col("rd"), F.col("dp")))
    return genotype.diploid(rows).filter("genotype <> './.'").select("chrom", "pos", "genotype", F.array_join("kept", ",").alias("kept"))


@query(f"""SELECT chrom, pos, genotype, CAST(greatest(0, least(100, floor(10.0 / ln(10.0::DOUBLE) * CASE genotype
   WHEN '0/0' THEN (n * ln(0.05::DOUBLE * dp) - 0.05::DOUBLE * dp - lgamma(n + 1)) - {binomial_sql('n', 'dp', 0.4)}
   WHEN '1/1' THEN (n * ln(0.075::DOUBLE * dp) - 0.075::DOUBLE * dp - lgamma(n + 1)) - {binomial_sql('ad', 'dp', 0.4)}
   ELSE {binomial_sql('k', 'dp', 0.4)} - (CASE WHEN vf >= 0.5 THEN {binomial_sql('k', 'dp', 0.9)} ELSE {binomial_sql('k', 'dp', 0.1)} END) END))) AS INTEGER) AS gq
FROM (SELECT *, dp - ad AS n, CAST(trunc(dp::DOUBLE * vf) AS BIGINT) AS k FROM ({DIPLOID_SQL}) d) e""")
def diploid_gq(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("ref_vf", calling.frequency(F.col("rd"), F.col("dp")))
    gt = genotype.diploid(rows).select("chrom", "pos", "genotype")
    return rows.join(gt, ["chrom", "pos"]).select("chrom", "pos", "genotype", stats.diploid_gq(F.col("genotype"), F.col("ad"), F.col("dp"), F.col("vf")).alias("gq"))


def _adaptive_sql() -> str:
    logs = [f"({binomial_sql('ad', 'dp', m)} + ln({p}::DOUBLE))" for m, p in zip(genotype.SNV_MEANS, genotype.SNV_PRIORS, strict=True)]
    return f"""SELECT chrom, pos, state, CASE WHEN dp < 10 THEN './.' WHEN state = 0 THEN '0/0' WHEN state = 1 THEN '0/1' ELSE '1/1' END AS genotype
FROM (SELECT *, CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS state
      FROM (SELECT *, {', '.join(f'{x} AS l{i}' for i, x in enumerate(logs))} FROM ({ALLELES_SQL}) a) b) c"""


@query(_adaptive_sql())
def adaptive_genotype(spark, sf_dir):
    return genotype.adaptive(alleles(spark, sf_dir)).select("chrom", "pos", "state", "genotype")


@query()
def adaptive_quality(spark, sf_dir):
    return pipelines.adaptive_genotypes(calls(spark, sf_dir).withColumn("chrom", F.concat(F.lit("chr1"), "chrom"))).select("chrom", "pos", "state", "genotype", "gq")


@query()
def mixture_fit(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("chrom", F.concat(F.lit("chr1"), "chrom"))
    model = mixture.fit(mixture.training_rows(rows))
    found = [(i, round(m, 6), round(p, 6)) for i, (m, p) in enumerate(zip(model.means, model.priors, strict=True))]
    return spark.createDataFrame(found, "state int, mean double, prior double")


@query(f"SELECT chrom, pos, alt, 1 AS rank FROM ({ALLELES_SQL}) a WHERE dp > 0 AND ad > 0")
def top_two_alleles(spark, sf_dir):
    rows = calls(spark, sf_dir).filter("dp > 0 and ad > 0")
    return calling.top_two(rows).select("chrom", "pos", "alt", "rank")


@query(f"SELECT chrom, pos // 3 AS pos, alt, CAST(row_number() OVER (PARTITION BY chrom, pos // 3 ORDER BY vf DESC, ref, alt) AS INTEGER) AS phase_set FROM ({CALLS_SQL}) c WHERE ad > 0")
def phase_sets(spark, sf_dir):
    rows = calls(spark, sf_dir).filter("ad > 0").withColumn("pos", F.expr("pos div 3"))
    return calling.phase_sets(rows).select("chrom", "pos", "alt", F.col("phase_set").cast("int").alias("phase_set"))


# -- intervals -----------------------------------------------------------------


@query(f"SELECT chrom, pos, ad::BIGINT AS ad FROM ({ALLELES_SQL}) a WHERE EXISTS (SELECT 1 FROM ({INTERVALS_SQL}) i WHERE a.pos BETWEEN i.start AND i.stop)")
def roi_filter(spark, sf_dir):
    return pipelines.roi_filter(alleles(spark, sf_dir), views.intervals(spark, sf_dir)).select("chrom", "pos", "ad")


MERGED_SQL = f"""SELECT min(start) AS start, max(stop) AS stop FROM (
  SELECT *, sum(opened) OVER (ORDER BY start, stop, id) AS run FROM (
    SELECT *, CASE WHEN max(stop) OVER (ORDER BY start, stop, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS opened
    FROM ({INTERVALS_SQL}) i) a) b GROUP BY run"""


@query(MERGED_SQL)
def interval_union(spark, sf_dir):
    return intervals.merged(views.intervals(spark, sf_dir))


@query(f"""SELECT DISTINCT p.pos FROM (SELECT unnest(generate_series(start, stop)) AS pos FROM ({INTERVALS_SQL}) i WHERE id % 2 = 0) p
WHERE NOT EXISTS (SELECT 1 FROM ({INTERVALS_SQL}) x WHERE x.id % 2 = 1 AND p.pos BETWEEN x.start AND x.stop)""")
def interval_minus(spark, sf_dir):
    every = views.intervals(spark, sf_dir)
    left = intervals.minus(every.filter("id % 2 = 0"), every.filter("id % 2 = 1"))
    return left.select(F.explode(F.sequence("start", "stop")).alias("pos"))


@query(f"""SELECT id, b AS block, greatest(start, b * 10 + 1) AS start, least(stop, (b + 1) * 10) AS stop
FROM (SELECT *, unnest(generate_series((start - 1) // 10, (stop - 1) // 10)) AS b FROM ({INTERVALS_SQL}) i) x""")
def interval_clip(spark, sf_dir):
    return intervals.clipped(views.intervals(spark, sf_dir), 10)


@query(f"""SELECT DISTINCT c.chrom, p.pos FROM (SELECT unnest(generate_series(start, stop)) AS pos FROM ({INTERVALS_SQL}) i) p, (SELECT DISTINCT l_returnflag AS chrom FROM lineitem) c
WHERE NOT EXISTS (SELECT 1 FROM ({ALLELES_SQL}) a WHERE a.chrom = c.chrom AND a.pos = p.pos AND a.pos % 3 <> 0)""")
def gap_padding(spark, sf_dir):
    rows = alleles(spark, sf_dir)
    chroms = views.lines(spark, sf_dir).select(F.col("l_returnflag").alias("chrom")).distinct()
    regions = chroms.crossJoin(F.broadcast(views.intervals(spark, sf_dir).select("start", "stop")))
    return intervals.uncovered(rows.filter("pos % 3 <> 0"), regions, ["chrom"])


@query(f"""SELECT a.id AS id_a, b.id AS id_b FROM ({INTERVALS_SQL}) a, ({INTERVALS_SQL}) b WHERE a.id < b.id AND a.start <= b.stop AND b.start <= a.stop""")
def interval_overlaps(spark, sf_dir):
    every = views.intervals(spark, sf_dir)
    return intervals.overlapping(every, every, bin_width=50).filter("a.id < b.id").select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


@query()
def roi_expanded(spark, sf_dir):
    rows = alleles(spark, sf_dir).withColumn("ref", F.repeat("ref", (F.col("pos") % 4 + 1).cast("int")))
    return pipelines.roi_filter(rows, views.intervals(spark, sf_dir), expanded=True).select("chrom", "pos", "ref")


# -- two pools -----------------------------------------------------------------

POOL_SQL = ALLELES_SQL.replace("GROUP BY chrom", "WHERE pool = {pool} GROUP BY chrom")


def pool_sql(pool: int) -> str:
    extra = " AND pos % 7 <> 0" if pool else ""
    return f"SELECT * FROM ({POOL_SQL.format(pool=pool)}) p WHERE ad > 0{extra}"


def two_pools(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    obs = views.obs(spark, sf_dir)
    a, b = (pileup.alleles(obs.filter(F.col("pool") == p)).filter("ad > 0") for p in (0, 1))
    return a, b.filter("pos % 7 <> 0")


def _venn(kind: str) -> Query:
    def run(spark, sf_dir):
        return pools.venn(*two_pools(spark, sf_dir))[kind].select("chrom", "pos", "ref", "alt", "ad")

    run.__name__ = f"venn_{kind}"
    return run


for _kind, _left, _right, _not in (("a_and_b", 0, 1, ""), ("b_and_a", 1, 0, ""), ("a_not_b", 0, 1, "NOT"), ("b_not_a", 1, 0, "NOT")):
    query(f"SELECT chrom, pos, ref, alt, ad::BIGINT AS ad FROM ({pool_sql(_left)}) x WHERE {_not} EXISTS (SELECT 1 FROM ({pool_sql(_right)}) y WHERE x.chrom = y.chrom AND x.pos = y.pos AND x.ref = y.ref AND x.alt = y.alt)")(_venn(_kind))


@query(f"""SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, a.ad::BIGINT AS ad_a, b.ad::BIGINT AS ad_b
FROM ({pool_sql(0)}) a FULL OUTER JOIN ({pool_sql(1)}) b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt""")
def venn_pairs(spark, sf_dir):
    return pools.paired(*two_pools(spark, sf_dir)).select("chrom", "pos", F.col("a.ad").alias("ad_a"), F.col("b.ad").alias("ad_b"))


def _consensus_sql() -> str:
    vf = vf_sql("ad", "dp")
    return f"""
SELECT chrom, pos, kind, dp::BIGINT AS dp, ad::BIGINT AS ad, genotype, CASE WHEN genotype = '0/0' THEN '.' ELSE alt END AS alt, {variant_q_sql('ad', 'dp')} AS vq FROM (
  SELECT *, CASE WHEN vf < 0.01::FLOAT THEN (CASE WHEN dp_a < 10 AND dp_b < 10 THEN './.' ELSE '0/0' END) WHEN vf < 0.03::FLOAT THEN './.'
                 WHEN rd::DOUBLE / dp::DOUBLE >= 0.01::FLOAT THEN '0/1' ELSE '1/1' END AS genotype FROM (
    SELECT *, {vf} AS vf FROM (
      SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.alt, b.alt) AS alt,
             CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN 'cannot_combine' ELSE 'same_alternate' END AS kind,
             coalesce(a.dp, 0) AS dp_a, coalesce(b.dp, 0) AS dp_b, coalesce(a.dp, 0) + coalesce(b.dp, 0) AS dp,
             coalesce(a.ad, 0) + coalesce(b.ad, 0) AS ad, coalesce(a.rd, 0) + coalesce(b.rd, 0) AS rd
      FROM ({pool_sql(0)}) a FULL OUTER JOIN ({pool_sql(1)}) b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt) p) q) r"""


@query(_consensus_sql())
def consensus_calls(spark, sf_dir):
    return pools.consensus(pools.paired(*two_pools(spark, sf_dir))).select("chrom", "pos", "kind", "dp", "ad", "genotype", "alt", "vq")


# -- recalibration -------------------------------------------------------------

SPECTRUM_SQL = f"SELECT ref || '>' || alt AS category, count(*) AS n FROM ({ALLELES_SQL}) a WHERE ad > 0 GROUP BY ref, alt"
CLASSES_SQL = "(VALUES " + ", ".join(f"('{c}')" for c in recalibrate.CLASSES) + ") v(category)"
OUTLIERS_SQL = f"""
WITH every AS (SELECT v.category, coalesce(s.n, 0) AS n FROM {CLASSES_SQL} LEFT JOIN ({SPECTRUM_SQL}) s ON v.category = s.category),
ranked AS (SELECT *, row_number() OVER (ORDER BY n, category) AS r FROM every),
cut AS (SELECT avg(n) + 2.0 * sqrt(var_pop(n)) AS cutoff FROM ranked WHERE r BETWEEN 3 AND 10)
SELECT category, CAST(n AS BIGINT) AS n, round(cutoff, 6) AS cutoff, n > cutoff AS suspicious, CAST(trunc(-10 * log10(n::DOUBLE / (SELECT count(*) FROM ({ALLELES_SQL}) l)::DOUBLE + 0.01::DOUBLE)) AS INTEGER) AS rate_q
FROM every, cut"""


@query(SPECTRUM_SQL)
def mutation_spectrum(spark, sf_dir):
    return recalibrate.spectrum(alleles(spark, sf_dir).filter("ad > 0"))


def _suspects(spark, sf_dir) -> DataFrame:
    rows = alleles(spark, sf_dir)
    return recalibrate.suspicious(recalibrate.spectrum(rows.filter("ad > 0")), F.lit(rows.count()))


@query(OUTLIERS_SQL)
def spectrum_outliers(spark, sf_dir):
    return _suspects(spark, sf_dir).withColumn("cutoff", F.round("cutoff", 6)).select("category", F.col("n").cast("long").alias("n"), "cutoff", "suspicious", "rate_q")


@query()
def recalibrated_q(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("filters", calling.filters())
    # half the mean stands for the cut-off, so that some classes are suspicious on any data
    suspects = _suspects(spark, sf_dir).withColumn("suspicious", F.col("n") > F.col("cutoff") / 2)
    return recalibrate.requalified(rows, suspects).select("chrom", "pos", "vq", "new_q", joined("new_filters").alias("filters"))


def _edges_sql(extent: int = 4) -> str:
    risk = []
    for k in range(1, extent + 1):
        lag_p, lag_d, lead_p, lead_d = (f"{f}({c}, {k}) OVER (PARTITION BY chrom ORDER BY pos)" for f, c in (("lag", "pos"), ("lag", "dp"), ("lead", "pos"), ("lead", "dp")))
        risk += [f"{lag_p} IS NULL OR pos - {lag_p} > {k} OR {lag_d} < 0.5 * dp", f"{lead_p} IS NULL OR {lead_p} - pos > {k} OR {lead_d} < 0.5 * dp"]
    return f"SELECT chrom, pos, CASE WHEN dp = 0 THEN false ELSE coalesce({' OR '.join(f'({r})' for r in risk)}, false) END AS edge FROM ({ALLELES_SQL}) a WHERE pos % 11 <> 0"


@query(_edges_sql())
def amplicon_edges(spark, sf_dir):
    return recalibrate.edges(alleles(spark, sf_dir).filter("pos % 11 <> 0")).select("chrom", "pos", "edge")


@query(f"""WITH loci AS (SELECT l.*, e.edge FROM ({ALLELES_SQL}) l JOIN ({_edges_sql()}) e ON l.chrom = e.chrom AND l.pos = e.pos), t AS (SELECT count(*) AS loci, count(*) FILTER (WHERE edge) AS edge_loci, count(*) FILTER (WHERE ad > 0) AS all_n, count(*) FILTER (WHERE edge AND ad > 0) AS edge_n FROM loci),
r AS (SELECT *, (edge_n - (all_n - edge_n)::DOUBLE / nullif(loci - edge_loci, 0) * edge_loci) / edge_n AS risk FROM t)
SELECT ref || '>' || alt AS category, count(*) AS n, CASE WHEN risk > 0 THEN CAST(trunc(-10 * log10(count(*)::DOUBLE / edge_n * risk)) AS INTEGER) END AS rate_q FROM loci, r WHERE edge AND ad > 0 GROUP BY ref, alt, risk, edge_n""")
def edge_rates(spark, sf_dir):
    rows = recalibrate.edges(alleles(spark, sf_dir).filter("pos % 11 <> 0"))  # thinned, so that there are edges
    return recalibrate.edge_rates(rows, F.col("ad") > 0)


# -- phasing -------------------------------------------------------------------

#: Loci lie 17 places apart, with a gap after each third, so that all are in neighborhoods.
SITE_POS = "({0}pos * 17 + {0}pos // 3 * 60)"
SITES_SQL = f"SELECT chrom, {SITE_POS.format('')} AS pos, ref, alt FROM ({ALLELES_SQL}) a"
NBHD_SQL = f"""SELECT chrom, pos, ref, alt, nbhd FROM (SELECT *, count(*) OVER (PARTITION BY chrom, nbhd) AS k FROM (
  SELECT *, CAST(sum(CASE WHEN pos - before < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos) AS BIGINT) AS nbhd FROM (
    SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS before FROM ({SITES_SQL}) s) a) b) c WHERE k >= 2"""


def sites(spark, sf_dir) -> DataFrame:
    rows = alleles(spark, sf_dir).withColumn("pos", F.expr(SITE_POS.format("").replace("//", "div")))
    return phasing.neighborhoods(rows).select("chrom", "pos", "ref", "alt", "nbhd")


@query(NBHD_SQL)
def neighborhoods(spark, sf_dir):
    return sites(spark, sf_dir)


@query(f"SELECT chrom, nbhd, min(pos) AS first, max(pos) AS last, count(*) AS sites FROM ({NBHD_SQL}) n GROUP BY chrom, nbhd")
def neighborhood_ranges(spark, sf_dir):
    return phasing.ranges(sites(spark, sf_dir))


STATES_SQL = f"""SELECT DISTINCT o.chrom, n.nbhd, o.amplicon * 1000 + o.read % 200 AS read, {SITE_POS.format('o.')} AS pos, CASE WHEN o.base = 'N' THEN 'N' WHEN o.base = o.alt THEN 'alt' WHEN o.base = o.ref THEN 'ref' ELSE 'X' END AS state
FROM ({OBS_SQL}) o JOIN ({NBHD_SQL}) n ON o.chrom = n.chrom AND {SITE_POS.format('o.')} = n.pos"""
READS_SQL = f"SELECT chrom, nbhd, read, pos, min(state) AS state FROM ({STATES_SQL}) s WHERE state <> 'N' GROUP BY chrom, nbhd, read, pos"


def states(spark, sf_dir) -> DataFrame:
    obs = views.obs(spark, sf_dir).withColumns({"pos": F.expr(SITE_POS.format("").replace("//", "div")), "read": F.col("amplicon") * 1000 + F.col("read") % 200})
    # sites are few beside their observations, which need no sort to meet them
    at = obs.filter("base <> 'N'").join(sites(spark, sf_dir).select("chrom", "pos", "nbhd").hint("shuffle_hash"), ["chrom", "pos"])
    return phasing.one_state(phasing.site_states(at))


SIGNED_SQL = f"""SELECT chrom, nbhd, signature, count(*) AS n FROM (
  SELECT chrom, nbhd, read, string_agg(CAST(pos AS VARCHAR) || ':' || state, ',' ORDER BY pos) AS signature FROM ({READS_SQL}) r GROUP BY chrom, nbhd, read) x GROUP BY chrom, nbhd, signature"""


@query(SIGNED_SQL)
def read_signatures(spark, sf_dir):
    return phasing.signatures(states(spark, sf_dir))


@query(f"SELECT chrom, nbhd, signature, n, round(n::DOUBLE / (sum(n) OVER (PARTITION BY chrom, nbhd))::DOUBLE, 6) AS weight FROM ({SIGNED_SQL}) s")
def cluster_weights(spark, sf_dir):
    return phasing.weights(phasing.signatures(states(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@query(f"""SELECT a.chrom, a.nbhd, a.pos AS pos_a, b.pos AS pos_b, CAST(sum(CASE WHEN b.state = 'alt' THEN 1 ELSE 0 END) AS BIGINT) AS both, count(*) AS a_known,
  round(avg(CASE WHEN b.state = 'alt' THEN 1.0 ELSE 0.0 END), 6) AS p
FROM ({READS_SQL}) a JOIN ({READS_SQL}) b ON a.chrom = b.chrom AND a.nbhd = b.nbhd AND a.read = b.read AND a.pos <> b.pos WHERE a.state = 'alt' GROUP BY a.chrom, a.nbhd, a.pos, b.pos""")
def phasing_probability(spark, sf_dir):
    return phasing.together(states(spark, sf_dir)).withColumn("p", F.round("p", 6)).select("chrom", "nbhd", "pos_a", "pos_b", F.col("both").cast("long").alias("both"), "a_known", "p")


@query(f"SELECT chrom, nbhd, pos, count(*) AS depth, CAST(sum(CASE WHEN state = 'alt' THEN 1 ELSE 0 END) AS BIGINT) AS support FROM ({READS_SQL}) r GROUP BY chrom, nbhd, pos")
def site_depths(spark, sf_dir):
    return phasing.depths(phasing.signatures(states(spark, sf_dir)))


@query()
def cluster_reads(spark, sf_dir):
    return clustering.clusters(phasing.signatures(states(spark, sf_dir)))


def reference_bases(spark, sf_dir) -> DataFrame:
    """(chrom, pos, base) of all places of the neighborhoods."""
    spans = phasing.ranges(sites(spark, sf_dir)).select("chrom", F.explode(F.sequence("first", "last")).alias("pos"))
    return spans.withColumn("base", F.substring(F.lit("ACGT"), (1 + F.col("pos") % 4).cast("int"), F.lit(1)))


def phased(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = clustering.clusters(phasing.signatures(states(spark, sf_dir)))
    return clustering.phased_alleles(found, sites(spark, sf_dir), reference_bases(spark, sf_dir))


@query()
def phased_haplotypes(spark, sf_dir):
    """Alleles of clusters of reads, trimmed, with averaged counts."""
    return phased(spark, sf_dir)[0]


@query()
def phased_recall(spark, sf_dir):
    """Phased alleles that may be called, with filters, and the original places called anew as references with what is left."""
    found, used = phased(spark, sf_dir)
    called = clustering.recalled(found).select("chrom", "nbhd", "pos", "ref", "alt", "support", "depth", "vq", joined("filters").alias("filters"))
    at = alleles(spark, sf_dir).withColumn("pos", F.expr(SITE_POS.format("").replace("//", "div"))).select("chrom", "pos", F.col("rd").alias("ref_support"), F.col("dp").alias("depth"))
    originals = sites(spark, sf_dir).join(at, ["chrom", "pos"])
    left = clustering.references_left(originals, used)
    return called.unionByName(left.select("chrom", "nbhd", "pos", "ref", F.lit(".").alias("alt"), "support", "depth", "vq", F.lit("").alias("filters")))


# -- reads ---------------------------------------------------------------------


def reads(spark, sf_dir) -> DataFrame:
    """An order's lines as reads: name, flag, chrom, pos, mapq, cigar, bases."""
    line = views.lines(spark, sf_dir)
    return line.select(
        F.col("l_orderkey").cast("string").alias("name"), F.when(F.col("l_linestatus") == "F", 0).otherwise(16).alias("flag"), F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"),
        F.col("l_linenumber").alias("mapq"), F.when(F.col("l_quantity") < 10, "30M2D20M").when(F.col("l_quantity") < 20, "5S45M").otherwise("50M").alias("cigar"), F.lit("ACGT").alias("bases"), F.lit(0).alias("nm"),
    )


@query("""SELECT l_orderkey::VARCHAR AS name, min(l_partkey) AS pos_1, max(l_partkey) AS pos_2 FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2""")
def mate_pairs(spark, sf_dir):
    return pairs.mates(reads(spark, sf_dir)).select("name", F.col("r1.pos").alias("pos_1"), F.col("r2.pos").alias("pos_2"))


@query("SELECT l_orderkey::VARCHAR AS name, l_partkey AS pos FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 2)")
def unpaired_reads(spark, sf_dir):
    return pairs.unpaired(reads(spark, sf_dir)).select("name", "pos")


@query("""SELECT l_returnflag AS chrom, l_partkey AS pos, CASE WHEN l_quantity < 10 THEN '30M2D20M' WHEN l_quantity < 20 THEN '5S45M' ELSE '50M' END AS cigar, min(l_orderkey::VARCHAR) AS name
FROM lineitem GROUP BY 1, 2, 3""")
def dup_reads(spark, sf_dir):
    return pairs.first_of_equal(reads(spark, sf_dir)).select("chrom", "pos", "cigar", "name")


@query("SELECT l_orderkey::VARCHAR AS name, l_partkey AS pos FROM lineitem WHERE l_linenumber >= 3")
def eligible_reads(spark, sf_dir):
    return reads(spark, sf_dir).filter(pairs.eligible(min_mapq=3)).select("name", "pos")


MATE_BASES = "CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END"


@query(f"""WITH m AS (SELECT l_suppkey AS name, l_partkey % 50 AS pos, {MATE_BASES} AS mate, max(substr('ACGT', CAST(1 + l_orderkey % 4 AS INT), 1) || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 2, '0')) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT name, pos, max(CASE WHEN mate = 0 THEN v END) AS a, max(CASE WHEN mate = 1 THEN v END) AS b FROM m GROUP BY name, pos),
x AS (SELECT name, pos, substr(a, 1, 1) AS ba, CAST(substr(a, 2) AS INT) AS qa, substr(b, 1, 1) AS bb, CAST(substr(b, 2) AS INT) AS qb FROM p)
SELECT CAST(name AS VARCHAR) AS name, pos, CASE WHEN ba IS NULL THEN bb WHEN bb IS NULL OR ba = bb OR qa >= qb THEN ba ELSE bb END AS base,
  CAST(CASE WHEN ba IS NULL THEN qb WHEN bb IS NULL THEN qa WHEN ba = bb THEN least(93, qa + qb) WHEN least(qa, qb) >= 20 THEN 0 ELSE greatest(qa, qb) END AS INTEGER) AS q,
  CASE WHEN ba IS NOT NULL AND bb IS NOT NULL THEN 2 WHEN ba IS NOT NULL THEN 0 ELSE 1 END AS dir FROM x""")
def stitch_pairs(spark, sf_dir):
    line = views.lines(spark, sf_dir)
    one = line.groupBy(F.col("l_suppkey").cast("string").alias("name"), (F.col("l_partkey") % 50).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1).alias("mate")).agg(
        F.max(F.struct(F.substring(F.lit("ACGT"), (1 + F.col("l_orderkey") % 4).cast("int"), F.lit(1)).alias("base"), F.col("l_quantity").cast("int").alias("q"))).alias("v"))
    bases = one.select("name", F.lit("1").alias("chrom"), "pos", "mate", "v.base", "v.q")
    return pairs.stitched(bases).select("name", "pos", "base", "q", "dir")


@query("""SELECT l_returnflag AS chrom, b AS bin, count(*) AS n, CAST(sum(CASE WHEN l_quantity < 5 THEN 1 ELSE 0 END) AS BIGINT) AS messy, CAST(sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS BIGINT) AS indel
FROM (SELECT *, unnest(generate_series(l_partkey // 20, (l_partkey + 49) // 20)) AS b FROM lineitem) x GROUP BY 1, 2""")
def bin_evidence(spark, sf_dir):
    return realign.bins(_spanned(spark, sf_dir), 20)


def _spanned(spark, sf_dir) -> DataFrame:
    line = views.lines(spark, sf_dir)
    return line.select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"), (F.col("l_partkey") + 49).alias("stop"), (F.col("l_quantity") < 5).alias("messy"), (F.col("l_quantity") < 10).alias("indel"))


@query(f"""SELECT a.chrom, a.bin, bool_or(b.own) AS usable FROM (
  SELECT *, (messy + indel)::DOUBLE / n >= 0.27 AND indel::DOUBLE / n >= 0.01 AND n >= 5 AS own FROM ({SQL['bin_evidence']}) e) a JOIN (
  SELECT *, (messy + indel)::DOUBLE / n >= 0.27 AND indel::DOUBLE / n >= 0.01 AND n >= 5 AS own FROM ({SQL['bin_evidence']}) e) b ON a.chrom = b.chrom AND b.bin BETWEEN a.bin - 1 AND a.bin + 1 GROUP BY a.chrom, a.bin""")
def messy_bins(spark, sf_dir):
    return realign.messy_bins(realign.bins(_spanned(spark, sf_dir), 20), mess=0.27).select("chrom", "bin", "usable")


def _sightings(spark, sf_dir) -> DataFrame:
    line = views.lines(spark, sf_dir).filter("l_quantity < 10")
    one = lambda c: c.cast("int")
    return line.select(
        F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") % 500).alias("pos"), F.lit("A").alias("ref"), F.concat(F.lit("A"), F.repeat(F.lit("C"), (F.col("l_linenumber")).cast("int"))).alias("alt"),
        F.col("l_linenumber").alias("left"), (8 - F.col("l_linenumber")).alias("right"), one(F.col("l_quantity") < 3).alias("mess"), (F.col("l_quantity") * 4).cast("int").alias("quality"),
        one(F.col("l_linestatus") == "F").alias("forward"), one(F.col("l_linestatus") != "F").alias("reverse"), one(F.col("l_linenumber") == 7).alias("stitched"), one(F.col("l_tax") > 0.04).alias("reputable"), F.lit(0).alias("repeat"), F.lit(0).alias("mate_unmapped"),
    )


@query()
def indel_score(spark, sf_dir):
    return realign.kept(realign.evidence(_sightings(spark, sf_dir))).select("chrom", "pos", "alt", "observations", "score", "outcome")


@query()
def indel_prune(spark, sf_dir):
    return realign.pruned(realign.kept(realign.evidence(_sightings(spark, sf_dir)))).select("chrom", "pos", "alt", "score")


@query("""WITH r AS (SELECT l_orderkey AS read, l_returnflag AS chrom, l_partkey AS pos FROM lineitem WHERE l_linenumber = 1),
i AS (SELECT l_returnflag AS chrom, l_partkey AS indel_pos, max(CAST(l_extendedprice AS INT)) AS score FROM lineitem WHERE l_linenumber = 7 AND l_quantity < 10 GROUP BY 1, 2)
SELECT read, pos, indel_pos, rank FROM (SELECT r.read, r.pos, i.indel_pos, CAST(row_number() OVER (PARTITION BY r.read, r.chrom, r.pos ORDER BY i.score DESC, i.indel_pos) AS INTEGER) AS rank
FROM r JOIN i ON r.chrom = i.chrom AND abs(i.indel_pos - r.pos) <= 250) x WHERE rank <= 5""")
def nearest_indels(spark, sf_dir):
    line = views.lines(spark, sf_dir)
    r = line.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("read"), F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos"))
    i = line.filter("l_linenumber = 7 and l_quantity < 10").groupBy(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos")).agg(F.max(F.rint("l_extendedprice").cast("int")).alias("score"))
    found = realign.nearest(r, i.withColumns({"ref": F.lit("A"), "alt": F.lit("AC")}))
    return found.select("read", "pos", "indel_pos", F.col("rank").cast("int").alias("rank"))


# -- sequences and records -----------------------------------------------------

LETTERS, SEQ = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
SEQ_SQL = f"SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{SEQ}') AS s FROM documents WHERE text IS NOT NULL"


def seqs(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", letters.renamed(LETTERS, SEQ)("text").alias("s"))


CIGAR_CASES = "CASE WHEN l_quantity < 10 THEN '30M2D20M' WHEN l_quantity < 20 THEN '5S40M3I2S' ELSE '50M' END"


@query("""SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_quantity < 10 THEN 50 WHEN l_quantity < 20 THEN 50 ELSE 50 END AS on_read,
  CASE WHEN l_quantity < 10 THEN 52 WHEN l_quantity < 20 THEN 40 ELSE 50 END AS on_reference, CASE WHEN l_quantity >= 10 AND l_quantity < 20 THEN 5 ELSE 0 END AS clipped FROM lineitem""")
def cigar_spans(spark, sf_dir):
    ops = sequence.cigar(F.expr(CIGAR_CASES))
    return views.lines(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), sequence.span(ops, sequence.ON_READ).alias("on_read"), sequence.span(ops, sequence.ON_REFERENCE).alias("on_reference"), sequence.clip(ops).alias("clipped"))


@query(f"""SELECT doc_id, (SELECT substr(t, 1, CAST(min(k) AS INT)) FROM (SELECT unnest([1, 2, 3, 4, 6, 12]) AS k) z WHERE repeat(substr(t, 1, CAST(k AS INT)), CAST(12 // k AS INT)) = t) AS unit
FROM (SELECT doc_id, repeat(substr(s, 1, CAST([1, 2, 3, 4, 6, 12][CAST(doc_id % 6 AS INT) + 1] AS INT)), CAST(12 // [1, 2, 3, 4, 6, 12][CAST(doc_id % 6 AS INT) + 1] AS INT)) AS t FROM ({SEQ_SQL}) q WHERE length(s) >= 12) x""")
def repeat_units(spark, sf_dir):
    k = F.get(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 6, 12)]), (F.col("doc_id") % 6).cast("int"))
    rows = seqs(spark, sf_dir).filter("length(s) >= 12").withColumn("k", k)
    return rows.select("doc_id", sequence.repeat_unit(F.repeat(F.left("s", F.col("k")), (12 / F.col("k")).cast("int"))).alias("unit"))


@query(f"SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS longest FROM ({SEQ_SQL}) q")
def homopolymer_runs(spark, sf_dir):
    return seqs(spark, sf_dir).select("doc_id", sequence.longest_homopolymer(F.col("s")).cast("long").alias("longest"))


CRUSHED_SQL = f"""SELECT chrom, pos // 3 AS pos, max_by(ref || repeat('G', CAST(pos % 3 AS INT)), length(ref || repeat('G', CAST(pos % 3 AS INT))) * 1000 + pos % 3) AS ref FROM ({ALLELES_SQL}) a WHERE ad > 0 GROUP BY chrom, pos // 3"""


@query(f"""SELECT chrom, pos // 3 AS pos, string_agg(CAST(ad AS BIGINT)::VARCHAR, ',' ORDER BY ref, alt, ad) AS ad, string_agg(alt, ',' ORDER BY ref, alt, ad) AS alt, greatest(max(dp), sum(ad))::BIGINT AS dp
FROM ({ALLELES_SQL}) a WHERE ad > 0 GROUP BY chrom, pos // 3""")
def crush_rows(spark, sf_dir):
    rows = alleles(spark, sf_dir).filter("ad > 0").withColumns({"pos": F.expr("pos div 3"), "filters": F.array().cast("array<string>")})
    return records.crushed(rows).select("chrom", "pos", "ad", "alt", "dp")


def _lines(spark, sf_dir) -> DataFrame:
    rows = pipelines.call_somatic(views.obs(spark, sf_dir)).withColumns({"noise_q": F.lit(20), "sb_scaled": F.col("sb.scaled")})
    return records.lines(rows)


@query(f"""SELECT chrom, pos, alt, CAST(dp AS BIGINT) AS dp, CAST(rd AS BIGINT)::VARCHAR || ',' || CAST(ad AS BIGINT)::VARCHAR AS ad, {SOMATIC_SQL} AS gt FROM ({CALLS_SQL}) c""")
def vcf_parse(spark, sf_dir):
    lines = _lines(spark, sf_dir).select(F.col("line").alias("value"))
    return records.parsed(lines).select("chrom", "pos", "alt", F.col("info")["DP"].cast("long").alias("dp"), F.col("sample")["AD"].alias("ad"), F.col("sample")["GT"].alias("gt"))


@query()
def vcf_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"""SELECT chrom, pos, alt, ad, dp FROM (SELECT chrom, pos // 3 AS pos, alt, CAST(ad AS BIGINT) AS ad, greatest(max(dp) OVER (PARTITION BY chrom, pos // 3), sum(ad) OVER (PARTITION BY chrom, pos // 3))::BIGINT AS dp FROM ({ALLELES_SQL}) a WHERE ad > 0) x""")
def uncrush_rows(spark, sf_dir):
    rows = crush_rows(spark, sf_dir)
    packed = rows.withColumn("sample", F.create_map(F.lit("AD"), F.col("ad"), F.lit("DP"), F.col("dp").cast("string"))).drop("ad", "dp")
    return records.uncrushed(packed).select("chrom", "pos", "alt", "ad", "dp")


# -- candidates ----------------------------------------------------------------


def candidate_rows(spark, sf_dir) -> DataFrame:
    # reads of 40 letters one after another; a read with a deletion lies on 42, and the last read's 42 end with the text
    # a shorter text is one read of all letters but two
    whole = seqs(spark, sf_dir)
    starts = F.expr("CASE WHEN length(s) < 3 THEN array() WHEN length(s) < 42 THEN array(0) ELSE array_distinct(concat(sequence(0, length(s) - 42, 40), array(length(s) - 42))) END")
    # a read's row has its own letters, not the text's; they are cut as bytes, which needs no walk from the text's start
    whole = whole.select("doc_id", F.least(F.lit(40), F.length("s") - 2).alias("n"), F.col("s").cast("binary").alias("s"), starts.alias("starts"))
    s = whole.select("doc_id", "n", F.posexplode(F.transform("starts", lambda at: F.substring(F.col("s"), at + 1, F.lit(60)))).alias("i", "s")).withColumn("s", F.col("s").cast("string"))
    # i * 7 + d leaves what (i + 6 * d) * 7 does when divided by 41
    again = F.slice(F.array(*[F.lit(j * 7 % 41) for j in range(82)]), ((F.col("doc_id") % 41 * 6 + 1) % 41 + 1).cast("int"), F.col("n"))
    quals = F.when(F.col("doc_id") >= 0, again).otherwise(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i * 7 + F.col("doc_id")).cast("int") % 41))
    rows = s.select(
        (F.col("doc_id") % 3).cast("string").alias("chrom"), (F.col("doc_id") % 40 + 1 + F.col("i") * 90 + F.expr("doc_id div 40") * 1_000_000).cast("long").alias("pos"), F.when(F.col("n") < 40, F.concat(F.col("n").cast("string"), F.lit("M"))).when(F.col("doc_id") % 5 == 0, "20M2I18M").when(F.col("doc_id") % 5 == 1, "20M2D20M").otherwise("40M").alias("cigar"),
        F.substring(F.col("s"), F.lit(1), F.col("n")).alias("bases"), quals.alias("quals"), F.replace("s", F.lit("A"), F.lit("C")).alias("reference"), (F.col("doc_id") % 2).cast("int").alias("dir"))
    return candidates.found(rows, mnvs=True)


@query()
def candidates_found(spark, sf_dir):
    return candidates.counted(candidate_rows(spark, sf_dir), "dir", "open_left", "open_right")


@query()
def collapse_candidates(spark, sf_dir):
    rows = candidates.counted(candidate_rows(spark, sf_dir), "open_left", "open_right")
    return candidates.collapsed(rows.withColumn("coverage", F.lit(100).cast("long")))


@query()
def mnv_reallocate(spark, sf_dir):
    rows = candidates.counted(candidate_rows(spark, sf_dir))
    return candidates.reallocated(rows.withColumn("callable", (F.length("alt") == 1) | (F.col("support") > 3)))


# -- ordered streams -----------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', CAST(ts AS TIMESTAMP)) AS block, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_blocks(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windows.blocks(events, "ts", "1 hour", "10 minutes", "event_type").withColumn("total", F.round("total", 4)).select("event_type", F.col("block").cast("timestamp_ntz").alias("block"), "n", "total")


@query("""SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN ts <= before + INTERVAL '30 minutes' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
    SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS ts, lag(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) a) b GROUP BY user_id, run""")
def event_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = windows.sessions(events, "ts", "30 minutes", "10 minutes", "user_id")
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


from varigrid import catalogue_deep, catalogue_parts, catalogue_reads, catalogue_sites  # noqa: E402, F401  register more queries
