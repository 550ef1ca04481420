"""More named queries: single functions and smaller operators, each with its SQL.

Reads here are order lines: flags, alignments and bases follow from a line's
numbers, so that all flags, clips, insertions and deletions occur; bases are the
digits of a hash.  Whole tables are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varigrid.catalogue import ALLELES_SQL, CALLS_SQL, DIPLOID_SQL, INTERVALS_SQL, OBS_SQL, SOMATIC_SQL, alleles, binomial_sql, calls, joined, pool_sql, query, two_pools, variant_q_sql, vf_sql
from varigrid.functions import records, sequence, stats
from varigrid.operators import calling, genotype, intervals, mixture, pairs, phasing, pileup, pools, realign, recalibrate
from varigrid.plans import pipelines, views
from varigrid.sources import text
from varigrid.sources.shared import scratch

# -- reads from lines -----------------------------------------------------------

NUMBERS = """l_orderkey AS id, l_linenumber AS line, l_orderkey::VARCHAR AS name, l_returnflag AS chrom, l_partkey AS pos, CAST(l_quantity AS INT) AS mapq,
  l_linenumber % 4 AS soft, CAST(10 + l_quantity AS INT) AS m, CAST(l_suppkey % 4 AS INT) AS ins, CAST(l_partkey % 3 AS INT) AS del"""
FLAG_SQL = """1 + CASE WHEN l_quantity > 5 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 31 = 0 THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END
  + CASE WHEN l_suppkey % 17 = 0 THEN 256 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_suppkey % 29 = 0 THEN 2048 ELSE 0 END"""
HASHED = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGN')"
LINE_KEY = "l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR"
BASES_SQL, OTHER_SQL = HASHED.format(LINE_KEY), HASHED.format("l_partkey::VARCHAR")
READ_SQL = f"""SELECT {NUMBERS}, {FLAG_SQL} AS flag, {BASES_SQL} AS bases, {OTHER_SQL} AS other FROM lineitem"""
ALIGNED_SQL = f"""SELECT *, CASE WHEN soft > 0 THEN soft || 'S' ELSE '' END || m || 'M' || CASE WHEN ins > 0 THEN ins || 'I' ELSE '' END || '5M' || CASE WHEN del > 0 THEN del || 'D' ELSE '' END || '20M' AS cigar FROM ({READ_SQL}) r"""


def hashed(key: Column) -> Column:
    return F.translate(F.md5(key), "0123456789abcdef", "ACGTACGTACGTACGN")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as reads: id, line, name, chrom, pos, mapq, soft, m, ins, del, flag, bases, other, cigar."""
    rows = views.lines(spark, sf_dir).withColumn("q", F.col("l_quantity").cast("int"))
    bit = lambda when, value: F.when(when, value).otherwise(0)
    c = F.col
    flag = F.lit(1) + bit(c("l_quantity") > 5, 2) + bit(c("l_partkey") % 31 == 0, 4) + bit(c("l_linestatus") == "F", 16) + bit(c("l_suppkey") % 17 == 0, 256) + bit(c("l_partkey") % 13 == 0, 1024) + bit(c("l_suppkey") % 29 == 0, 2048)
    rows = rows.select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_orderkey").cast("string").alias("name"), c("l_returnflag").alias("chrom"), c("l_partkey").alias("pos"), c("q").alias("mapq"),
        (c("l_linenumber") % 4).alias("soft"), (10 + c("q")).alias("m"), (c("l_suppkey") % 4).cast("int").alias("ins"), (c("l_partkey") % 3).cast("int").alias("del"), flag.alias("flag"),
        hashed(F.concat_ws(":", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))).alias("bases"), hashed(c("l_partkey").cast("string")).alias("other"),
    )
    part = lambda n, op: F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(op))).otherwise("")
    return rows.withColumn("cigar", F.concat(part("soft", "S"), c("m").cast("string"), F.lit("M"), part("ins", "I"), F.lit("5M"), part("del", "D"), F.lit("20M")))


@query(f"""SELECT id, line, soft + m + ins + 25 AS on_read, m + del + 25 AS on_reference, soft AS clip, 0 AS end_clip, CASE WHEN ins > 0 OR del > 0 THEN true ELSE false END AS has_indel,
  '20M' || CASE WHEN del > 0 THEN del || 'D' ELSE '' END || '5M' || CASE WHEN ins > 0 THEN ins || 'I' ELSE '' END || m || 'M' || CASE WHEN soft > 0 THEN soft || 'S' ELSE '' END AS backward,
  repeat('S', soft) || repeat('M', m) || repeat('I', ins) || 'MMMMM' || repeat('D', del) || repeat('M', 20) AS letters FROM ({ALIGNED_SQL}) a""")
def alignment_strings(spark, sf_dir):
    ops = sequence.cigar(F.col("cigar"))
    return aligned(spark, sf_dir).select(
        "id", "line", sequence.span(ops, sequence.ON_READ).alias("on_read"), sequence.span(ops, sequence.ON_REFERENCE).alias("on_reference"), sequence.clip(ops).alias("clip"), sequence.clip(ops, True).alias("end_clip"),
        sequence.has_operation(ops, "ID").alias("has_indel"), sequence.cigar_text(sequence.reversed_cigar(ops)).alias("backward"), sequence.expanded(ops).alias("letters"),
    )


@query(f"SELECT id, line, CASE WHEN ins = 0 THEN soft || 'S' || (m + 5) || 'M' ELSE soft || 'S' || m || 'M' || ins || 'I5M' END || CASE WHEN del > 0 THEN del || 'D20M' ELSE '' END AS rebuilt FROM ({ALIGNED_SQL}) a WHERE soft > 0 AND del > 0")
def rebuilt_alignments(spark, sf_dir):
    rows = aligned(spark, sf_dir).filter("soft > 0 and del > 0")
    return rows.select("id", "line", sequence.run_lengths(sequence.expanded(sequence.cigar(F.col("cigar")))).alias("rebuilt"))


@query(f"""SELECT id, line, array_to_string(list_concat(list_concat(list_concat(list_concat(list_transform(range(soft), lambda i: -1::BIGINT), range(pos, pos + m)), list_transform(range(ins), lambda i: -1::BIGINT)), range(pos + m, pos + m + 5)), range(pos + m + 5 + del, pos + m + del + 25)), ',') AS places FROM ({ALIGNED_SQL}) a""")
def read_positions(spark, sf_dir):
    places = sequence.position_map(sequence.cigar(F.col("cigar")), F.col("pos"))
    return aligned(spark, sf_dir).select("id", "line", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


@query(f"""SELECT id, line, greatest(0, least(pos + m - 1, hi) - greatest(pos, lo) + 1) + greatest(0, least(pos + m + 4, hi) - greatest(pos + m, lo) + 1) + greatest(0, least(pos + m + del + 24, hi) - greatest(pos + m + 5 + del, lo) + 1) AS bases
FROM (SELECT *, pos - 7 + line * 5 AS lo, pos + 9 + line * 5 AS hi FROM ({ALIGNED_SQL}) a) b""")
def overlap_with_region(spark, sf_dir):
    rows = aligned(spark, sf_dir).withColumns({"lo": F.col("pos") - 7 + F.col("line") * 5, "hi": F.col("pos") + 9 + F.col("line") * 5})
    return rows.select("id", "line", sequence.aligned_overlap(sequence.cigar(F.col("cigar")), F.col("pos"), F.col("lo"), F.col("hi")).cast("long").alias("bases"))


@query(f"SELECT id, line, repeat('0', m) || repeat('2', 5) || repeat('1', ins + 1) AS each FROM ({ALIGNED_SQL}) a")
def base_directions(spark, sf_dir):
    runs = F.concat(F.col("m").cast("string"), F.lit("F5S"), (F.col("ins") + 1).cast("string"), F.lit("R"))
    return aligned(spark, sf_dir).select("id", "line", F.array_join(F.transform(sequence.directions(runs), lambda d: d.cast("string")), "").alias("each"))


DIFFER_SQL = "list_sum(list_transform(range(1, 33), lambda i: CASE WHEN substr(bases, i, 1) <> substr(other, i, 1) AND substr(bases, i, 1) <> 'N' AND substr(other, i, 1) <> 'N' THEN 1 ELSE 0 END))"


@query(f"SELECT id, line, CAST({DIFFER_SQL} AS BIGINT) AS differing, {DIFFER_SQL} = 0 AS alike, CAST(list_min(list_transform(range(1, 34), lambda i: CASE WHEN i = 33 OR substr(bases, i, 1) <> substr(other, i, 1) THEN i - 1 ELSE 99 END)) AS BIGINT) AS prefix, CAST(list_min(list_transform(range(1, 34), lambda i: CASE WHEN i = 33 OR substr(bases, 33 - i, 1) <> substr(other, 33 - i, 1) THEN i - 1 ELSE 99 END)) AS BIGINT) AS suffix FROM ({READ_SQL}) r")
def compared_bases(spark, sf_dir):
    a, b = F.col("bases"), F.col("other")
    return aligned(spark, sf_dir).select("id", "line", sequence.hamming(a, b).cast("long").alias("differing"), sequence.wildcard_equal(a, b).alias("alike"), sequence.shared_prefix(a, b).cast("long").alias("prefix"), sequence.shared_suffix(a, b).cast("long").alias("suffix"))


@query(f"""SELECT id, line, length(regexp_extract(bases, '^[AC]*')) AS lead, round(greatest(length(bases) - length(replace(bases, 'A', '')), length(bases) - length(replace(bases, 'C', '')), length(bases) - length(replace(bases, 'G', '')), length(bases) - length(replace(bases, 'T', '')))::DOUBLE / 32, 6) AS share,
  coalesce(list_max(list_transform(regexp_extract_all(bases, 'A+|C+|G+|T+|N+'), lambda x: length(x))), 0) AS longest, coalesce(list_max(list_transform(regexp_extract_all(bases, '(?:AC)+'), lambda x: length(x) // 2)), 0) AS copies,
  substr(w, 2) = substr(w, 1, 4) OR substr(w, 3) = substr(w, 1, 3) OR substr(w, 4) = substr(w, 1, 2) AS tandem FROM (SELECT *, substr(bases, 1, 5) AS w FROM ({READ_SQL}) r) x""")
def base_composition(spark, sf_dir):
    s = F.col("bases")
    return aligned(spark, sf_dir).select(
        "id", "line", sequence.run_at_start(s, "AC").cast("long").alias("lead"), F.round(sequence.one_base_share(s), 6).alias("share"), sequence.longest_homopolymer(s).cast("long").alias("longest"),
        sequence.most_repeats(s, "AC").cast("long").alias("copies"), sequence.tandem(F.left(s, F.lit(5))).alias("tandem"),
    )


_COPIES = " + ".join("CASE WHEN " + " AND ".join(f"substr(other, {9 + 2 * j}, 2) = unit" for j in range(i + 1)) + " THEN 1 ELSE 0 END" for i in range(12))
_BACK = " + ".join("CASE WHEN " + " AND ".join(f"substr(other, {7 - 2 * j}, 2) = unit" for j in range(i + 1)) + " THEN 1 ELSE 0 END" for i in range(4))


@query(f"SELECT id, line, CAST(CASE WHEN ({_BACK}) = 0 AND ({_COPIES}) = 0 THEN 0 ELSE ({_BACK}) + ({_COPIES}) END AS BIGINT) AS copies FROM (SELECT *, substr(other, 9, 2) AS unit FROM ({READ_SQL}) r) x")
def repeats_at_place(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    return rows.select("id", "line", sequence.repeat_context(F.col("other"), F.lit(9), F.substring("other", 9, 2)).cast("long").alias("copies"))


_CODE = "CASE b WHEN 'A' THEN 0 WHEN 'G' THEN 1 WHEN 'C' THEN 2 WHEN 'T' THEN 3 WHEN '-' THEN 5 ELSE 4 END"


@query(f"SELECT id, line, b, {_CODE} AS code, CASE WHEN line % 2 = 0 THEN (CASE WHEN first THEN 'RF' ELSE 'FR' END) ELSE (CASE WHEN first THEN 'FR' ELSE 'RF' END) END AS orientation, (CASE WHEN fwd > 0 AND rev > 0 THEN 'duplex' WHEN o = 'FR' THEN 'simplex_forward' WHEN o = 'RF' THEN 'simplex_reverse' ELSE 'simplex_other' END) || CASE WHEN soft = 0 THEN '_stitched' ELSE '_unstitched' END AS kind FROM (SELECT *, CASE WHEN line = 5 THEN '-' ELSE substr(bases, 1, 1) END AS b, pos <= id AS first, ins AS fwd, del AS rev, CASE WHEN line % 2 = 0 THEN (CASE WHEN pos <= id THEN 'RF' ELSE 'FR' END) ELSE (CASE WHEN pos <= id THEN 'FR' ELSE 'RF' END) END AS o FROM ({READ_SQL}) r) x")
def base_and_read_codes(spark, sf_dir):
    rows = aligned(spark, sf_dir).withColumn("b", F.when(F.col("line") == 5, "-").otherwise(F.substring("bases", 1, 1)))
    way = sequence.orientation(F.col("line") % 2 == 0, F.col("line") % 2 != 0, F.col("pos"), F.col("id"))
    return rows.select("id", "line", "b", sequence.allele_code(F.col("b")).alias("code"), way.alias("orientation"), sequence.duplex_class(F.col("soft") == 0, way, F.col("ins"), F.col("del")).alias("kind"))


_KINDS = ["duplex_stitched", "duplex_unstitched", "simplex_forward_stitched", "simplex_forward_unstitched", "simplex_reverse_stitched", "simplex_reverse_unstitched"]


@query("SELECT chrom, " + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in _KINDS) + f" FROM (SELECT chrom, CASE WHEN ins > 0 AND del > 0 THEN 'duplex' WHEN line % 2 = 0 THEN 'simplex_forward' ELSE 'simplex_reverse' END || CASE WHEN soft = 0 THEN '_stitched' ELSE '_unstitched' END AS kind FROM ({READ_SQL}) r) x GROUP BY chrom")
def collapsed_read_counts(spark, sf_dir):
    way = F.when(F.col("line") % 2 == 0, "FR").otherwise("RF")
    rows = aligned(spark, sf_dir).withColumn("kind", sequence.duplex_class(F.col("soft") == 0, way, F.col("ins"), F.col("del")))
    return pileup.collapsed_counts(rows, "chrom").select("chrom", *_KINDS)


@query(f"SELECT id, line, 'c' || line AS chrom, pos AS at, CASE WHEN ins > 1 THEN '+' ELSE '-' END AS strand, cigar, mapq, ins AS nm FROM ({ALIGNED_SQL}) a WHERE del > 0")
def supplementary_tags(spark, sf_dir):
    rows = aligned(spark, sf_dir).filter("del > 0")
    one = F.concat_ws(",", F.concat(F.lit("c"), F.col("line").cast("string")), F.col("pos").cast("string"), F.when(F.col("ins") > 1, "+").otherwise("-"), "cigar", F.col("mapq").cast("string"), F.col("ins").cast("string"))
    found = rows.select("id", "line", F.explode(sequence.supplementary(F.concat(one, F.lit(";")))).alias("s"))
    return found.select("id", "line", "s.chrom", F.col("s.pos").alias("at"), "s.strand", "s.cigar", "s.mapq", "s.nm")


@query(f"SELECT id, line, ins AS nm, CASE WHEN del > 0 THEN 'amp' || del ELSE NULL END AS amplicon, CAST(3 AS BIGINT) AS tags FROM ({READ_SQL}) r")
def read_tags(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    tags = sequence.tags(F.concat(F.lit("NM:i:0"), F.when(F.col("del") > 0, F.concat(F.lit("\tXN:Z:amp"), F.col("del").cast("string"))).otherwise("\tXD:Z:5F"), F.lit("\tRG:Z:a:b")))
    tags = sequence.with_tag(tags, "NM", F.col("ins").cast("string"))
    return rows.select("id", "line", sequence.tag(tags, "NM").cast("int").alias("nm"), sequence.tag(tags, "XN").alias("amplicon"), F.size(F.map_keys(tags)).cast("long").alias("tags"))


@query(f"SELECT id, line, CAST(ins + del AS BIGINT) AS substitutions FROM ({READ_SQL}) r")
def mismatch_tags(spark, sf_dir):
    md = F.concat(F.lit("10"), F.repeat(F.lit("A3"), F.col("ins")), F.lit("^CG4"), F.repeat(F.lit("T0"), F.col("del")), F.lit("5"))
    return aligned(spark, sf_dir).select("id", "line", sequence.md_substitutions(md).cast("long").alias("substitutions"))


@query(f"SELECT id, line, chrom || ':' || pos || ' ' || r || '>' || a AS key, chrom, pos, r AS ref, a AS alt FROM (SELECT *, substr(bases, 1, 1 + del) AS r, substr(bases, 1, 1) || repeat('T', ins) AS a FROM ({READ_SQL}) q) x")
def indel_keys(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    key = sequence.indel_key(F.col("chrom"), F.col("pos"), F.left("bases", 1 + F.col("del")), F.concat(F.left("bases", F.lit(1)), F.repeat(F.lit("T"), F.col("ins"))))
    back = F.get(sequence.indels_of_key(key), 0)
    return rows.select("id", "line", key.alias("key"), back["chrom"].alias("chrom"), back["pos"].alias("pos"), back["ref"].alias("ref"), back["alt"].alias("alt"))


@query(f"SELECT id, line FROM ({ALIGNED_SQL}) a WHERE flag & 4 = 0 AND flag & 256 = 0 AND flag & 2048 = 0 AND flag & 1024 = 0 AND flag & 2 <> 0 AND mapq >= 20")
def eligible_flags(spark, sf_dir):
    return aligned(spark, sf_dir).filter(pairs.eligible(min_mapq=20, proper_only=True)).select("id", "line")


@query(f"SELECT id, line FROM ({READ_SQL}) r WHERE (mapq = 0 OR mapq >= 12) AND flag & 2048 = 0 AND flag & 256 = 0 AND flag & 2 <> 0 AND id % 10 <> 0")
def stitchable_reads(spark, sf_dir):
    rows = aligned(spark, sf_dir)
    excluded = rows.filter("id % 10 = 0").select("name")
    return pairs.stitchable(rows, min_mapq=12, proper_only=True, excluded=excluded).select("id", "line")


@query(f"SELECT chrom, pos, cigar, bases, min(name) AS name FROM ({ALIGNED_SQL}) a GROUP BY chrom, pos, cigar, bases")
def first_of_equal_reads(spark, sf_dir):
    return pairs.first_of_equal(aligned(spark, sf_dir)).select("chrom", "pos", "cigar", "bases", "name")


@query("""SELECT name, pos_1, pos_2 FROM (SELECT l_orderkey::VARCHAR AS name, min(l_partkey) AS pos_1, max(l_partkey) AS pos_2, min(l_returnflag) AS a, max(l_returnflag) AS b FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2) x WHERE a = b AND pos_2 - pos_1 <= 400""")
def near_mates(spark, sf_dir):
    return pairs.within(aligned(spark, sf_dir).select("name", "chrom", "pos", "flag"), 400).select("name", F.col("r1.pos").alias("pos_1"), F.col("r2.pos").alias("pos_2"))


# -- records --------------------------------------------------------------------

GENOTYPES = ["0/0", "0|1", "1/1", "1|2", "./.", "0/.", "1/.", "0", "1", ".", "2/2"]
FILTERS = ["q30", "R8", "R5x9", "LowDP", "LowGQ", "SB", "PB", "AB", "NC", "LowVariantFreq", "MultiAllelicSite", "ForcedReport", "what"]
_GT_NAMES = ["hom_ref", "het", "hom_alt", "het_alts", "no_call", "ref_and_no_call", "alt_and_no_call", "hemi_ref", "hemi_alt", "hemi_no_call", "other"]
_FILTER_NAMES = ["low_quality", "indel_repeat", "repeat", "low_depth", "low_genotype_quality", "strand_bias", "pool_bias", "amplicon_bias", "no_call", "low_frequency", "multi_allelic", "forced", "unknown"]
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(f"""SELECT l_orderkey AS id, l_linenumber AS line, {_LIST(_GT_NAMES)}[CAST(l_partkey % 11 AS INT) + 1] AS genotype, {_LIST(_FILTER_NAMES)}[CAST(l_suppkey % 13 AS INT) + 1] AS filter,
  CASE WHEN l_linenumber = 1 THEN 'PASS' ELSE {_LIST(FILTERS)}[CAST(l_suppkey % 13 AS INT) + 1] || ';SB' END AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'smp.' || l_orderkey ELSE '' END AS sample FROM lineitem""")
def record_words(spark, sf_dir):
    pick = lambda xs, c: F.get(F.array(*[F.lit(x) for x in xs]), (F.col(c) % len(xs)).cast("int"))
    gt, tag = pick(GENOTYPES, "l_partkey"), pick(FILTERS, "l_suppkey")
    path = F.concat(F.lit("/a/smp."), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "_S12.genome.vcf.gz").otherwise(".bam"))
    listed = F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(F.array(tag, F.lit("SB")))
    return views.lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), records.genotype_kind(gt).alias("genotype"), records.filter_kind(tag).alias("filter"), records.filter_text(listed).alias("text"), records.sample_name(path).alias("sample")
    )


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_linenumber AS BIGINT) AS duplex, CAST(l_suppkey AS BIGINT) AS last FROM lineitem")
def umi_counts(spark, sf_dir):
    value = F.concat_ws(",", *[F.col("l_linenumber").cast("string")] + [F.lit(str(i)) for i in range(6)] + [F.col("l_suppkey").cast("string")])
    counts = records.umi_counts(value)
    return views.lines(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.get(counts["support"], 0).cast("long").alias("duplex"), F.get(counts["support"], 7).cast("long").alias("last"))


_MODELS = {"chr1": "diploid", "MT": "somatic", "chrM": "somatic", "X": "haploid", "chrY": "haploid", "7": "diploid"}


@query("SELECT l_orderkey AS id, " + _LIST(_MODELS.values()) + "[CAST(l_partkey % 6 AS INT) + 1] AS model FROM lineitem")
def ploidy_models(spark, sf_dir):
    chrom = F.get(F.array(*[F.lit(x) for x in _MODELS]), (F.col("l_partkey") % 6).cast("int"))
    return views.lines(spark, sf_dir).select(F.col("l_orderkey").alias("id"), genotype.ploidy(chrom, male=True).alias("model"))


# -- calls ----------------------------------------------------------------------


@query(f"SELECT chrom, pos, alt FROM ({CALLS_SQL}) c WHERE vf >= 0.01::FLOAT AND vq >= 20")
def callable_alleles(spark, sf_dir):
    return calling.callable_rows(calls(spark, sf_dir)).select("chrom", "pos", "alt")


FORCED_SQL = f"SELECT chrom, pos + 3 AS pos, ref, alt FROM ({ALLELES_SQL}) f WHERE pos % 5 = 0"


@query(f"""SELECT chrom, pos, ref, alt, false AS forced FROM ({CALLS_SQL}) c UNION ALL
SELECT chrom, pos, ref, alt, true AS forced FROM (SELECT DISTINCT * FROM ({FORCED_SQL}) x) f WHERE NOT EXISTS (SELECT 1 FROM ({CALLS_SQL}) c WHERE c.chrom = f.chrom AND c.pos = f.pos AND c.ref = f.ref AND c.alt = f.alt)""")
def forced_reports(spark, sf_dir):
    rows = calls(spark, sf_dir).select("chrom", "pos", "ref", "alt").withColumn("filters", F.array().cast("array<string>"))
    forced = alleles(spark, sf_dir).filter("pos % 5 = 0").select("chrom", (F.col("pos") + 3).alias("pos"), F.lower("ref").alias("ref"), "alt")
    return calling.with_forced(rows, forced).select("chrom", "pos", "ref", "alt", "forced")


@query(f"SELECT chrom, pos, alt, pos % 5 = 0 AND ad > 3 AS known FROM ({ALLELES_SQL}) a")
def known_alleles(spark, sf_dir):
    rows = alleles(spark, sf_dir)
    return calling.with_known(rows, rows.filter("pos % 5 = 0 and ad > 3")).select("chrom", "pos", "alt", "known")


GROUPED_SQL = f"SELECT chrom, pos // 4 AS pos, ref, alt, pos % 3 = 0 AS forced, CASE WHEN pos % 2 = 0 THEN ref ELSE alt END AS called, vf, dp, vq FROM ({CALLS_SQL}) c"


@query(f"SELECT chrom, pos, called FROM (SELECT *, bool_or(called <> ref AND NOT forced) OVER (PARTITION BY chrom, pos) AS real FROM ({GROUPED_SQL}) g) x WHERE called <> ref OR NOT real")
def references_pruned(spark, sf_dir):
    rows = calls(spark, sf_dir).select("chrom", F.expr("pos div 4").alias("pos"), "ref", F.when(F.col("pos") % 2 == 0, F.col("ref")).otherwise(F.col("alt")).alias("alt"), (F.col("pos") % 3 == 0).alias("forced"))
    return calling.without_covered_references(rows).select("chrom", "pos", F.col("alt").alias("called"))


@query(f"""SELECT chrom, pos, CASE WHEN low AND shallow THEN 'LowDP;q30' WHEN low THEN 'q30' WHEN shallow THEN 'LowDP' ELSE '' END AS filters FROM (
  SELECT chrom, pos, bool_or(vq < 30 AND dp <> 0) AS low, bool_or(dp < 10) AS shallow FROM ({GROUPED_SQL}) g GROUP BY chrom, pos) x""")
def merged_site_filters(spark, sf_dir):
    options = calling.CallOptions(no_call_filter=None, strand_bias=None)
    rows = calls(spark, sf_dir).select("chrom", F.expr("pos div 4").alias("pos"), calling.filters(options).alias("filters"))
    return calling.merged_filters(rows).select("chrom", "pos", joined("filters").alias("filters"))


@query(f"SELECT chrom, pos, genotype, CASE WHEN vq < 50 THEN 'LowGQ' ELSE '' END AS filters FROM (SELECT *, {SOMATIC_SQL} AS genotype FROM ({CALLS_SQL}) c) d WHERE genotype <> './.' OR pos % 2 = 0")
def tagged_and_elided(spark, sf_dir):
    rows = pipelines.call_somatic(views.obs(spark, sf_dir)).withColumns({"alt": F.when(F.col("pos") % 2 == 0, F.col("alt")).otherwise("."), "filters": F.array().cast("array<string>")})
    kept = calling.elided(calling.tagged(rows, "LowGQ", F.col("vq") < 50), gvcf=True)
    return kept.select("chrom", "pos", "genotype", joined("filters").alias("filters"))


TOP_SQL = f"""SELECT chrom, pos, alt, vf, CAST(row_number() OVER (PARTITION BY chrom, pos ORDER BY vf DESC, ref, alt) AS BIGINT) AS rank, 1 - sum(vf::DOUBLE) OVER (PARTITION BY chrom, pos) AS rest
FROM (SELECT chrom, pos // 5 AS pos, ref, alt, CAST(vf / 3 AS FLOAT) AS vf FROM ({CALLS_SQL}) c) g"""


@query(f"SELECT chrom, pos, alt, rank FROM ({TOP_SQL}) t WHERE rank = 1 OR rank = 2 AND round(rest, 5) <= round(vf::DOUBLE, 5)")
def top_two_of_many(spark, sf_dir):
    rows = calls(spark, sf_dir).select("chrom", F.expr("pos div 5").alias("pos"), "ref", "alt", (F.col("vf") / 3).cast("float").alias("vf"))
    return calling.top_two(rows).select("chrom", "pos", "alt", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT chrom, pos, genotype, CAST(CASE WHEN genotype = '.' OR dp = 0 THEN 0 ELSE greatest(0, least(100, floor(10.0 / ln(10.0::DOUBLE) * ((n * ln(0.075::DOUBLE * dp) - 0.075::DOUBLE * dp - lgamma(n + 1)) - {binomial_sql('ad', 'dp', 0.4)})))) END AS INTEGER) AS gq
FROM (SELECT *, dp - ad AS n, CASE WHEN dp < 10 OR NOT vf > 0.7::FLOAT THEN '.' ELSE '1' END AS genotype FROM ({CALLS_SQL}) c) d""")
def haploid_gq(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("genotype", genotype.haploid(F.lit(False), F.col("vf"), F.col("dp")))
    return rows.select("chrom", "pos", "genotype", stats.haploid_gq(F.col("genotype"), F.col("ad"), F.col("dp")).alias("gq"))


@query(f"SELECT chrom, pos, ref, alt FROM (SELECT *, max(CASE WHEN length(ref) > length(alt) THEN pos + length(ref) - 1 END) OVER (PARTITION BY chrom ORDER BY pos, ref, alt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT chrom, pos * 3 AS pos, repeat(ref, CAST(1 + pos % 4 AS INT)) AS ref, alt FROM ({ALLELES_SQL}) a) b) c WHERE reach IS NULL OR pos > reach")
def outside_deletions(spark, sf_dir):
    rows = alleles(spark, sf_dir).withColumns({"ref": F.repeat("ref", (1 + F.col("pos") % 4).cast("int")), "pos": F.col("pos") * 3})
    return mixture.outside_deletions(rows).select("chrom", "pos", "ref", "alt")


@query(f"SELECT chrom, pos, genotype FROM ({DIPLOID_SQL}) d WHERE genotype = '0/1' AND chrom IN ('A', 'N')")
def phasable_calls(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("ref_vf", calling.frequency(F.col("rd"), F.col("dp")))
    gt = genotype.diploid(rows).select("chrom", "pos", "genotype", "filters")
    return phasing.phasable(rows.select("chrom", "pos", "ref", "alt").join(gt, ["chrom", "pos"]), het_only=True, chroms=["A", "N"]).select("chrom", "pos", "genotype")


@query(f"SELECT chrom, nbhd, pos FROM (SELECT chrom, pos // 6 AS nbhd, pos, sum(CASE WHEN vq >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, pos // 6) AS good FROM ({CALLS_SQL}) c) x WHERE good >= 2 OR good = (SELECT count(*) FROM ({CALLS_SQL}) y WHERE y.chrom = x.chrom AND y.pos // 6 = x.nbhd)")
def passing_neighborhoods(spark, sf_dir):
    tags = F.when(F.col("vq") < 30, F.array(F.lit("q30"))).otherwise(F.array().cast("array<string>"))
    rows = calls(spark, sf_dir).select("chrom", F.expr("pos div 6").alias("nbhd"), "pos", tags.alias("filters"))
    return phasing.with_passing(rows, least=2).select("chrom", "nbhd", "pos")


# -- pileups and intervals --------------------------------------------------------


@query(f"SELECT chrom, pos // 2 AS pos, ref, CAST(sum(ad) AS BIGINT) AS support FROM ({ALLELES_SQL}) a GROUP BY chrom, pos // 2, ref")
def candidate_sums(spark, sf_dir):
    rows = alleles(spark, sf_dir).select("chrom", F.expr("pos div 2").alias("pos"), "ref", F.lit("A").alias("alt"), F.col("ad").alias("support"))
    return pileup.candidate_sums(rows).select("chrom", "pos", "ref", "support")


MNV_SQL = f"SELECT chrom, pos * 2 AS pos, substr(s, 1, 6) AS ref, substr(s, 2, 6) AS alt, ad AS support FROM (SELECT *, {HASHED.format('pos::VARCHAR')} AS s FROM ({ALLELES_SQL}) a) b"


@query(f"SELECT chrom, pos + i AS pos, CAST(sum(support) AS BIGINT) AS n FROM (SELECT *, unnest(range(6)) AS i FROM ({MNV_SQL}) m) x WHERE substr(ref, CAST(i AS INT) + 1, 1) = substr(alt, CAST(i AS INT) + 1, 1) GROUP BY chrom, pos + i")
def gapped_reference(spark, sf_dir):
    s = hashed(F.col("pos").cast("string"))
    rows = alleles(spark, sf_dir).select("chrom", (F.col("pos") * 2).alias("pos"), F.substring(s, 1, 6).alias("ref"), F.substring(s, 2, 6).alias("alt"), F.col("ad").alias("support"))
    return pileup.gapped_reference(rows).select("chrom", "pos", F.col("n").cast("long").alias("n"))


@query(f"SELECT chrom, pos, CAST(sum(CASE WHEN base = ref THEN 1 ELSE 0 END) AS BIGINT) AS support FROM ({OBS_SQL}) o GROUP BY chrom, pos")
def reference_support(spark, sf_dir):
    return pileup.reference_candidates(views.obs(spark, sf_dir)).select("chrom", "pos", "support")


@query(f"""SELECT c.chrom, c.pos, c.ref, CAST(count(*) FILTER (WHERE r.pos <= c.pos - 1 AND r.pos + 49 >= c.pos + length(c.ref)) AS BIGINT) AS spanning FROM
  (SELECT DISTINCT chrom, pos * 10 AS pos, repeat(ref, CAST(1 + pos % 4 AS INT)) AS ref FROM ({ALLELES_SQL}) a) c LEFT JOIN (SELECT l_returnflag AS chrom, l_partkey AS pos FROM lineitem) r ON r.chrom = c.chrom AND r.pos BETWEEN c.pos - 60 AND c.pos GROUP BY c.chrom, c.pos, c.ref""")
def exact_span_coverage(spark, sf_dir):
    rows = alleles(spark, sf_dir).select("chrom", (F.col("pos") * 10).alias("pos"), F.repeat("ref", (1 + F.col("pos") % 4).cast("int")).alias("ref"), F.lit("A").alias("alt"))
    reads = views.lines(spark, sf_dir).select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + 49).alias("stop"), F.lit(0).alias("dir"))
    return pileup.exact_coverage(rows, reads).select("chrom", "pos", "ref", F.get("spanning", 0).alias("spanning"))


@query("""SELECT id, line, CAST(trunc(CASE WHEN least THEN least(f1, f2) ELSE (f1 + f2) / 2.0 END) AS BIGINT) AS forward, CAST(trunc(CASE WHEN least THEN least(r1, r2) ELSE (r1 + r2) / 2.0 END) AS BIGINT) AS reverse, CAST(trunc(CASE WHEN least THEN least(f1, f2) + least(r1, r2) ELSE (f1 + f2) / 2.0 + (r1 + r2) / 2.0 END) AS BIGINT) AS total
FROM (SELECT l_orderkey AS id, l_linenumber AS line, l_linenumber % 2 = 0 AS least, l_partkey % 50 + (l_suppkey % 7 + 1) // 2 AS f1, l_suppkey % 40 + (l_suppkey % 7) // 2 AS r1, l_orderkey % 30 + (l_partkey % 9 + 1) // 2 AS f2, l_partkey % 20 + (l_partkey % 9) // 2 AS r2 FROM lineitem) x""")
def span_coverage(spark, sf_dir):
    c = F.col
    start, end = F.array(c("l_partkey") % 50, c("l_suppkey") % 40, c("l_suppkey") % 7), F.array(c("l_orderkey") % 30, c("l_partkey") % 20, c("l_partkey") % 9)
    found = pileup.spanning_coverage(start, end, c("l_linenumber") % 2 == 0)
    return views.lines(spark, sf_dir).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), *[found[k].cast("long").alias(k) for k in ("forward", "reverse", "total")])


@query(f"SELECT chrom, pos, ref FROM (SELECT chrom, pos, repeat(ref, CAST(1 + pos % 4 AS INT)) AS ref FROM ({ALLELES_SQL}) a) p WHERE EXISTS (SELECT 1 FROM ({INTERVALS_SQL}) i WHERE p.pos <= i.stop AND p.pos + length(p.ref) - 1 >= i.start)")
def roi_by_overlap(spark, sf_dir):
    rows = alleles(spark, sf_dir).select("chrom", "pos", F.repeat("ref", (1 + F.col("pos") % 4).cast("int")).alias("ref"))
    return intervals.touching(rows, views.intervals(spark, sf_dir)).select("chrom", "pos", "ref")


# -- statistics -------------------------------------------------------------------


@query(f"""SELECT chrom, pos, round(-10 * log10((power(10.0::DOUBLE, -(dp % 40) / 10.0::DOUBLE) + power(10.0::DOUBLE, -(ad % 40) / 10.0::DOUBLE)) / 2), 4) AS noise, round(CASE WHEN rd <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, ad::DOUBLE / rd)) END, 6) AS weight FROM ({ALLELES_SQL}) a""")
def combined_statistics(spark, sf_dir):
    return alleles(spark, sf_dir).select(
        "chrom", "pos", F.round(pools.combined_noise((F.col("dp") % 40).cast("double"), (F.col("ad") % 40).cast("double")), 4).alias("noise"),
        F.round(stats.unanchored_weight(F.col("ad").cast("double"), F.col("rd").cast("double")), 6).alias("weight"),
    )


_T = "(avg_a - avg_b) / (sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) * sqrt(1.0 / n_a + 1.0 / n_b))"
_BY_POOL = ", ".join(f"avg(l_quantity) FILTER (WHERE l_suppkey % 2 = {i}) AS avg_{x}, var_samp(l_quantity) FILTER (WHERE l_suppkey % 2 = {i}) AS var_{x}, count(*) FILTER (WHERE l_suppkey % 2 = {i}) AS n_{x}" for i, x in enumerate("ab"))


@query(f"SELECT l_linenumber AS line, round({_T}, 5) AS t, round((ln(0.99::DOUBLE / 0.5) + ln(0.8::DOUBLE / 0.2) / (n_a + n_b)) / (ln(0.5::DOUBLE / 0.01) + ln(0.99::DOUBLE / 0.5)), 8) AS crossing FROM (SELECT l_linenumber, {_BY_POOL} FROM lineitem GROUP BY l_linenumber) x")
def two_populations(spark, sf_dir):
    c = F.col
    pool = lambda f, x: f(F.when(c("l_suppkey") % 2 == x, c("l_quantity")))
    rows = views.lines(spark, sf_dir).groupBy(c("l_linenumber").alias("line")).agg(*[pool(f, x).alias(f"{n}_{x}") for x in (0, 1) for n, f in (("avg", F.avg), ("var", F.var_samp), ("n", F.count))])
    t = stats.pooled_t(c("avg_0"), c("var_0"), c("n_0"), c("avg_1"), c("var_1"), c("n_1"))
    return rows.select("line", F.round(t, 5).alias("t"), F.round(stats.crossing_frequency(c("n_0") + c("n_1"), 0.01, 0.5, 0.8, 0.2), 8).alias("crossing"))


@query(f"SELECT chrom, pos, ad_a, ad_b, kind FROM (SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.ad, 0)::BIGINT AS ad_a, coalesce(b.ad, 0)::BIGINT AS ad_b, CASE WHEN a.pos IS NULL OR b.pos IS NULL THEN 'cannot_combine' ELSE 'same_alternate' END AS kind FROM ({pool_sql(0)}) a FULL OUTER JOIN ({pool_sql(1)}) b ON a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt) x")
def pool_pairs(spark, sf_dir):
    rows = pools.paired(*two_pools(spark, sf_dir))
    n = lambda s: F.coalesce(F.col(f"{s}.ad"), F.lit(0).cast("long")).alias(f"ad_{s}")
    kind = pools.comparison(F.lit(False), F.lit(False), F.col("a").isNotNull(), F.col("b").isNotNull(), F.col("a.alt") == F.col("b.alt"))
    return rows.select("chrom", "pos", n("a"), n("b"), kind.alias("kind"))


@query(f"SELECT chrom, pos, CAST(greatest(n_a, 0) AS BIGINT) AS n_a, CAST(greatest(n_b, 0) AS BIGINT) AS n_b FROM (SELECT coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT chrom, pos, count(*) AS n FROM ({pool_sql(0)}) x GROUP BY 1, 2) a FULL OUTER JOIN (SELECT chrom, pos, count(*) AS n FROM ({pool_sql(1)}) y GROUP BY 1, 2) b ON a.chrom = b.chrom AND a.pos = b.pos) z")
def pool_loci(spark, sf_dir):
    return pools.loci(*two_pools(spark, sf_dir)).select("chrom", "pos", "n_a", "n_b")


# -- indels -----------------------------------------------------------------------

SIGHTED_SQL = """SELECT l_returnflag AS chrom, l_partkey % 500 AS pos, l_linenumber AS n, count(*) AS obs, sum(l_linenumber + l_suppkey % 9) AS l, sum(8 + l_partkey % 6) AS r, sum(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS mess, sum(CAST(l_quantity AS INT) * 4) AS quality,
  sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS fwd, sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) AS rev, sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS st, sum(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END) AS rep
FROM lineitem WHERE l_quantity < 10 GROUP BY 1, 2, 3"""


def _sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, one = F.col, lambda x: x.cast("int")
    line = views.lines(spark, sf_dir).filter("l_quantity < 10")
    return line.select(
        c("l_returnflag").alias("chrom"), (c("l_partkey") % 500).alias("pos"), F.lit("A").alias("ref"), F.concat(F.lit("A"), F.repeat(F.lit("C"), c("l_linenumber"))).alias("alt"), (c("l_linenumber") + c("l_suppkey") % 9).alias("left"), (8 + c("l_partkey") % 6).alias("right"),
        one(c("l_quantity") < 3).alias("mess"), (c("l_quantity").cast("int") * 4).alias("quality"), one(c("l_linestatus") == "F").alias("forward"), one(c("l_linestatus") != "F").alias("reverse"), one(c("l_linenumber") == 7).alias("stitched"), one(c("l_tax") > 0.04).alias("reputable"), F.lit(0).alias("repeat"), F.lit(0).alias("mate_unmapped"),
    )


@query(f"SELECT chrom, pos, CAST(n AS BIGINT) AS n, obs AS observations, CAST(l AS BIGINT) AS left_sum, CAST(r AS BIGINT) AS right_sum, CAST(mess AS BIGINT) AS mess, CAST(quality AS BIGINT) AS quality FROM ({SIGHTED_SQL}) s")
def indel_evidence(spark, sf_dir):
    found = realign.evidence(_sighted(spark, sf_dir))
    return found.select("chrom", "pos", (F.length("alt") - 1).cast("long").alias("n"), "observations", F.col("left").alias("left_sum"), F.col("right").alias("right_sum"), "mess", "quality")


@query(f"""SELECT chrom, pos, CAST(n AS BIGINT) AS n, CAST(greatest(0, trunc(round(obs * (1 / balance) * (1 / anchors) * (1 + rep::DOUBLE / obs + (st::DOUBLE / obs) / balance) * (quality::DOUBLE / obs / 30) * clean * 10, 6))) * (1 + n // 5) AS BIGINT) AS score FROM (
  SELECT *, CASE WHEN fwd >= rev THEN (fwd::DOUBLE / obs) / greatest(1.0, rev::DOUBLE / obs) ELSE (rev::DOUBLE / obs) / greatest(1.0, fwd::DOUBLE / obs) END AS balance, greatest(l, r)::DOUBLE / greatest(1, least(l, r)) AS anchors, ((l + r) // obs - mess::DOUBLE / obs) / ((l + r) // obs) AS clean FROM ({SIGHTED_SQL}) s) x""")
def indel_scores(spark, sf_dir):
    found = realign.evidence(_sighted(spark, sf_dir)).withColumn("score", realign.score())
    return found.select("chrom", "pos", (F.length("alt") - 1).cast("long").alias("n"), "score")


@query("SELECT l_orderkey AS id, l_linenumber AS line, CAST(-2 * (l_suppkey % 5) - 3 * (l_partkey % 3) - l_linenumber AS BIGINT) AS score FROM lineitem")
def alignment_scores(spark, sf_dir):
    c = F.col
    return views.lines(spark, sf_dir).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), realign.alignment_score(c("l_suppkey") % 5, c("l_partkey") % 3, c("l_linenumber"), c("l_partkey")).cast("long").alias("score"))


EDGE_SQL = f"""WITH loci AS (SELECT *, pos % 8 >= 5 AS edge FROM ({ALLELES_SQL}) a), t AS (SELECT count(*) AS loci, count(*) FILTER (WHERE edge) AS edge_loci, count(*) FILTER (WHERE ad > 0) AS all_n, count(*) FILTER (WHERE edge AND ad > 0) AS edge_n FROM loci),
r AS (SELECT *, (edge_n - (all_n - edge_n)::DOUBLE / (loci - edge_loci) * edge_loci) / edge_n AS risk FROM t)
SELECT ref || '>' || alt AS category, count(*) AS n, CASE WHEN risk > 0 THEN CAST(trunc(-10 * log10(count(*)::DOUBLE / edge_n * risk)) AS BIGINT) END AS rate_q FROM loci, r WHERE edge AND ad > 0 GROUP BY ref, alt, risk, edge_n"""


@query(EDGE_SQL)
def edge_error_rates(spark, sf_dir):
    rows = alleles(spark, sf_dir).withColumn("edge", F.col("pos") % 8 >= 5)
    return recalibrate.edge_rates(rows, F.col("ad") > 0).select("category", "n", F.col("rate_q").cast("long").alias("rate_q"))


# -- files ------------------------------------------------------------------------


@query(f"SELECT chrom, pos, ref, alt, CAST(dp AS BIGINT) AS dp, vq::DOUBLE AS qual, {SOMATIC_SQL} AS gt FROM ({CALLS_SQL}) c")
def calls_written_and_read(spark, sf_dir):
    rows = pipelines.call_somatic(views.obs(spark, sf_dir)).withColumns({"noise_q": F.lit(20), "sb_scaled": F.col("sb.scaled")})
    lines = records.lines(rows).join(rows.select("chrom", "pos", "ref", "alt"), ["chrom", "pos"])
    path, header = scratch(spark), ["##fileformat=VCFv4.1", *[f"##contig=<ID={c}>" for c in "RNA"], "#CHROM\tPOS"]
    text.write_calls(lines, header, path)
    back = text.read_calls(spark, f"{path}/*")
    return back.select("chrom", "pos", "ref", "alt", F.col("info")["DP"].cast("long").alias("dp"), "qual", F.col("sample")["GT"].alias("gt"))


@query(f"SELECT category, n::DOUBLE AS n FROM (SELECT ref || '>' || alt AS category, count(*) AS n FROM ({ALLELES_SQL}) a WHERE ad > 0 GROUP BY ref, alt) s")
def counts_written_and_read(spark, sf_dir):
    path = scratch(spark)
    text.write_counts(recalibrate.spectrum(alleles(spark, sf_dir).filter("ad > 0")), path)
    return text.read_counts(spark, path)


@query("SELECT 'chr' || p_size AS chrom, p_partkey AS start, p_partkey + p_size AS stop FROM part WHERE p_size > 0")
def intervals_written_and_read(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = scratch(spark)
    lines = part.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size")).cast("string"), F.lit("+"), F.lit("name")).alias("value"))
    spark.createDataFrame([("@HD\tVN:1",), ("chr0\t9\t3\t+\tbackward",)], "value string").union(lines.filter("value not like 'chr0%'")).write.text(path)
    return text.read_intervals(spark, path)


@query(f"SELECT DISTINCT chrom, pos, ref, alt FROM ({ALLELES_SQL}) a")
def forced_written_and_read(spark, sf_dir):
    rows = alleles(spark, sf_dir)
    path = scratch(spark)
    rows.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lower("ref"), F.concat(F.lower("alt"), F.lit(","), F.col("alt"), F.lit(",<M>")), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.lit("0/1")).alias("value")).write.text(path)
    return text.read_forced(spark, path)
