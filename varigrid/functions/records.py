"""Call records as text: INFO and FORMAT, genotypes, filters, whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Record lines to columns; INFO and the sample's fields as maps.  Header lines go; missing fields are null."""
    f = F.split(value, "\t")
    at = lambda i: F.when(F.get(f, F.lit(i)) != ".", F.get(f, F.lit(i)))
    rows = lines.filter(~F.col(value).startswith("#") & (F.length(value) > 0))
    return rows.select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("pos"), at(2).alias("id"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"),
        at(5).cast("double").alias("qual"), F.when(F.get(f, F.lit(6)).isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(F.get(f, F.lit(6)), ";")).alias("filters"),
        F.when(at(7).isNull(), F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(at(7), F.lit(";"), F.lit("="))).alias("info"),
        F.map_from_arrays(F.split(F.get(f, F.lit(8)), ":"), F.slice(F.concat(F.split(F.get(f, F.lit(9)), ":"), F.array_repeat(F.lit(None).cast("string"), F.size(F.split(F.get(f, F.lit(8)), ":")))), 1, F.size(F.split(F.get(f, F.lit(8)), ":")))).alias("sample"),
    )


def uncrushed(rows: DataFrame) -> DataFrame:
    """One row for each ALT of a record, with its own depth; a placeholder ALT goes.

    AD lists the reference first where it has one more entry than there are ALTs.
    """
    alts = F.split("alt", ",")
    many = rows.select("*", F.posexplode(alts).alias("alt_index", "_alt"), F.size(alts).alias("_n")).filter("_alt <> '<M>'")
    ad = F.split(F.col("sample")["AD"], ",")
    own = F.when(F.size(ad) > F.col("_n"), F.get(ad, F.col("alt_index") + 1)).otherwise(F.get(ad, F.col("alt_index")))
    return many.withColumns({"alt": F.col("_alt"), "ad": own.cast("long"), "dp": F.col("sample")["DP"].cast("long")}).drop("_alt", "_n")


def crushed(rows: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alt, ad, dp, filters): co-located alleles (chrom, pos, ref, alt, ad, dp, filters) in one row.

    The longest REF stands for all; an allele with a shorter one gets its missing end.
    """
    loci = rows.groupBy("chrom", "pos").agg(
        F.max_by("ref", F.struct(F.length("ref"), "ref")).alias("_ref"), F.array_sort(F.collect_list(F.struct("ref", "alt", "ad"))).alias("_all"),
        F.max("dp").alias("_dp"), F.sum("ad").alias("_ad"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("filters")))).alias("filters"),
    )
    padded = F.transform("_all", lambda x: F.concat(x["alt"], F.substring("_ref", F.length(x["ref"]) + 1, F.length("_ref"))))
    return loci.select("chrom", "pos", F.col("_ref").alias("ref"), F.array_join(padded, ",").alias("alt"), F.array_join(F.transform("_all", lambda x: x["ad"].cast("string")), ",").alias("ad"), F.greatest("_dp", "_ad").alias("dp"), "filters")


def filter_text(filters: Column) -> Column:
    return F.when(F.size(filters) == 0, "PASS").otherwise(F.array_join(filters, ";"))


def filter_kind(name: Column) -> Column:
    """What a filter's name means; qN, RN and RMxN carry numbers."""
    low = F.lower(name)
    return (
        F.when(low.rlike(r"^q\d+$"), "low_quality").when(low.rlike(r"^r\d+$"), "indel_repeat").when(low.rlike(r"^r\d+x\d+$"), "repeat")
        .when(low.isin("lowdp", "lowdepth", "ld"), "low_depth").when(low == "lowgq", "low_genotype_quality").when(low == "sb", "strand_bias").when(low == "pb", "pool_bias").when(low == "ab", "amplicon_bias")
        .when(low == "nc", "no_call").when(low.isin("lowvariantfreq", "lowfreq"), "low_frequency").when(low == "multiallelicsite", "multi_allelic").when(low == "forcedreport", "forced").otherwise("unknown")
    )


def genotype_kind(gt: Column) -> Column:
    """What a genotype text means; phased ones as unphased."""
    g = F.replace(gt, F.lit("|"), F.lit("/"))
    names = {"0/0": "hom_ref", "0/1": "het", "1/1": "hom_alt", "1/2": "het_alts", "./.": "no_call", "0/.": "ref_and_no_call", "1/.": "alt_and_no_call", "0": "hemi_ref", "1": "hemi_alt", ".": "hemi_no_call"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), g), F.lit("other"))


def umi_counts(value: Column) -> Column:
    """Struct of support and coverage, arrays of a collapsed read's 8 kinds, from a tag of 8 or 12 whole numbers:
    8 are support alone, of 12 the last four are coverage by duplex and strand."""
    numbers = F.transform(F.split(value, ","), lambda x: x.cast("int"))
    return F.struct(F.slice(numbers, 1, 8).alias("support"), F.when(F.size(numbers) > 8, F.slice(numbers, 9, 4)).otherwise(F.array().cast("array<int>")).alias("coverage"))


def digits(min_frequency: float) -> int:
    """Decimals that a frequency of at least so much is written with."""
    text = f"{min_frequency:.10f}".rstrip("0")
    return max(1, len(text.split(".")[1])) + 1


def lines(calls: DataFrame, min_frequency: float = 0.01) -> DataFrame:
    """(chrom, pos, line) of calls (chrom, pos, ref, alt, dp, ad, rd, vf, vq, gq, genotype, filters, noise_q, sb_scaled)."""
    is_ref = F.col("alt").isin(".") | (F.col("alt") == F.col("ref"))
    vf = F.format_string(f"%.{digits(min_frequency)}f", F.when(is_ref, 1 - F.col("vf").cast("double")).otherwise(F.col("vf").cast("double")))
    sb = F.format_string("%.4f", F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("sb_scaled"))))
    ad = F.when(is_ref, F.col("rd").cast("string")).otherwise(F.concat_ws(",", "rd", "ad"))
    sample = F.concat_ws(":", "genotype", F.col("gq").cast("string"), ad, F.col("dp").cast("string"), vf, F.col("noise_q").cast("string"), sb)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.when(is_ref, ".").otherwise(F.col("alt")), F.col("vq").cast("string"), filter_text(F.col("filters")), F.concat(F.lit("DP="), F.col("dp").cast("string")), F.lit("GT:GQ:AD:DP:VF:NL:SB"), sample)
    return calls.select("chrom", "pos", line.alias("line"))


def sample_name(path: Column) -> Column:
    """The sample of a file named like ``name_S1.genome.vcf.gz``."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^(.+)_S\d+.*\.vcf(?:\.gz)?$", 1)
