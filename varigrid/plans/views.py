"""Base observations, alleles, pools and intervals derived from the order tables.

The tables hold no reads.  These views turn order lines into base observations
by plain expressions: a locus is ten neighbouring part keys, a read an order,
and base, quality and direction follow from the line's columns, so that loci of
all kinds occur (none, low, heterozygous, homozygous, one-stranded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Qualities below this make a base unknown.
MIN_BASE_Q = 20

OBS_SQL = f"""
SELECT chrom, pos, ref, alt, dir, q, amplicon, read, pool,
       CASE WHEN q < {MIN_BASE_Q} THEN 'N'
            WHEN (supp * 31 + read) % 100 < pct AND (pos % 5 <> 0 OR dir = 0) THEN alt
            ELSE ref END AS base
FROM (
  SELECT *, substr('ACGT', CAST(1 + pos % 4 AS INT), 1) AS ref,
         substr('ACGT', CAST(1 + (pos + 1 + pos % 3) % 4 AS INT), 1) AS alt,
         CASE pos % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 25
                      WHEN 4 THEN 45 WHEN 5 THEN 60 WHEN 6 THEN 90 ELSE 100 END AS pct
  FROM (
    SELECT l_returnflag AS chrom, CAST(floor(l_partkey / 10) AS BIGINT) + 1 AS pos, l_orderkey AS read, l_suppkey AS supp,
           l_suppkey % 2 AS pool, l_linenumber AS amplicon, CAST(l_quantity AS INT) AS q,
           CASE WHEN l_linenumber = 7 THEN 2 WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS dir
    FROM lineitem) b) v"""

ALLELES_SQL = f"""
SELECT chrom, pos, ref, alt,
       sum(CASE WHEN base <> 'N' THEN 1 ELSE 0 END) AS dp, sum(CASE WHEN base = alt THEN 1 ELSE 0 END) AS ad,
       sum(CASE WHEN base = ref THEN 1 ELSE 0 END) AS rd, sum(CASE WHEN base = 'N' THEN 1 ELSE 0 END) AS nc
FROM ({OBS_SQL}) o GROUP BY chrom, pos, ref, alt"""

INTERVALS_SQL = """
SELECT p_partkey AS id, CAST(floor(p_partkey / 10) AS BIGINT) + 1 AS start, CAST(floor(p_partkey / 10) AS BIGINT) + 1 + p_size % 20 AS stop
FROM part WHERE p_partkey % 37 = 0"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per base of a read: chrom, pos, ref, alt, dir, q, amplicon, read, pool, base."""
    rows = lines(spark, sf_dir).select(
        F.col("l_returnflag").alias("chrom"),
        (F.floor(F.col("l_partkey") / 10) + 1).cast("long").alias("pos"),
        F.col("l_orderkey").alias("read"),
        F.col("l_suppkey").alias("supp"),
        (F.col("l_suppkey") % 2).alias("pool"),
        F.col("l_linenumber").alias("amplicon"),
        F.col("l_quantity").cast("int").alias("q"),
        F.when(F.col("l_linenumber") == 7, 2).when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("dir"),
    )
    pos = F.col("pos")
    percent = F.get(F.array(*[F.lit(x) for x in (0, 1, 5, 25, 45, 60, 90, 100)]), (pos % 8).cast("int"))
    rows = rows.select(
        "*",
        F.substring(F.lit("ACGT"), (1 + pos % 4).cast("int"), F.lit(1)).alias("ref"),
        F.substring(F.lit("ACGT"), (1 + (pos + 1 + pos % 3) % 4).cast("int"), F.lit(1)).alias("alt"),
        percent.alias("pct"),
    )
    carries = ((F.col("supp") * 31 + F.col("read")) % 100 < F.col("pct")) & ((pos % 5 != 0) | (F.col("dir") == 0))
    base = F.when(F.col("q") < MIN_BASE_Q, "N").when(carries, F.col("alt")).otherwise(F.col("ref"))
    return rows.select("chrom", "pos", "ref", "alt", "dir", "q", "amplicon", "read", "pool", base.alias("base"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 37 = 0")
    start = (F.floor(F.col("p_partkey") / 10) + 1).cast("long")
    return parts.select(F.col("p_partkey").alias("id"), start.alias("start"), (start + F.col("p_size") % 20).alias("stop"))
