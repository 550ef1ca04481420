"""Line formats: call records, intervals, reference sequences, count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.functions import records


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Call records, one row a line; compressed files are read as they are."""
    return records.parsed(spark.read.text(path))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The ``#`` lines that begin a file of call records."""
    return [r["value"] for r in spark.read.text(path).filter(F.col("value").startswith("#")).collect()]


def contig_order(header: list[str]) -> dict[str, int]:
    """Rank of each contig in the order that the header gives."""
    names = [line.split("ID=")[1].split(",")[0].rstrip(">") for line in header if line.startswith("##contig=") and "ID=" in line]
    return {n: i for i, n in enumerate(names)}


def in_order(calls: DataFrame, contigs: dict[str, int]) -> DataFrame:
    """Calls by contig as ranked, others after them by name, then by place and alleles."""
    rank = F.create_map(*[F.lit(x) for kv in contigs.items() for x in kv]) if contigs else None
    order = F.coalesce(F.element_at(rank, F.col("chrom")), F.lit(len(contigs))) if contigs else F.lit(0)
    extra = [c for c in ("ref", "alt") if c in calls.columns]
    return calls.orderBy(order, "chrom", "pos", *extra)


def write_calls(calls: DataFrame, header: list[str], path: str, contigs: dict[str, int] | None = None) -> None:
    """Write (chrom, pos, line) as text in order: a range sort, so parts in name order are the file; the header is part of its own."""
    spark = calls.sparkSession
    in_order(calls, contigs or contig_order(header)).select("line").write.mode("overwrite").text(f"{path}/records")
    spark.createDataFrame([(h,) for h in header], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop) of a tab-separated file, both ends included; ``@`` lines are skipped."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long", comment="@")
    return rows.filter("start is not null and stop >= start")


def read_forced(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt) of alleles to report in any case, in upper case, each once."""
    rows = read_calls(spark, path).select("chrom", "pos", F.upper("ref").alias("ref"), F.explode(F.split(F.upper("alt"), ",")).alias("alt"))
    return rows.filter(F.col("alt").rlike("^[ACGT]+$") & (F.col("ref") != F.col("alt"))).distinct()


def read_fasta(spark: SparkSession, path: str, block: int = 1000) -> DataFrame:
    """(contig, start, bases): the reference in upper case, cut in blocks of ``block`` bases, 1-based.

    Lines keep their order by their place in the file.  Line lengths are summed
    per contig, and each line is cut where blocks end.
    """
    text = spark.read.text(path).withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    order = Window.orderBy("_at")
    heads = text.filter(F.col("value").startswith(">")).select("_at", F.regexp_extract("value", r"^>(\S+)", 1).alias("contig"))
    heads = heads.withColumn("_next", F.lead("_at").over(order))  # one row a contig
    lines = text.filter(~F.col("value").startswith(">") & (F.length("value") > 0))
    named = lines.join(F.broadcast(heads.withColumnRenamed("_at", "_from")), (F.col("_at") > F.col("_from")) & (F.col("_next").isNull() | (F.col("_at") < F.col("_next"))))
    along = Window.partitionBy("contig").orderBy("_at")
    placed = named.select("contig", "_at", F.upper("value").alias("v"), (F.sum(F.length("value")).over(along) - F.length("value")).alias("off"))
    pieces = placed.withColumn("b", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.length("v") - 1) / block))))
    lo, hi = F.greatest("off", F.col("b") * block), F.least(F.col("off") + F.length("v"), (F.col("b") + 1) * block)
    cut = pieces.select("contig", "b", lo.alias("lo"), F.substring("v", (lo - F.col("off") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = cut.groupBy("contig", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "part"))), lambda x: x["part"]), "").alias("bases"))
    return whole.select("contig", (F.col("b") * block + 1).alias("start"), "bases")


def contig_sizes(reference: DataFrame) -> DataFrame:
    """(contig, length, known): bases of each contig and those that aren't N, from blocks."""
    return reference.groupBy("contig").agg(F.sum(F.length("bases")).alias("length"), F.sum(F.length(F.replace(F.col("bases"), F.lit("N"), F.lit("")))).alias("known"))


def context(rows: DataFrame, reference: DataFrame, flank: int, block: int = 1000) -> DataFrame:
    """Adds ``context`` and ``context_start``: the reference ``flank`` bases either side of rows (chrom, pos), from at most three blocks."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    lo, hi = F.greatest(F.lit(1).cast("long"), F.col("pos") - flank), F.col("pos") + flank
    need = keyed.select("_row", "chrom", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.floor((lo - 1) / block), F.floor((hi - 1) / block))).alias("_b"))
    met = need.join(reference.select(F.col("contig").alias("chrom"), F.floor((F.col("start") - 1) / block).alias("_b"), "start", "bases"), ["chrom", "_b"])
    part = F.substring("bases", (F.greatest("lo", "start") - F.col("start") + 1).cast("int"), (F.least(F.col("hi"), F.col("start") + F.length("bases") - 1) - F.greatest("lo", "start") + 1).cast("int"))
    joined = met.groupBy("_row").agg(F.min("lo").alias("context_start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", part.alias("p")))), lambda x: x["p"]), "").alias("context"))
    return keyed.join(joined, "_row", "left").drop("_row")


def write_counts(counts: DataFrame, path: str) -> None:
    """(category, n) as tab-separated lines."""
    counts.select("category", "n").orderBy("category").coalesce(1).write.mode("overwrite").csv(path, sep="\t")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="category string, n double").filter("n is not null")


def write_strand_bias(calls: DataFrame, path: str) -> None:
    """A tab-separated line per call (chrom, pos, ref, alt, ad_by_dir, dp_by_dir, sb): both strands' counts, the score and what it says."""
    by = lambda c, i: F.get(c, F.lit(i)).alias(f"{c}_{i}")
    flat = calls.select("chrom", "pos", "ref", "alt", *[by(c, i) for c in ("ad_by_dir", "dp_by_dir") for i in range(3)], F.col("sb.score").alias("score"), F.col("sb.both").alias("both"), F.col("sb.acceptable").alias("acceptable"))
    flat.orderBy("chrom", "pos", "ref", "alt").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_amplicon_bias(counts: DataFrame, path: str) -> None:
    """A line per call and amplicon (chrom, pos, amplicon, coverage, support)."""
    counts.select("chrom", "pos", "amplicon", "coverage", "support").orderBy("chrom", "pos", "amplicon").write.mode("overwrite").csv(path, sep="\t", header=True)


def read_edge_variants(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt) of a list of alleles at amplicon edges."""
    return spark.read.csv(path, sep="\t", schema="chrom string, pos long, id string, ref string, alt string").filter("pos is not null").drop("id")


def write_outcomes(scored: DataFrame, path: str) -> None:
    """How many indels of each length had each outcome, a column an outcome."""
    length = F.length("alt") - F.length("ref")
    table = scored.groupBy(length.alias("length")).pivot("outcome", ["kept", "rescued", "low_observations", "poor_anchor", "messy"]).count().na.fill(0)
    table.orderBy("length").coalesce(1).write.mode("overwrite").csv(path, header=True)
