"""Requalifying calls whose kind of substitution occurs suspiciously often."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions import stats
from varigrid.operators import blocks

BASES = "ACGT"
#: The twelve substitutions, in alphabetical order.
CLASSES = [f"{a}>{b}" for a in BASES for b in BASES if a != b]


def category(ref: Column, alt: Column) -> Column:
    """A>C and so on for substitutions; insertion, deletion, reference, other."""
    r, a = F.length(ref), F.length(alt)
    one = (r == 1) & (a == 1) & ref.isin(*BASES) & alt.isin(*BASES)
    return (
        F.when((alt == ".") | (alt == ref), "reference").when(one, F.concat(ref, F.lit(">"), alt))
        .when((r == 1) & (a > 1), "insertion").when((a == 1) & (r > 1), "deletion").otherwise("other")
    )


def spectrum(calls: DataFrame) -> DataFrame:
    """(category, n) of calls (ref, alt)."""
    return calls.groupBy(category(F.col("ref"), F.col("alt")).alias("category")).agg(F.count("*").alias("n"))


def suspicious(counts: DataFrame, loci: Column, base_q: int = 20, z: float = 2.0) -> DataFrame:
    """(category, n, cutoff, suspicious, rate_q) of the twelve substitutions.

    The two lowest and two highest counts are left out of mean and deviation; a
    class above mean + z deviations is suspicious and its quality is that of its
    rate and the base error together, cut off to a whole number.
    """
    spark = counts.sparkSession
    every = spark.createDataFrame([(c,) for c in CLASSES], "category string")
    # twelve rows from here on
    full = every.join(F.broadcast(counts), "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = full.withColumn("r", F.row_number().over(Window.orderBy("n", "category")))
    middle = ranked.filter(F.col("r").between(3, 10)).agg((F.avg("n") + z * F.sqrt(F.var_pop("n"))).alias("cutoff"))
    rate = F.col("n") / loci + stats.q_to_p(F.lit(float(base_q)))
    return full.crossJoin(F.broadcast(middle)).select("category", "n", "cutoff", (F.col("n") > F.col("cutoff")).alias("suspicious"), stats.p_to_q(rate).cast("int").alias("rate_q"))


def requalified(calls: DataFrame, suspects: DataFrame, max_q: int = 100, q_filter: int = 30) -> DataFrame:
    """Calls (ref, alt, ad, dp, vq, filters) with the quality that a suspicious class's rate leaves them."""
    few = suspects.filter("suspicious").select(F.col("category").alias("_category"), F.col("rate_q").alias("_rate"))  # at most twelve rows
    joined = calls.join(F.broadcast(few), category(F.col("ref"), F.col("alt")) == F.col("_category"), "left")
    # reads beyond what the rate can tell apart don't count
    most = F.floor(1.0 / stats.q_to_p(F.col("_rate").cast("double")))
    dp = F.least(F.col("dp"), most)
    ad = F.when(F.col("dp") > most, (F.col("ad") * most / F.col("dp")).cast("int")).otherwise(F.col("ad"))
    q = F.least(F.col("vq"), stats.variant_q(ad, dp, F.col("_rate"), max_q))
    new = F.when(F.col("_rate").isNull(), F.col("vq")).otherwise(q)
    tag = F.when(F.col("_rate").isNotNull() & (new < q_filter) & ~F.array_contains("filters", f"q{q_filter}"), F.array(F.lit(f"q{q_filter}"))).otherwise(F.array().cast("array<string>"))
    return joined.withColumns({"new_q": new.cast("int"), "new_filters": F.concat("filters", tag)}).drop("_category", "_rate")


def edges(loci: DataFrame, extent: int = 4) -> DataFrame:
    """Adds ``edge`` to loci (chrom, pos, dp): whether coverage ends or drops by half within ``extent`` rows.

    Rows count in order of position; a missing neighbour, a gap in positions,
    or half the coverage and less on either side makes an edge.
    """
    # a neighbour beyond ``extent`` places makes an edge wherever it is, so blocks need no more of each other
    near = blocks.with_halo(loci, "pos", extent)
    order = Window.partitionBy("chrom", "block").orderBy("pos")
    risk = F.lit(False)
    for k in range(1, extent + 1):
        for shift, far in ((F.lag, lambda p, k=k: F.col("pos") - p > k), (F.lead, lambda p, k=k: p - F.col("pos") > k)):
            pos, dp = shift("pos", k).over(order), shift("dp", k).over(order)
            risk = risk | pos.isNull() | far(pos) | (dp < 0.5 * F.col("dp"))
    return near.withColumn("edge", F.when(F.col("dp") == 0, False).otherwise(risk)).filter(~F.col("halo")).drop("block", "halo")


def edge_rates(loci: DataFrame, called: Column | None = None) -> DataFrame:
    """(category, n, rate_q): per kind of substitution its calls at edges, and the quality that their excess leaves it.

    Calls per locus away from edges say how many the edges should have.  What is
    beyond that is taken for error; a kind bears it in proportion to its
    calls.  Without an excess there is no rate.  ``called`` says which loci
    (ref, alt, edge) have a call, by default all.
    """
    rows = loci.withColumn("_called", F.lit(True) if called is None else called)
    t = rows.agg(F.count("*").alias("loci"), F.count_if("edge").alias("edge_loci"), F.count_if("_called").alias("all_n"), F.count_if(F.col("edge") & F.col("_called")).alias("edge_n"))
    inner = (F.col("all_n") - F.col("edge_n")) / F.nullif(F.col("loci") - F.col("edge_loci"), F.lit(0))
    risk = t.select("edge_n", ((F.col("edge_n") - inner * F.col("edge_loci")) / F.nullif(F.col("edge_n"), F.lit(0))).alias("risk"))  # one row
    kinds = rows.filter("edge and _called").groupBy(category(F.col("ref"), F.col("alt")).alias("category")).agg(F.count("*").alias("n"))
    q = F.when(F.col("risk") > 0, stats.p_to_q(F.col("n") / F.col("edge_n") * F.col("risk")).cast("int"))
    return kinds.crossJoin(F.broadcast(risk)).select("category", "n", q.alias("rate_q"))
