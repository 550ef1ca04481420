"""Which insertions and deletions reads may be realigned to, and where."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varigrid.functions.sequence import hamming
from varigrid.operators.summaries import with_reference

KEY = ["chrom", "pos", "ref", "alt"]


@dataclass(frozen=True)
class IndelOptions:
    found: int = 3
    anchor: int = 1
    mess: int = 20


def evidence(sightings: DataFrame) -> DataFrame:
    """Sums per indel (chrom, pos, ref, alt) of sightings in reads.

    A sighting has left and right (anchors), mess, quality, forward, reverse,
    stitched, reputable, repeat, mate_unmapped (0 or 1 each but the first four).
    """
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return sightings.groupBy(*KEY).agg(F.count("*").alias("observations"), *[n(c) for c in ("left", "right", "mess", "quality", "forward", "reverse", "stitched", "reputable", "repeat", "mate_unmapped")])


def score(e: dict[str, Column] | None = None) -> Column:
    """How well an indel's evidence speaks for it: more reads, on both strands, well anchored, of quality; whole numbers at three steps.

    Strands count as shares of the reads, anchors as sums.  What mess leaves of the
    mean anchor, cut off to a whole number, weighs in.
    """
    c = e or {k: F.col(k) for k in ("observations", "left", "right", "mess", "quality", "forward", "reverse", "stitched", "reputable", "repeat", "mate_unmapped", "ref", "alt")}
    obs = c["observations"].cast("double")
    side = lambda a, b: F.greatest(a, b) / F.greatest(F.lit(1.0), F.least(a, b))
    balance = side(c["forward"] / obs, c["reverse"] / obs)
    anchored = side(c["left"].cast("double"), c["right"].cast("double"))
    anchor = F.floor((c["left"] + c["right"]) / obs)
    clean = (anchor - c["mess"] / obs) / anchor
    raw = obs * (1 / balance) * (1 / anchored) * (1 + c["reputable"] / obs + (c["stitched"] / obs) / balance) * (c["quality"] / obs / 30) * clean * 10
    length = F.abs(F.length(c["ref"]) - F.length(c["alt"]))
    whole = F.greatest(F.lit(0), F.floor(F.round(raw, 6))) * (1 + F.floor(length / 5)) * ((obs - c["mate_unmapped"] - c["repeat"]) / obs)
    return F.floor(whole).cast("long")


def kept(evidence_rows: DataFrame, options: IndelOptions = IndelOptions()) -> DataFrame:
    """Adds score and outcome to evidence: kept, rescued, or why not."""
    obs = F.col("observations")
    strong = (obs >= 5 * options.found) & (F.col("mess") <= obs)
    outcome = (
        F.when((obs >= options.found) & (F.least("left", "right") >= options.anchor * obs) & (F.col("mess") <= options.mess * obs), "kept")
        .when(strong, "rescued").when(obs < options.found, "low_observations").when(F.least("left", "right") < options.anchor * obs, "poor_anchor").otherwise("messy")
    )
    return evidence_rows.withColumns({"score": score(), "outcome": outcome})


def pruned(scored: DataFrame, reach: int = 10, ratio: int = 2) -> DataFrame:
    """Indels (chrom, pos, ref, alt, score) that no much stronger one within ``reach`` places outdoes.

    Neighbours meet in bins of ``reach``, each looked up in the bins beside it.
    """
    bins = scored.withColumn("_bin", F.floor(F.col("pos") / reach))
    rivals = bins.select("chrom", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin"), F.col("pos").alias("_pos"), F.col("score").alias("_score"))
    # of a bin's rivals only the strongest at each place can matter
    rivals = rivals.groupBy("chrom", "_bin", "_pos").agg(F.max("_score").alias("_score"))
    beaten = (bins["chrom"] == rivals["chrom"]) & (bins["_bin"] == rivals["_bin"]) & (F.abs(bins["pos"] - rivals["_pos"]) <= reach) & (rivals["_score"] > ratio * bins["score"])
    return bins.join(rivals, beaten, "left_anti").drop("_bin")


def nearest(reads: DataFrame, indels: DataFrame, distance: int = 250, most: int = 5) -> DataFrame:
    """(read, chrom, pos, indel_pos, ref, alt, score, rank): a read's best indels within ``distance``."""
    r = reads.withColumn("_bin", F.floor(F.col("pos") / distance))
    i = indels.select("chrom", F.col("pos").alias("indel_pos"), "ref", "alt", "score").withColumn("_bin", F.explode(F.sequence(F.floor((F.col("indel_pos") - distance) / distance), F.floor((F.col("indel_pos") + distance) / distance))))
    met = r.join(i, ["chrom", "_bin"]).filter(F.abs(F.col("indel_pos") - F.col("pos")) <= distance)
    order = Window.partitionBy("read", "chrom", "pos").orderBy(F.desc("score"), F.desc(F.abs(F.length("ref") - F.length("alt"))), "alt", "ref", "indel_pos")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("read", "chrom", "pos", "indel_pos", "ref", "alt", "score", "rank")


def bins(reads: DataFrame, width: int = 500) -> DataFrame:
    """(chrom, bin, n, messy, indel): reads (chrom, pos, stop, messy, indel) in each bin they touch."""
    touched = reads.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("stop") / width))))
    return touched.groupBy("chrom", "bin").agg(F.count("*").alias("n"), F.count_if("messy").alias("messy"), F.count_if("indel").alias("indel"))


def messy_bins(counts: DataFrame, mess: float = 0.03, indel: float = 0.01, depth: int = 5) -> DataFrame:
    """Adds ``usable`` to bins: enough depth, indels and mess there or in a bin beside."""
    own = ((F.col("messy") + F.col("indel")) / F.col("n") >= mess) & (F.col("indel") / F.col("n") >= indel) & (F.col("n") >= depth)
    rows = counts.withColumn("own", own)
    beside = rows.filter("own").select("chrom", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct().withColumn("usable", F.lit(True))
    return rows.join(beside, ["chrom", "bin"], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def alignment_score(mismatches: Column, indels: Column, clipped: Column, anchor: Column, weights: tuple[int, int, int, int] = (-2, -3, -1, 0)) -> Column:
    return weights[0] * mismatches + weights[1] * indels + weights[2] * clipped + weights[3] * anchor


def realigned(reads: DataFrame, candidates: DataFrame, reference: DataFrame, block: int = 1000) -> DataFrame:
    """(read, indel_pos, ref, alt, mismatches, original, accepted): each ungapped read tried with its best single indel.

    ``reads`` (read, chrom, pos, bases), ``candidates`` from ``nearest``, and
    ``reference`` (contig, start, bases) in blocks of ``block`` places, which reads meet by
    block number; a read beyond its reference is not tried.  The read's bases are laid against the reference with the indel
    put in, anchored at the left; the fewest mismatches win, and are
    accepted if they are fewer than without any indel.
    """
    n = F.length("bases")
    known = with_reference(reads.select("read", "chrom", "pos", "bases"), reference, F.col("pos"), F.col("pos") + 2 * n - 1, block)
    known = known.filter((F.col("context_start") == F.col("pos")) & (F.length("context") >= n))
    joined = candidates.drop("pos", "rank").join(known, ["read", "chrom"])
    plain = F.left("context", n)
    before = F.col("indel_pos") - F.col("pos") + 1  # bases up to the indel's anchor
    window = F.col("context")
    put_in = F.concat(F.left(window, (before - 1).cast("int")), F.col("alt"), F.substring(window, (before + F.length("ref")).cast("int"), 2 * n))
    tried = joined.filter((before >= 1) & (before < n)).withColumns({"mismatches": hamming(F.col("bases"), F.left(put_in, n)), "original": hamming(F.col("bases"), plain)})
    order = Window.partitionBy("read", "chrom").orderBy("mismatches", F.desc("score"), "indel_pos", "ref", "alt")
    best = tried.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return best.select("read", "indel_pos", "ref", "alt", "mismatches", "original", (F.col("mismatches") < F.col("original")).alias("accepted"))


def compared(a: Column, b: Column) -> Column:
    """1, 0 or -1 as alignment ``a`` (mismatches, clipped, indels) is better than ``b``, as good or worse.

    One mismatch and no indel beats several indels; else mismatches count first, then clipped bases, then indels.
    """
    plain = lambda x: (x["mismatches"] == 1) & (x["indels"] == 0)
    order = F.when(plain(a) & (b["indels"] > 1), 1).when(plain(b) & (a["indels"] > 1), -1)
    for c in ("mismatches", "clipped", "indels"):
        order = order.when(a[c] < b[c], 1).when(a[c] > b[c], -1)
    return order.otherwise(0)


# How many mismatches a realignment may make and leave, and how many it must save.
MADE, LEFT, SAVED = 1, 2, 3
SHORT_BASES, LONG_BASES = 3, 9


def improves(new: Column, old: Column) -> Column:
    """Whether a realignment ``new`` (mismatches, shared, indels, indel_bases, frequent) is to replace ``old`` (mismatches, indels, indel_bases).

    Mismatches include clipped bases; ``shared`` of them are also the old alignment's.  A clean one wins but for one
    indel in place of one mismatch.  Short indels must make none; long or frequent ones need to save one less.
    """
    saved, made = old["mismatches"] - new["mismatches"], new["mismatches"] - new["shared"]
    clean = F.when((new["indels"] == 1) & (old["mismatches"] == 1) & (old["indels"] == 0), False).otherwise((old["indels"] > 0) | (saved >= 1))
    short = (made <= MADE - 1) & (new["mismatches"] <= LEFT - 1) & (saved >= SAVED)
    preferred = (new["indel_bases"] - old["indel_bases"] >= LONG_BASES) | new["frequent"]
    other = (made <= MADE) & (new["mismatches"] <= LEFT) & ((saved >= SAVED) | (preferred & (saved >= SAVED - 1)))
    return F.when(new["mismatches"] == 0, clean).when(new["indel_bases"] <= SHORT_BASES, short).otherwise(other)


def pair_indels(first: Column, second: Column, specific: bool = True) -> Column:
    """The indels of both mates as one array; null if mates are realigned without regard to each other."""
    if not specific:
        return F.lit(None)
    empty = F.filter(F.coalesce(first, second), lambda _: F.lit(False))
    return F.concat(F.coalesce(first, empty), F.coalesce(second, empty))


def unshared(own: Column, other: Column) -> Column:
    """Those of a read's indels (before, after, kind, len, terminal) that its mate's don't hold.

    Deletions between the same places are one.  An insertion that differs in length from the mate's first
    one there is the same only if the shorter of them is at its read's end.
    """
    def held(x: Column) -> Column:
        same = F.get(F.filter(other, lambda y: (y["before"] == x["before"]) & (y["after"] == x["after"]) & (y["kind"] == x["kind"])), F.lit(0))
        ends = (same["len"] == x["len"]) | ((same["len"] < x["len"]) & same["terminal"]) | ((x["len"] < same["len"]) & x["terminal"])
        return same.isNotNull() & ((x["kind"] != "I") | ends)

    return F.filter(own, lambda x: ~held(x))


def covered_by(indels: Column, backward: Column, mate: Column) -> Column:
    """The place before the first indel, from the last one for a read that goes ``backward``, whose surroundings the mate (pos, stop) covers."""
    seen = F.filter(indels, lambda x: x["before"].between(mate["pos"], mate["stop"]) & x["after"].between(mate["pos"], mate["stop"]))
    return F.get(F.when(backward, F.reverse(seen)).otherwise(seen), F.lit(0))["before"]


def mates_disagree(r1: Column, r2: Column, allowed: int = 1) -> Column:
    """Whether mates (pos, stop, nm, backward, indels) contradict each other: one covers an indel of the other that it doesn't hold.

    One of them must be good: ``allowed`` mismatches at most beside its indels, and no more with them unless it has one indel only.
    """
    def good(r: Column) -> Column:
        within = F.aggregate(r["indels"], F.lit(0), lambda a, x: a + x["len"])
        return (r["nm"] - within <= allowed) & ((r["nm"] <= allowed) | (F.size(r["indels"]) <= 1))

    seen = covered_by(unshared(r2["indels"], r1["indels"]), r2["backward"], r1).isNotNull() | covered_by(unshared(r1["indels"], r2["indels"]), r1["backward"], r2).isNotNull()
    return F.coalesce((good(r1) | good(r2)) & seen, F.lit(False))
