"""Reads: which count, which belong together, and what two mates say as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of an alignment's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 16, 64, 128, 256, 1024, 2048
MOST_STITCHED_Q = 93


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def eligible(min_mapq: int = 1, duplicates: bool = False, proper_only: bool = False) -> Column:
    """Whether a read (flag, mapq, cigar) counts."""
    flag = F.col("flag")
    keep = ~has(flag, UNMAPPED) & ~has(flag, SECONDARY) & ~has(flag, SUPPLEMENTARY) & (F.col("mapq") >= min_mapq) & F.col("cigar").isNotNull() & (F.col("cigar") != "*")
    if not duplicates:
        keep = keep & ~has(flag, DUPLICATE)
    return keep & has(flag, PROPER) if proper_only else keep


def stitchable(reads: DataFrame, min_mapq: int = 0, proper_only: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """Reads (name, flag, mapq) that mates are looked for among: primary ones, of quality 0 or enough, whose name isn't excluded."""
    flag = F.col("flag")
    keep = ~has(flag, SUPPLEMENTARY) & ~has(flag, SECONDARY) & ((F.col("mapq") == 0) | (F.col("mapq") >= min_mapq))
    if proper_only:
        keep = keep & has(flag, PROPER)
    kept = reads.filter(keep)
    return kept if excluded is None else kept.join(excluded.select("name").distinct(), "name", "left_anti")


def first_of_equal(reads: DataFrame, order: str = "name") -> DataFrame:
    """Of reads with one place, alignment and sequence the first by name."""
    same = Window.partitionBy("chrom", "pos", "cigar", "bases").orderBy(order)
    return reads.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n")


def mates(reads: DataFrame) -> DataFrame:
    """(name, r1, r2): primary reads of one name as a pair of structs, r1 the one that begins first.

    Reads are joined on a hash of the name; a name with one primary read only
    has no row here (see ``unpaired``).
    """
    cols = F.struct(*reads.columns)
    grouped = reads.groupBy("name").agg(F.count("*").alias("_n"), F.min_by(cols, F.struct("pos", "flag")).alias("r1"), F.max_by(cols, F.struct("pos", "flag")).alias("r2"))
    return grouped.filter("_n = 2").drop("_n")


def unpaired(reads: DataFrame) -> DataFrame:
    """Reads whose name doesn't occur exactly twice."""
    names = reads.groupBy("name").agg(F.count("*").alias("_n")).filter("_n <> 2").select("name")
    return reads.join(names, "name", "left_semi")


def within(reads: DataFrame, window: int = 1000) -> DataFrame:
    """Pairs (a, b) of a name and chromosome that begin within ``window`` places of each other."""
    pairs = mates(reads)
    return pairs.filter((F.col("r1.chrom") == F.col("r2.chrom")) & (F.abs(F.col("r2.pos") - F.col("r1.pos")) <= window))


def stitched(bases: DataFrame, min_q: int = 20, nify: bool = False) -> DataFrame:
    """(name, chrom, pos, base, q, dir): one base for each place of a pair of ungapped mates.

    ``bases`` (name, chrom, pos, mate, base, q) has a row for each base of each
    mate.  Mates that agree add their qualities, up to 93.  If they don't, the
    better base stands, with its quality only if the other is too poor to count;
    or N with ``nify``.  ``dir`` is 2 where both mates are, else the mate's.
    """
    g = bases.groupBy("name", "chrom", "pos").agg(
        F.max(F.when(F.col("mate") == 0, F.struct("base", "q"))).alias("a"), F.max(F.when(F.col("mate") == 1, F.struct("base", "q"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    alone = a.isNull() | b.isNull()
    one = F.coalesce(a, b)
    same = a["base"] == b["base"]
    better = F.when(a["q"] >= b["q"], a).otherwise(b)
    worse_q = F.least(a["q"], b["q"])
    base = F.when(alone, one["base"]).when(same, a["base"]).when(F.lit(nify), "N").otherwise(better["base"])
    q = F.when(alone, one["q"]).when(same, F.least(F.lit(MOST_STITCHED_Q), a["q"] + b["q"])).when(F.lit(nify) | (worse_q >= min_q), 0).otherwise(better["q"])
    direction = F.when(~alone, 2).when(a.isNotNull(), 0).otherwise(1)
    return g.select("name", "chrom", "pos", base.alias("base"), q.cast("int").alias("q"), direction.alias("dir"))


def op_vote(a: Column, b: Column) -> Column:
    """The alignment operation of two mates at a place; null if they can't be reconciled."""
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a).when(a == "S", b).when(b == "S", a)


def classified(pairs: DataFrame) -> DataFrame:
    """Adds ``kind`` to pairs (r1, r2 with mapq, cigar, nm): what a realigner does with them."""
    def of(r: str, what: str) -> Column:
        return F.col(f"{r}.{what}")

    indel = lambda r: of(r, "cigar").rlike("[ID]")
    soft = lambda r: of(r, "cigar").rlike("S")
    clean = lambda r: ~indel(r) & ~soft(r) & (F.coalesce(of(r, "nm"), F.lit(0)) == 0)
    kind = (
        F.when(of("r1", "chrom") != of("r2", "chrom"), "split").when((of("r1", "mapq") == 0) | (of("r2", "mapq") == 0), "unusable")
        .when(indel("r1") & indel("r2"), "both_indel").when(indel("r1") | indel("r2"), "one_indel").when(clean("r1") & clean("r2"), "perfect")
        .when(soft("r1") | soft("r2"), "clipped").otherwise("mismatched")
    )
    return pairs.withColumn("kind", kind)


def pair_status(considered_length: int | None = None) -> Column:
    """What a read (flag, ref, mate_ref, fragment) says of its pair: ids of contigs, -1 for none.

    split_chromosomes, mate_unmapped, duplicate, long_fragment (only with a ``considered_length``: no
    overlap can be expected beyond twice of it) or unknown.
    """
    flag, ref, mate = F.col("flag"), F.col("ref"), F.col("mate_ref")
    lost = (has(flag, MATE_UNMAPPED) & (ref == -1)) | (has(flag, UNMAPPED) & (mate == -1))
    status = F.when(has(flag, PAIRED) & (ref != mate), "split_chromosomes").when(lost, "mate_unmapped").when(has(flag, DUPLICATE), "duplicate")
    if considered_length is not None:
        near = (ref == mate) & (F.abs("fragment") <= 2 * considered_length)
        status = status.when(has(flag, PAIRED) & ~near, "long_fragment")
    return status.otherwise("unknown")


def pair_source(reads: DataFrame, proper_only: bool = False, considered_length: int | None = None) -> DataFrame:
    """Primary reads, proper ones only if asked, with their ``status``."""
    flag = F.col("flag")
    keep = ~has(flag, SUPPLEMENTARY) & ~has(flag, SECONDARY)
    if proper_only:
        keep = keep & has(flag, PROPER)
    return reads.filter(keep).withColumn("status", pair_status(considered_length))


def apart(r1: Column, r2: Column, clips_count: bool = True) -> Column:
    """Whether two reads (chrom, pos, stop, start_clip, end_clip) don't overlap.

    With ``clips_count`` the outer end of a read's clipped bases inside the other's aligned ones is an overlap.
    """
    same = r1["chrom"] == r2["chrom"]
    overlap = same & (r1["pos"] <= r2["stop"]) & (r2["pos"] <= r1["stop"])
    if not clips_count:
        return ~overlap
    def reaches(a: Column, b: Column) -> Column:
        return same & ((a["pos"] - a["start_clip"]).between(b["pos"], b["stop"]) | (a["stop"] + a["end_clip"]).between(b["pos"], b["stop"]))
    return ~(overlap | reaches(r1, r2) | reaches(r2, r1))
