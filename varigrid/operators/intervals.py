"""Intervals with both ends included, joined and combined without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.operators import blocks

#: Width of the bins that range joins meet in.
BIN = 1000


def binned(intervals: DataFrame, bin_width: int = BIN) -> DataFrame:
    """A row for each bin that an interval touches, so that a range join is an equi-join on ``bin``."""
    lo, hi = (F.floor(F.col(c) / bin_width) for c in ("start", "stop"))
    return intervals.filter("stop >= start").withColumn("bin", F.explode(F.sequence(lo, hi)))


def inside(points: DataFrame, intervals: DataFrame, by: list[str] | None = None, bin_width: int = BIN) -> DataFrame:
    """Rows of ``points`` (pos) in any interval (start, stop), of the same ``by`` columns.

    Overlapping intervals are merged first: few remain to meet in a bin.
    """
    by = by or []
    side = binned(merged(intervals, by), bin_width).select(*by, "bin", "start", "stop")
    left = points.withColumn("bin", F.floor(F.col("pos") / bin_width))
    cond = [left[c] == side[c] for c in [*by, "bin"]] + [left["pos"].between(side["start"], side["stop"])]
    return left.join(side, cond, "left_semi").drop("bin")


def touching(points: DataFrame, intervals: DataFrame, by: list[str] | None = None, bin_width: int = BIN) -> DataFrame:
    """Rows of ``points`` (pos, ref) whose reference bases overlap any interval (start, stop), of the same ``by`` columns.

    Rows meet the merged intervals in the bins of their first and their last base, and of all between.
    """
    by = by or []
    side = binned(merged(intervals, by), bin_width).select(*by, "bin", "start", "stop")
    last = F.col("pos") + F.length("ref") - 1
    of = lambda c: F.floor(c / bin_width)
    rows = points.withColumns({"_last": last, "bin": of(F.col("pos"))})
    near = lambda df: [df[c] == side[c] for c in [*by, "bin"]] + [df["pos"] <= side["stop"], df["_last"] >= side["start"]]
    narrow, wide = rows.filter(of(F.col("_last")) == F.col("bin")), rows.filter(of(F.col("_last")) > F.col("bin"))
    # rows of several bins are matched by their places: a made-up number need not be the same when rows are read again
    keys = [*by, "pos", "_last"]
    spread = wide.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(of(F.col("pos")), of(F.col("_last")))))
    hit = spread.join(side, near(spread), "left_semi").select(*keys).distinct()
    return narrow.join(side, near(narrow), "left_semi").unionByName(wide.join(hit, keys, "left_semi").select(*narrow.columns)).drop("bin", "_last")


def overlapping(a: DataFrame, b: DataFrame, by: list[str] | None = None, bin_width: int = BIN) -> DataFrame:
    """Pairs of intervals that overlap, once each, as structs ``a`` and ``b``: a pair is taken in the first bin both touch."""
    by = by or []
    cols_a, cols_b = a.columns, b.columns
    x = binned(a, bin_width).select("bin", F.struct(*cols_a).alias("a"))
    y = binned(b, bin_width).select("bin", F.struct(*cols_b).alias("b"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    first = F.col("bin") == F.floor(F.greatest("a.start", "b.start") / bin_width)
    met = x.join(y, "bin").filter(first & (F.col("a.start") <= F.col("b.stop")) & (F.col("b.start") <= F.col("a.stop")))
    for cond in same:
        met = met.filter(cond)
    return met.drop("bin")


def merged(intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The union as disjoint intervals (by, start, stop); touching ones stay apart unless they share a place."""
    by = by or []
    rows = blocks.running(intervals.select(*by, "start", "stop"), by, "start", ["start", "stop"], F.col("stop"), "_before")
    opened = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), F.col("start"))
    # an interval belongs to the last one opened
    runs = blocks.running(rows, by, "start", ["start", "stop"], opened, "_run", own=True)
    return runs.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def minus(intervals: DataFrame, excluded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What of the intervals no excluded one covers, as disjoint intervals.

    A sweep over places where the cover changes: a stretch counts where
    intervals are open and no excluded one is.
    """
    by = by or []
    edge = lambda df, a, b: df.filter("stop >= start").select(*by, F.col("start").alias("at"), F.lit(a).alias("on"), F.lit(b).alias("off")).union(df.filter("stop >= start").select(*by, F.col("stop") + 1, F.lit(-a), F.lit(-b)))
    edges = edge(intervals, 1, 0).union(edge(excluded, 0, 1)).groupBy(*by, "at").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    swept = blocks.running(edges, by, "at", ["at"], F.col("on"), "_on", "sum", own=True)
    swept = blocks.following(blocks.running(swept, by, "at", ["at"], F.col("off"), "_off", "sum", own=True), by, "at", "next")
    pieces = swept.filter("_on > 0 and _off = 0 and next is not null").select(*by, F.col("at").alias("start"), (F.col("next") - 1).alias("stop"))
    # pieces that only a change of cover separates belong together
    rows = blocks.running(pieces, by, "start", ["start"], F.col("stop"), "_before")
    opened = F.when(F.col("_before").isNull() | (F.col("start") - 1 != F.col("_before")), F.col("start"))
    runs = blocks.running(rows, by, "start", ["start"], opened, "_run", own=True)
    return runs.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def clipped(intervals: DataFrame, block: int) -> DataFrame:
    """Intervals cut at the borders of blocks of positions 1..block, block+1..2*block and so on: (id, block, start, stop)."""
    of = lambda c: F.floor((F.col(c) - 1) / block)
    cut = intervals.filter("stop >= start").withColumn("block", F.explode(F.sequence(of("start"), of("stop"))))
    return cut.select("id", "block", F.greatest("start", F.col("block") * block + 1).alias("start"), F.least("stop", (F.col("block") + 1) * block).alias("stop"))


def uncovered(points: DataFrame, intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, pos): places of the intervals at which ``points`` has no row."""
    by = by or []
    spine = merged(intervals, by).select(*by, F.explode(F.sequence("start", "stop")).alias("pos"))
    return spine.join(points.select(*by, "pos").distinct(), [*by, "pos"], "left_anti")


def inside_expanded(points: DataFrame, intervals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``points`` (pos, ref) in an interval, or whose reference bases reach into one.

    A row that reaches in draws the interval's start back to itself, so that rows
    after it are in.  One row's reach may so bring in the next before it; the
    starts settle in one pass, as the least start of the run of rows that reach.
    """
    by = by or []
    spans = points.select(*by, F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).alias("stop")).distinct()
    joined = merged(intervals.select(*by, "start", "stop"), by)
    runs = merged(spans.filter("stop > start").select(*by, "start", "stop").union(joined), by)
    reach = overlapping(runs, joined, by).groupBy(*[F.col(f"b.{c}").alias(c) for c in by], F.col("b.start").alias("start"), F.col("b.stop").alias("stop")).agg(F.min("a.start").alias("drawn"))
    return inside(points, reach.select(*by, F.col("drawn").alias("start"), "stop"), by)
