"""Running values along positions, block by block.

A window over a whole chromosome is one task's.  Here positions are cut into
blocks: windows run inside blocks, and what earlier blocks leave comes from their
summaries, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
WIDTH = 100_000


def running(rows: DataFrame, by: list[str], at: str, order: list[str], value: Column, name: str, how: str = "max", own: bool = False) -> DataFrame:
    """Adds ``name``: the greatest ``value``, or the sum, of all earlier rows of the same ``by`` columns, of the row itself too with ``own``.

    Rows are in order of ``order``, which begins with the position ``at``.  Without any
    earlier value the result is null.
    """
    gather = {"max": F.max, "sum": F.sum}[how]
    keyed = rows.withColumns({"_block": F.floor(F.col(at) / WIDTH), "_value": value})
    inner = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    sums = keyed.groupBy(*by, "_block").agg(gather("_value").alias("_top"))
    # a row a block from here on
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_at_block"), gather("_top").over(earlier).alias("_carry"))
    found = keyed.withColumn("_own", gather("_value").over(inner))
    same = found["_block"] == carry["_at_block"]
    for c in by:
        same = same & found[c].eqNullSafe(carry[f"_by_{c}"])
    if how == "max":
        result = F.greatest("_own", "_carry")
    else:
        result = F.when(F.col("_own").isNull() & F.col("_carry").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return found.join(carry, same, "left").withColumn(name, result).drop("_block", "_value", "_own", "_carry", "_at_block", *[f"_by_{c}" for c in by])


def following(rows: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """Adds ``name``: the next position ``at`` of rows whose positions are all different, null for the last."""
    keyed = rows.withColumn("_block", F.floor(F.col(at) / WIDTH))
    firsts = keyed.groupBy(*by, "_block").agg(F.min(at).alias("_first"))
    later = Window.partitionBy(*by).orderBy("_block")
    carry = firsts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_block").alias("_at_block"), F.lead("_first").over(later).alias("_carry"))
    found = keyed.withColumn("_own", F.lead(at).over(Window.partitionBy(*by, "_block").orderBy(at)))
    same = found["_block"] == carry["_at_block"]
    for c in by:
        same = same & found[c].eqNullSafe(carry[f"_by_{c}"])
    return found.join(carry, same, "left").withColumn(name, F.coalesce("_own", "_carry")).drop("_block", "_own", "_carry", "_at_block", *[f"_by_{c}" for c in by])


def with_halo(rows: DataFrame, at: str, reach: int) -> DataFrame:
    """Rows with ``block``, and once more in each block that begins or ends within ``reach`` of them, where ``halo`` holds."""
    of = lambda shift: F.floor((F.col(at) + shift) / WIDTH)
    spread = rows.withColumn("block", F.explode(F.array_distinct(F.array(of(0), of(-reach), of(reach)))))
    return spread.withColumn("halo", F.col("block") != of(0))
