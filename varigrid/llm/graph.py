"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import dropped, shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Large-star and small-star steps in turn: every node hangs its larger
    neighbours, then its smaller ones and itself, on the smallest node it knows,
    until nothing changes.  The number of rounds grows with the logarithm of
    the component's size.  Each round is written to the shared folder, so
    lineage stays short and a lost executor costs one round at most; so is the
    result, whose plan is one scan wherever it is joined.  A node's
    neighbours are reduced with ``min`` before they move and never gathered.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    path = shared_dir(spark)
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    seen = None
    while True:
        large = both(now)
        least = large.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = large.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(small.select("a", F.col("m").alias("b")))
        new_path = shared_dir(spark)
        new = stored(small.distinct(), new_path)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, path)
        path, now = new_path, new
        if mark == seen:
            break
        seen = mark
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = stored(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    dropped(spark, path)
    return roots
