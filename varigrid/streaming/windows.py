"""Blocks, sessions and mates over streams of placed rows.

A place on a chromosome serves as event time (a second for each position), so
watermarks say up to which place all rows have come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_time(pos: Column) -> Column:
    return F.timestamp_seconds(pos)


def blocks(rows: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Number and sum of ``value`` per tumbling block of event time; a block is final once the watermark has passed it."""
    placed = rows.withColumn(time, F.col(time).cast("timestamp"))
    stream = placed.withWatermark(time, late) if rows.isStreaming else placed
    found = stream.groupBy(*by, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(*by, F.col("w.start").alias("block"), "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Runs of rows whose neighbours are within ``gap``: a session window also takes a neighbour at exactly that distance."""
    placed = rows.withColumn(time, F.col(time).cast("timestamp"))
    stream = placed.withWatermark(time, late) if rows.isStreaming else placed
    found = stream.groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return found.select(*by, "first", "last", "n")


def mates(first: DataFrame, second: DataFrame, reach: int = 1000, late: str = "1000 seconds") -> DataFrame:
    """Mates of two streams (name, pos, time) within ``reach`` places, what waits being let go behind the watermark."""
    a = first.withWatermark("time", late).select("name", F.col("pos").alias("pos_a"), F.col("time").alias("time_a"))
    b = second.withWatermark("time", late).select(F.col("name").alias("name_b"), F.col("pos").alias("pos_b"), F.col("time").alias("time_b"))
    near = F.expr(f"name = name_b and time_b between time_a - interval {reach} seconds and time_a + interval {reach} seconds")
    return a.join(b, near).drop("name_b")


def drops(rows: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """Rows (key, ts, value) that are under ``share`` of the one before of their key, kept as state between batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows_in = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows_in.itertuples():
            if last is not None and r.value < share * last:
                out.append((k[0], r.event_id, last, r.value))
            last = float(r.value)
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", "before", "value"])

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, before double, value double", "last double", "append", GroupStateTimeout.NoTimeout)
