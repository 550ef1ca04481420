"""Tables that a step writes before it uses them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share; a temporary one where none is set and all run here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="varigrid-")
    return f"{base.rstrip('/')}/varigrid-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows from a table they are written to, so that what made them runs once however often they are read."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
