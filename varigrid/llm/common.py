"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Where that is unset
    on one machine, as in tests, a temporary folder is taken and set; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read again: the plan before it is done with,
    and what comes after survives lost executors without running it anew."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path of any scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def dropped(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = file_system(spark, path)
        fs.delete(p, True)


def text_parts(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``most_bytes`` of text, or one longer text:
    first row, last row + 1, offsets into the bytes (rows + 1), the bytes.
    A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


# -- counters of fixed size ---------------------------------------------------

#: Counters in one row of a sketch's partial result.
BLOCK = 1 << 14


def counted(hashes: DataFrame, bits: int, kind: type = np.uint32) -> np.ndarray:
    """Sum the partial counters in (block int, counts binary) rows into one array.

    The array has ``2 ** bits`` unsigned counters whatever the input's size, so
    that it may be collected and broadcast; a full counter stays at its top.  Partial arrays meet block
    by block; a task adds them as they come and holds one block at a time.
    """
    blocks = max(1, (1 << bits) // BLOCK)
    size = min(BLOCK, 1 << bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(counts.as_buffer(), kind)
                if block in total:
                    had = total[block]
                    had += part
                    had[had < part] = np.iinfo(kind).max
                else:
                    total[block] = part.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), binaries([x.tobytes() for x in total.values()])], ["block", "counts"]
        )

    out = np.zeros(1 << bits, kind)
    rows = hashes.repartition(min(blocks, 64), "block").mapInArrow(add, "block int, counts binary").collect()
    for row in rows:
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["counts"], kind)
    return out


def counter_rows(counts: np.ndarray, kind: type = np.uint32) -> Iterator[pa.RecordBatch]:
    """One task's counters as (block, counts) rows, without blocks that are all zero."""
    size = min(BLOCK, len(counts))
    parts = counts.astype(kind).reshape(-1, size)
    full = np.flatnonzero(parts.any(axis=1))
    for i in range(0, len(full), 16):
        some = full[i : i + 16]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), binaries([parts[b].tobytes() for b in some])], ["block", "counts"]
        )


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; further columns, whatever their names, don't meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
