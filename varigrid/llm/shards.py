"""A table of immutable shards with size-tiered compaction.

Arrivals are appended as small Parquet shards.  Compaction takes the shards of
a size tier (sizes within a factor of ``FANOUT``) once there are ``FANOUT`` of
them and writes their rows again as files of about the target size; shards of
half the target and more are left alone.  So a row is written again about once
for each tier between arrival and target, whatever the table's size.

A version of the table is a manifest, a small file that lists its shards.  It
is written beside its place and moved there by a rename that fails if the place
is taken: a version is committed whole or not at all, of two writers one has
to try again, and readers of older versions find all their shards until
``vacuum`` removes what only older versions list.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from varigrid.llm.common import file_system

FANOUT = 4
TARGET_BYTES = 64 << 20
ROWS_PER_ARRIVAL = 2_000


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target_bytes, self.fanout = spark, path.rstrip("/"), target_bytes, fanout

    # -- versions ------------------------------------------------------------

    def versions(self) -> list[int]:
        fs, p = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The latest or a given version; version 0 is the empty table before the first append."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, p = file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, version: int, schema: str, shards: list[Shard]) -> None:
        jvm = self.spark.sparkContext._jvm
        place = f"{self.path}/manifests/{version:012d}.json"
        fs, draft = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "shards": [s.__dict__ for s in shards]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(place), none)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(place) from None
            raise

    # -- writing -------------------------------------------------------------

    def _write(self, df: DataFrame, **options: int) -> list[Shard]:
        """Write rows to a folder of their own and list its files."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.options(compression="zstd", **options).parquet(folder)
        fs, p = file_system(self.spark, folder)
        files = [s for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        return sorted((Shard(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in files), key=lambda s: s.file)

    def append(self, df: DataFrame, rows_per_shard: int = ROWS_PER_ARRIVAL) -> int:
        """Add rows as small shards; the new version."""
        new = self._write(df, maxRecordsPerFile=rows_per_shard)
        while True:
            now = self.manifest()
            schema = now["schema"] or df.schema.json()
            if schema != df.schema.json():
                raise ValueError("rows of another schema")
            try:
                self._commit(now["version"] + 1, schema, [*map(lambda s: Shard(**s), now["shards"]), *new])
                return now["version"] + 1
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return int(math.log(max(1, size), self.fanout))

    def due(self) -> list[Shard]:
        """The smallest tier's shards that are to be merged, if any are.

        Tiers of fewer than ``fanout`` shards wait, and so do shards of half the target and more.
        """
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if 2 * s.bytes < self.target_bytes:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merge tier by tier until none is due; the last version."""
        while run := self.due():
            before = self.manifest()
            files = max(1, round(sum(s.bytes for s in run) / self.target_bytes))
            merged = self._write(self._rows([s.file for s in run], before["schema"]).coalesce(files))
            gone = {s.file for s in run}
            while True:
                now = self.manifest()
                held = [Shard(**s) for s in now["shards"]]
                if not gone <= {s.file for s in held}:
                    break  # another compaction has replaced them; what was merged here stays unlisted
                try:
                    self._commit(now["version"] + 1, now["schema"], [*[s for s in held if s.file not in gone], *merged])
                    break
                except Conflict:
                    continue
        return self.manifest()["version"]

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions before the last ``keep`` and the files that none of those kept lists."""
        versions = self.versions()
        kept = {s.file for v in versions[-keep:] for s in self.shards(v)}
        fs, _ = file_system(self.spark, self.path)
        jvm = self.spark.sparkContext._jvm
        for v in versions[:-keep]:
            for s in self.shards(v):
                if s.file not in kept:
                    fs.delete(jvm.org.apache.hadoop.fs.Path(s.file), False)
        for v in versions[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{v:012d}.json"), False)

    # -- reading -------------------------------------------------------------

    def _rows(self, files: list[str], schema: str) -> DataFrame:

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing was appended")
        return self._rows([s["file"] for s in manifest["shards"]], manifest["schema"])


def sharded(docs: DataFrame, path: str, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> ShardedTable:
    """A table at ``path`` of all rows of ``docs``, arrived in so many parts by the hash of doc_id, and compacted.

    Rows come out as they went in, nulls and repeated rows too; an empty table gives a version without rows.
    """

    table = ShardedTable(docs.sparkSession, path, target_bytes)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))
    for i in range(arrivals):
        table.append(docs.filter(part == i))
        table.compact()
    table.vacuum()
    return table
