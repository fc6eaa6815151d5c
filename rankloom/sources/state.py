"""A keyed table that is changed batch by batch (A9, A10; the sinks of K2, K3, K5, K6).

Each batch writes the rows that it changed into a folder of its own
(``delta/version=N``), so a replayed batch overwrites its own change and nothing
else. Every ``compact_every`` batches the state below the current one is written
out whole (``snapshot/version=N``) and what the snapshot before covers is removed, so reading
takes one snapshot and a bounded number of deltas however many batches there
were. A batch never compacts itself: a replay of it finds the state it had.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

VERSION, DELETED = "_version", "_deleted"


class StateTable:
    """``keys`` identify a row; ``schema`` (DDL or StructType) names all columns.

    Versions are batch numbers, 0 and up, written in ascending order. Null keys
    are keys like any other. A row put as deleted is gone until it is put again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema, compact_every: int = 10):
        self.spark, self.path, self.keys, self.compact_every = spark, path, keys, compact_every
        self.schema = spark.createDataFrame([], schema).schema

    def _versions(self, kind: str) -> list[int]:
        """Finished folders only: a write that broke off has no _SUCCESS."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, kind))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [(s.getPath(), s.getPath().getName()) for s in fs.listStatus(at)]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.split("=")[1]) for p, n in names if n.startswith("version=") and fs.exists(done(p, "_SUCCESS")))

    def _folder(self, kind: str, version: int) -> str:
        return os.path.join(self.path, kind, f"version={version}")

    def _remove(self, kind: str, version: int) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._folder(kind, version))
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _load(self, kind: str, version: int) -> DataFrame:
        full = StructType([*self.schema.fields, StructField(DELETED, BooleanType())])
        return self.spark.read.schema(full).parquet(self._folder(kind, version)).withColumn(VERSION, F.lit(version))

    def parts(self, before: int | None = None) -> tuple[list[int], list[int]]:
        """The snapshot (at most one) and the deltas that make the state below ``before``."""
        below = lambda vs: [v for v in vs if before is None or v < before]
        snapshot = below(self._versions("snapshot"))[-1:]
        return snapshot, [v for v in below(self._versions("delta")) if not snapshot or v > snapshot[0]]

    def read(self, before: int | None = None) -> DataFrame:
        """The state after all batches, or after those below ``before``."""
        snapshot, deltas = self.parts(before)
        rows = None
        for kind, version in [("snapshot", v) for v in snapshot] + [("delta", v) for v in deltas]:
            part = self._load(kind, version)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        rest = [f.name for f in self.schema.fields if f.name not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, DELETED), VERSION).alias("_r"))
        return last.where(~F.coalesce(F.col(f"_r.{DELETED}"), F.lit(False))).select(
            *[F.col(f"_r.{f.name}").alias(f.name) if f.name in rest else F.col(f.name) for f in self.schema.fields])

    def put(self, rows: DataFrame, version: int) -> None:
        """Rows of this batch (one per key) replace those of their keys; rows with a
        true ``_deleted`` remove them. Every ``compact_every`` versions the state
        below this one is compacted first."""
        deleted = F.col(DELETED) if DELETED in rows.columns else F.lit(False)
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], deleted.alias(DELETED)) \
            .write.mode("overwrite").parquet(self._folder("delta", version))
        if len(self.parts(version)[1]) >= self.compact_every:
            self.compact(version)

    def compact(self, before: int) -> None:
        """One snapshot of the state below ``before``. What made it up stays until the
        next compaction, for frames that were read before this one."""
        snapshot, deltas = self.parts(before)
        if not deltas:
            return
        self.read(before).withColumn(DELETED, F.lit(False)).write.mode("overwrite").parquet(self._folder("snapshot", deltas[-1]))
        for last in snapshot:
            for version in self._versions("delta"):
                if version <= last:
                    self._remove("delta", version)
            for version in self._versions("snapshot"):
                if version < last:
                    self._remove("snapshot", version)
