"""Versioned snapshot tables: each version is a folder of its own, so a reader never sees half a rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.functions.common import latest_by


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        whole = [s.getPath() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in whole if p.getName().startswith("v="))

    def path(self, version: int) -> str:
        return f"{self.root}/v={version}"

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest below `before`."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self.path(found[-1])) if found else None

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self.path(version))

    def prune(self, keep: int = 2) -> None:
        jvm = self.spark.sparkContext._jvm
        for version in self.versions()[:-keep]:
            folder = jvm.org.apache.hadoop.fs.Path(self.path(version))
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def merge_latest(snapshots: Snapshots, batch: DataFrame, version: int, keys: list[str], order: str) -> None:
    """Version `version`: the last row of each key over the version before and the batch.  Repeating it changes nothing."""
    before = snapshots.read(version)
    rows = batch if before is None else before.unionByName(batch)
    snapshots.write(latest_by(rows, keys, order).select(*batch.columns), version)
