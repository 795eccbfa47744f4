"""Versioned table snapshots: readers see a whole version or the one before it."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession


class TableSnapshots:
    """Folder of versions ``v=<number>``; a version counts once its commit mark ``_SUCCESS`` is there."""

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self.partition_by = tuple(partition_by)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(n for n in numbers if self.has(n))

    def has(self, version: int) -> bool:
        fs, mark = self._fs(f"{self._dir(version)}/_SUCCESS")
        return fs.exists(mark)

    def _dir(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def read(self, version: int | None = None) -> DataFrame:
        if version is None:
            version = self.versions()[-1]
        return self.spark.read.parquet(self._dir(version))

    def _claim(self, version: int) -> None:
        """Only one writer gets a version: the claim file is made if absent, by the file system."""
        fs, claim = self._fs(f"{self.path}/claim-{version}")
        if not fs.createNewFile(claim):
            raise FileExistsError(f"version {version} is being written by another writer; name it to replace an abandoned write")

    def _release(self, version: int) -> None:
        fs, claim = self._fs(f"{self.path}/claim-{version}")
        fs.delete(claim, False)

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next (or the given) version. A committed version is never written again.

        Of several writers of the next version one goes on and the others fail before they write. A version given by
        number replaces what an unfinished write left, so its callers must be one at a time (as a stream is).
        """
        if version is None:
            done = self.versions()
            version = done[-1] + 1 if done else 0
            self._claim(version)
        elif self.has(version):
            raise FileExistsError(f"version {version} is committed")
        writer = df.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        try:
            writer.parquet(self._dir(version))
        except Exception:
            self._release(version)
            raise
        return version

    def expire(self, keep: int) -> list[int]:
        """Delete all but the newest ``keep`` (at least one) versions; returns those deleted."""
        gone = self.versions()[: -max(keep, 1)]
        for v in gone:
            fs, folder = self._fs(self._dir(v))
            fs.delete(folder, True)
            self._release(v)
        return gone
