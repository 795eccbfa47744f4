"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import firmweave

BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Make Arrow batches of bounded bytes and let every executor import this package.

    Bounded batches keep a run of very long texts from filling a worker's memory. Both are settings of the session
    that change no result; the package goes out once, as an archive, by Spark's own file distribution.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context, root = spark.sparkContext, Path(firmweave.__file__).parent
    if "firmweave.zip" not in context._python_includes:
        archive = Path(tempfile.mkdtemp(prefix="firmweave-")) / "firmweave.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))


def give_back() -> None:
    """Hand freed memory back to the system: a worker that ends a task stays alive beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(id_col: str, n: int, remainder: int) -> Column:
    """Is crc32 of the id as text, modulo n, the remainder? False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == remainder, F.lit(False))
