"""Register bulk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest_file(spark: SparkSession, pattern: str) -> str:
    """The last file by name among those the pattern matches (file names only, no data, reach the driver)."""
    names = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = names.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(names)
    if not found:
        raise FileNotFoundError(pattern)
    return max((s.getPath().toString() for s in found), key=lambda p: p.rsplit("/", 1)[-1])


def register_bulk_scan(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest ``;``-separated bulk file: lower-case headers, lines with NUL bytes dropped.

    ``row_order`` keeps the file order. Cells never hold line breaks, so the file splits by line.
    """
    path = newest_file(spark, pattern)
    raw = spark.read.option("sep", ";").option("header", True).option("quote", '"').option("inferSchema", False).csv(path)
    clean = raw.toDF(*[c.strip().strip('"').lower() for c in raw.columns])
    nul_free = F.lit(True)
    for c in clean.columns:
        nul_free = nul_free & ~F.coalesce(F.col(c).contains("\x00"), F.lit(False))
    return clean.withColumn(
        "row_order",
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ),
    ).where(nul_free)
