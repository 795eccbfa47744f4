"""Annual-report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the key in a document's file name.
NAME_PATTERN = r"(?i)([0-9]{10})_([0-9]{4}-[0-9]{2}-[0-9]{2})\.(?:xhtml|html|zip)$"


def with_filing_key(docs: DataFrame, name: str = "source_file") -> DataFrame:
    """Adds orgnr and end_date from the file name; empty text where the name has another form."""
    return docs.withColumns(
        {
            "orgnr": F.regexp_extract(name, NAME_PATTERN, 1),
            "end_date": F.regexp_extract(name, NAME_PATTERN, 2),
        }
    )


def filing_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per unpacked document below ``path``: orgnr, end_date, xhtml, source_file."""
    docs = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.xhtml")
        .text(path, wholetext=True)
        .select(F.col("value").alias("xhtml"), F.col("_metadata.file_path").alias("source_file"))
    )
    return with_filing_key(docs).select("orgnr", "end_date", "xhtml", "source_file")


def packed_filing_scan(spark: SparkSession, path: str) -> DataFrame:
    """The same from a table of (source_file, xhtml): the layout for many small documents."""
    docs = spark.read.schema("source_file string, xhtml string").parquet(path)
    return with_filing_key(docs).select("orgnr", "end_date", "xhtml", "source_file")
