"""Line dedup by site-relative frequency, in DataFrame functions only.

A line's ratio is the number of a host's pages that hold it, divided by all pages of the host. Lines above ``ratio`` on
at least ``min_pages`` pages are boilerplate and go; everything else stays as it was. Counts are combined before
their shuffle. The boilerplate lines of a host are at most its mean lines per counted page divided by the ratio, so one array
per host holds them; they are written first, so that Spark knows their size and broadcasts them only below its
threshold, else splits a large host's rows itself.

Lines are compared without the white space around them, by a 64-bit hash; blank lines never go. Edge cases: a null text has
no lines and stays null; a null host is a host of its own; repeated rows are pages like others, unless ``copies_once``: then pages of a host that have
the same non-blank lines in the same order count as one page, in a line's uses and in the host's pages, so that copies of a page
never make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.session import staged

TRIMMED = " \t\r\n"
# What parts the visible lines of a page: comments, scripts, styles, any other tag, line breaks.
BREAKS = r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|\n"


def page_lines(html: str) -> Column:
    """The visible, non-blank lines of a page."""
    pieces = F.transform(F.split(F.col(html), BREAKS), lambda x: F.btrim(x, F.lit(TRIMMED)))
    return F.filter(pieces, lambda x: x != "")


def text_lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.xxhash64(F.btrim(x, F.lit(TRIMMED))))


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.2, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """The input columns as a struct ``page``, its ``host``, its ``lines`` and those ``kept``."""
    rows = pages.select(F.struct(*(F.col(c) for c in pages.columns)).alias("page"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    blank = F.xxhash64(F.lit(""))
    counted = rows.select("host", _hashes(F.col("lines")).alias("hashes"))
    if copies_once:
        own = counted.withColumn("hashes", F.filter("hashes", lambda x: x != blank))
        own = own.groupBy("host", F.xxhash64("hashes").alias("copies")).agg(F.first("hashes").alias("hashes"))
        counted = staged(own.select("host", "hashes"))
    totals = counted.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        counted.select("host", F.explode(F.array_distinct("hashes")).alias("line")).where(F.col("line") != blank)
        .groupBy("host", "line").agg(F.count("*").alias("uses"))
    )
    frequent = counts.where(F.col("uses") >= min_pages).join(totals, "host").where(F.col("uses") > F.lit(ratio) * F.col("pages"))
    boilerplate = staged(frequent.groupBy("host").agg(F.collect_set("line").alias("boilerplate")))
    none = F.array().cast("array<bigint>")
    joined = rows.join(boilerplate, "host", "left").withColumn("boilerplate", F.coalesce("boilerplate", none))
    gone = F.col("boilerplate")
    kept = F.filter("lines", lambda x: ~F.array_contains(gone, F.xxhash64(F.btrim(x, F.lit(TRIMMED)))))
    return joined.select("page", "host", "lines", F.when(F.size("boilerplate") > 0, kept).otherwise(F.col("lines")).alias("kept"))
