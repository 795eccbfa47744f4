"""Observation feeds: many NDJSON files in, JSON lines per shard out."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from firmweave.functions.text import blank_to_null, full_strip
from firmweave.session import once
from firmweave.sources import schemas


def list_files(spark: SparkSession, patterns: Sequence[str]) -> list[list[str]]:
    """Per pattern its files (names only); a file two patterns match belongs to the first."""
    seen: set[str] = set()
    out = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = []
        for status in fs.globStatus(path) or []:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
        fresh = [f for f in sorted(found) if f not in seen]
        seen.update(fresh)
        out.append(fresh)
    return out


def feed_lines(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    """Raw lines with their place: pattern rank, file, position in the file."""
    parts = []
    for rank, files in enumerate(list_files(spark, patterns)):
        if not files:
            continue
        lines = spark.read.text(files).select(
            "value",
            F.lit(rank).alias("pattern_rank"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
        parts.append(lines.withColumn("line_no", F.monotonically_increasing_id()))
    if not parts:
        raise FileNotFoundError(", ".join(patterns))
    return reduce(DataFrame.unionByName, parts)


def with_json(lines: DataFrame, name: str, text: str) -> DataFrame:
    """Adds the VARIANT of a line that is exactly one JSON value, else NULL.

    The parser stops behind the first value, so the line is parsed as the first element of an array whose second
    is the line's own digest: whatever follows the value, or ends the array early, puts the digest out of its place.
    """
    mark = F.md5(F.col(text).cast("binary"))
    step = once(lines, "_pair", F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))))
    own = F.when(F.try_variant_get("_pair", "$[1]", "string") == mark, F.try_variant_get("_pair", "$[0]", "variant"))
    return once(step, name, own).drop("_pair")


def parse_lines(lines: DataFrame, schema: str, needs_time: bool) -> DataFrame:
    """Blank lines dropped, the rest parsed; ``reject`` is NULL, ``error`` or ``skipped``.

    A line must hold one JSON object that isn't empty: a torn one, two in one line, text behind it, a number that is none (NaN) make it an
    error. Of a repeated name the last value counts. A value of another type costs its field only.
    """
    # Read when an expression is made; the parser would refuse repeated names otherwise.
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = full_strip("value")
    wanted = StructType.fromDDL(schema)
    step = with_json(once(lines, "_line", text).where(F.col("_line") != ""), "_r", "_line")
    step = once(step, "_type", F.schema_of_variant("_r"))
    for name in ("orgnr", "checked_at"):
        step = once(step, f"_{name}", _typed(wanted[name]))
    not_object = ~F.coalesce(F.startswith("_type", F.lit("OBJECT<")) & (F.col("_type") != "OBJECT<>"), F.lit(False))
    no_key = blank_to_null("_orgnr").isNull()
    no_time = blank_to_null("_checked_at").isNull() if needs_time else F.lit(False)
    reject = F.when(not_object, "error").when(no_key | no_time, "skipped")
    read = {"orgnr": F.col("_orgnr"), "checked_at": F.col("_checked_at")}
    names = [c for c in step.columns if c not in ("_r", "_line", "_type", "_orgnr", "_checked_at", "value")]
    order = [c for c in ("pattern_rank", "file_path", "block_start", "line_no") if c in step.columns]
    return step.withColumn("reject", reject).select(
        *names, F.struct(*order).alias("feed_order"), "reject", "_line", *(read.get(f.name, _typed(f)).alias(f.name) for f in wanted)
    )


def _typed(field: StructField) -> Column:
    """A field in the type of the schema; NULL where its value doesn't fit. Text fields take lists and numbers in their JSON form."""
    get = lambda kind: F.try_variant_get("_r", f"$.{field.name}", kind)
    kind = field.dataType
    if isinstance(kind, (StringType, ArrayType)):
        return get(kind.simpleString())
    return F.coalesce(get(kind.simpleString()), get("double").try_cast(kind)) if kind.simpleString() != "double" else get("double")


def feed_scan(spark: SparkSession, patterns: Sequence[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows with ``feed_order``, rejected lines with their reason) of one feed kind."""
    parsed = parse_lines(feed_lines(spark, patterns), schemas.FEEDS[kind], kind in schemas.NEEDS_TIME)
    place = ["pattern_rank", "file_path", "block_start", "line_no"]
    rows = parsed.where(F.col("reject").isNull()).drop("reject", "_line", *place)
    rejects = parsed.where(F.col("reject").isNotNull()).select("file_path", "reject", F.col("_line").alias("line"))
    return rows, rejects


def feed_write(df: DataFrame, path: str, shard: str = "shard_id") -> None:
    """Append rows as JSON lines, one folder per shard; NULL fields are kept."""
    df.write.mode("append").partitionBy(shard).option("ignoreNullFields", "false").json(path)
