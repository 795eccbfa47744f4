"""Feeds applied as they arrive, with the same rules as the batch merge.

``feed_state`` keeps what the feeds say about each company in Spark's state store: a micro-batch reads and writes the companies it
names and no others, and the master is joined when it is read (``current_master``). ``incremental_feed_apply`` writes a whole new master
for every micro-batch, for masters small enough for that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from firmweave.operators.merge import SIGNAL_FEEDS, FeedRule, apply_feed, apply_reduced, observations
from firmweave.sources import schemas
from firmweave.sources.feeds import parse_lines
from firmweave.sources.snapshots import TableSnapshots


def incremental_feed_apply(
    spark: SparkSession,
    feed_path: str,
    master: TableSnapshots,
    checkpoint: str,
    kind: str,
    rule: FeedRule | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Apply new feed files to the master snapshot, one version per micro-batch.

    Batch b turns version b into version b+1, so a replayed batch either finds its version finished or
    rewrites it from the same input: exactly once. The stream's checkpoint replaces the list of files done.
    """
    rule = rule or SIGNAL_FEEDS[kind]
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(feed_path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        if master.has(batch_id + 1):
            return
        numbered = batch.withColumn("line_no", F.monotonically_increasing_id())
        rows = parse_lines(numbered, schemas.FEEDS[kind], kind in schemas.NEEDS_TIME).where(F.col("reject").isNull())
        merged, _ = apply_feed(master.read(batch_id), rows, rule)
        master.write(merged, batch_id + 1)

    return (
        lines.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _line_numbers():
    """The worker function, made here so that it travels whole and workers need no package."""

    def numbered(batches):
        seen: Counter = Counter()
        for batch in batches:
            numbers = np.zeros(batch.num_rows, dtype=np.int64)
            paths, blocks = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            names, codes = paths.dictionary.to_pylist(), paths.indices.to_numpy()
            cuts = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            # Lines of one place follow each other, so they are numbered run by run.
            for a, b in zip([0, *cuts], [*cuts, len(numbers)]):
                if b > a:
                    place = (names[codes[a]], int(blocks[a]))
                    numbers[a:b] = np.arange(seen[place], seen[place] + b - a)
                    seen[place] += int(b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=["value", "file_path", "block_start", "line_no"])

    return numbered


def feed_state(
    spark: SparkSession,
    feed_paths: Mapping[str, str],
    changes: TableSnapshots,
    checkpoint: str,
    rules: Mapping[str, FeedRule] = SIGNAL_FEEDS,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Fold new feed files (kind -> path) into one state row per company; each micro-batch's changed rows become a version of ``changes``.

    A company's row has the newest marker and the first value of each feed over all files so far, in the order of file path and line, so
    it is that of one batch over the same files, however they came. Rows of companies that a batch doesn't name are neither
    read nor written. A batch that is run again after a failure finds its version written or replaces what was left of it.
    """
    feeds = {}
    for kind, path in feed_paths.items():
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.load(path).select(
            "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start")
        )
        # A stream has no line numbers; a task reads its part of a file in order.
        lines = lines.mapInArrow(_line_numbers(), "value string, file_path string, block_start bigint, line_no bigint")
        feeds[kind] = parse_lines(lines, schemas.FEEDS[kind], kind in schemas.NEEDS_TIME).where(F.col("reject").isNull())
    rows, aggs = observations(feeds, rules)

    def keep(batch: DataFrame, batch_id: int) -> None:
        if not changes.has(batch_id):
            changes.write(batch, batch_id)

    return (
        rows.groupBy("orgnr").agg(*aggs).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_changes(changes: TableSnapshots) -> DataFrame | None:
    """The newest state row of each company, from the committed versions; None when there is none yet."""
    paths = [f"{changes.path}/v={v}" for v in changes.versions()]
    if not paths:
        return None
    rows = changes.spark.read.option("basePath", changes.path).parquet(*paths)
    held = [c for c in rows.columns if c not in ("orgnr", "v")]
    return rows.groupBy("orgnr").agg(F.max_by(F.struct(*held), "v").alias("_s")).select("orgnr", "_s.*")


def current_master(
    master: DataFrame, changes: TableSnapshots, kinds: list[str], rules: Mapping[str, FeedRule] = SIGNAL_FEEDS
) -> DataFrame:
    """The master with all that the state says, by the batch merge's rules. ``kinds`` are those of the stream."""
    state = latest_changes(changes)
    return master if state is None else apply_reduced(master, state, kinds, rules)[0]
