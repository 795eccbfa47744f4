"""Session set-up and the few helpers that touch the driver.

Only size-checked, small results ever reach the driver: ``small_table`` reads at most
``max_rows + 1`` rows and hands larger inputs back as an ordinary (checkpointed) DataFrame.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "firmweave", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only in local mode where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    made = spark.conf.get("spark.firmweave.fallback.dir", None)
    if not made:
        made = tempfile.mkdtemp(prefix="firmweave-")
        spark.conf.set("spark.firmweave.fallback.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, however often it is used."""
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that costs one evaluation a row however often it is read: no filter or projection is moved through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


class Small(NamedTuple):
    """A table, plus its rows if they were proven to be few."""

    df: DataFrame
    local: pa.Table | None = None

    @property
    def proven(self) -> bool:
        return self.local is not None

    def hinted(self) -> DataFrame:
        return F.broadcast(self.df) if self.proven else self.df


def small_table(df: DataFrame, max_rows: int) -> Small:
    """Materialise ``df`` once: as a local table if it has at most ``max_rows`` rows, else as a checkpoint.

    Either way later jobs see the very same rows, also after an executor is lost.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        return Small(df.sparkSession.createDataFrame(rows, df.schema), rows)
    return Small(cut(df))


#: Broadcast lookups are at most this large as text and numbers; keys with more rows than HOT_ROWS are salted.
BROADCAST_BYTES, HOT_ROWS = 64 << 20, 1_000_000


def _is_small(df: DataFrame, max_rows: int) -> bool:
    """At most ``max_rows`` rows and BROADCAST_BYTES bytes? Measured without moving a row to the driver."""
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = sum(text, F.lit(8 * len(df.columns)))
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return n <= max_rows and total <= BROADCAST_BYTES


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: Sequence[str], max_rows: int = 100_000, salts: int = 16,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a lookup with one row per key, whatever the skew of ``rows``.

    A lookup measured to be small in rows and bytes is broadcast. Otherwise the join is a plain one, in which only
    keys measured to have more than ``hot_rows`` rows are salted, by columns that differ within a key, and only
    their lookup rows repeated. All three give the same rows.
    """
    on = list(on)
    if _is_small(lookup, max_rows):
        return rows.join(F.broadcast(lookup.sparkSession.createDataFrame(lookup.toArrow(), lookup.schema)), on, "left")
    known = rows.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_n"))
    hot = small_table(known.where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot")), max_rows)
    if hot.proven and not hot.local.num_rows:
        return rows.join(lookup, on, "left")
    is_hot = F.col("_hot").isNotNull()
    numbers = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.join(hot.hinted(), on, "left").withColumn("_salt", F.explode(numbers)).drop("_hot")
    salted = rows.join(hot.hinted(), on, "left").withColumn("_salt", F.when(is_hot, F.pmod(F.hash(*spread_by), F.lit(salts))).otherwise(0)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], "left").drop("_salt")


def spread_scan(df: DataFrame) -> DataFrame:
    """Spread a file scan that has fewer splits than cores, for work that is heavy per row.

    A scan of any size has more splits than that and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
