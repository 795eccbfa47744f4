"""Exact ranks, quantiles and positions without an unbounded partition.

A window over one big group (a year, the whole table) would put that group in one task. Instead each
group is cut at bounds taken from its own approximate quantiles:

* a value equal to a bound lies in a *point* bucket that holds this value only, so its rows all have
  the same rank and may be spread over any number of tasks;
* all other values lie in an *open* bucket between two bounds. A value with more than about
  ``1/buckets`` of the rows is always one of the bounds, so no open bucket can be heavy.

The number of buckets follows from the measured size of the largest group, so that an open bucket has about
``TARGET_ROWS`` rows at any size; groups of at most WHOLE_ROWS rows are one bucket each and need no bounds. Counting the buckets gives each one's offset; the rank inside a bucket is a
window over its rows. The bounds only steer the split. They never influence the result, which is exact. Rows
of a group that is NULL have no rank.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.session import Small, small_table

TARGET_ROWS, LEAST_BUCKETS = 1_000_000, 16  # the least number where a group is cut at all
WHOLE_ROWS = 100_000  # a group of more rows is never one bucket, whose values a task would hold
MOST_BUCKETS = 512  # no more than these, unless a bucket had over TARGET_ROWS rows then
MAX_GROUPS = 20_000
MAX_BUCKET_ROWS = 2_000_000
_SALTS = 64


def buckets_for(largest: int, target_rows: int = TARGET_ROWS) -> int:
    """So many buckets that one of them has about ``target_rows`` of the rows of the largest group.

    More than MOST_BUCKETS only cost (bounds to look through in every row), so beyond them a bucket may have up to TARGET_ROWS rows.
    """
    return max(LEAST_BUCKETS, min(-(-largest // target_rows), max(MOST_BUCKETS, -(-largest // TARGET_ROWS))))


class Grid(NamedTuple):
    """Per group the sorted distinct bounds (``bounds``), and the number of buckets they were made for.

    No table: every group is one bucket. ``few``: the groups are at most MAX_GROUPS.
    """

    table: Small | None
    buckets: int
    few: bool


def value_grid(rows: DataFrame, group: Sequence[str], value: str = "value", target_rows: int = TARGET_ROWS) -> Grid:
    """Counts the groups and, if one has over ``target_rows`` rows, (or WHOLE_ROWS) takes bounds of all by another summary pass."""
    sizes = rows.groupBy(*group).agg(F.count(value).alias("n"))
    largest, groups = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if largest <= min(target_rows, WHOLE_ROWS) and groups <= MAX_GROUPS:
        return Grid(None, 1, True)
    buckets = buckets_for(largest, target_rows)
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.groupBy(*group).agg(F.percentile_approx(value, shares, max(10_000, 10 * buckets)).alias("bounds"))
    table = small_table(found.select(*group, F.array_sort(F.array_distinct("bounds")).alias("bounds")), MAX_GROUPS)
    return Grid(table, buckets, table.proven)


def add_bucket(df: DataFrame, value: str, bounds: Column, most: int) -> DataFrame:
    """Adds ``bucket``: twice the number of bounds below the value, plus 1 if the value is itself a bound.

    A binary search among at most ``most`` bounds, one projection per step, so that it stays inside generated code.
    """
    out = df.withColumn("bucket", F.lit(0))
    for step in (1 << k for k in reversed(range(most.bit_length()))):
        passed = F.coalesce(F.get(bounds, F.col("bucket") + (step - 1)) < F.col(value), F.lit(False))
        out = out.withColumn("bucket", F.col("bucket") + F.when(passed, step).otherwise(0))
    on_bound = F.coalesce(F.get(bounds, F.col("bucket")) == F.col(value), F.lit(False))
    return out.withColumn("bucket", F.col("bucket") * 2 + on_bound.cast("int"))


def with_bucket(rows: DataFrame, grid: Grid, group: Sequence[str], value: str = "value") -> DataFrame:
    joined = rows.join(grid.table.hinted(), list(group))
    # Two limits may stand among the bounds.
    return add_bucket(joined, value, F.col("bounds"), grid.buckets + 1).drop("bounds")


def bucket_offsets(bucketed: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per group and bucket: its row count, the rows in lower buckets (``below``) and in the group (``n``)."""
    counts = bucketed.groupBy(*group, "bucket").agg(F.count("*").alias("cnt"))
    ordered = W.partitionBy(*group).orderBy("bucket")
    return counts.select(
        *group,
        "bucket",
        "cnt",
        (F.sum("cnt").over(ordered) - F.col("cnt")).alias("below"),
        F.sum("cnt").over(W.partitionBy(*group)).alias("n"),
    )


def _hint_offsets(offsets: DataFrame, grid: Grid) -> DataFrame:
    """At most two buckets per bound plus one exist, so the table's size follows from the grid's."""
    if grid.table.proven and grid.table.local.num_rows * (2 * grid.buckets + 7) <= MAX_BUCKET_ROWS:
        return F.broadcast(offsets)
    return offsets


def quantile_pairs(rows: DataFrame, grid: Grid, group: Sequence[str], p: float, value: str = "value") -> DataFrame:
    """Per group the exact p and 1-p quantiles (``lo``, ``hi``), linear between neighbours."""
    if grid.table is None:
        pair = rows.where(F.concat(*group).isNotNull()).groupBy(*group).agg(F.percentile(value, [p, 1.0 - p]).alias("q"))
        # One row per group, and the groups were counted.
        return F.broadcast(pair.select(*group, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")))
    bucketed = with_bucket(rows, grid, group, value)
    last = F.col("n") - 1
    places = {"lo": last * F.lit(p), "hi": last * F.lit(1.0 - p)}
    wanted = F.array_distinct(
        F.array(*[f(place).cast("bigint") for place in places.values() for f in (F.floor, F.ceil)])
    )
    targets = (
        bucket_offsets(bucketed, group)
        .withColumn(
            "pos",
            F.explode(F.filter(wanted, lambda x: (x >= F.col("below")) & (x < F.col("below") + F.col("cnt")))),
        )
        .select(*group, "bucket", "below", "n", "pos")
    )
    # Four positions per group at most, so this is as small as the grid.
    targets = small_table(targets, 4 * MAX_GROUPS)
    keys = list(group) + ["bucket"]
    distinct_values = (
        bucketed.join(Small(targets.df.select(*keys).distinct(), targets.proven).hinted(), keys, "left_semi")
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count("*").alias("c"))
    )
    inside = W.partitionBy(*keys).orderBy("v")
    placed = distinct_values.withColumn("before", F.sum("c").over(inside) - F.col("c"))
    local = F.col("pos") - F.col("below")
    picked = placed.join(targets.hinted(), keys).where(
        (local >= F.col("before")) & (local < F.col("before") + F.col("c"))
    )

    def between(place: Column) -> tuple[Column, ...]:
        lower, upper = F.floor(place).cast("bigint"), F.ceil(place).cast("bigint")
        v_lo = F.max(F.when(F.col("pos") == lower, F.col("v")))
        v_hi = F.max(F.when(F.col("pos") == upper, F.col("v")))
        return v_lo, v_hi, F.max(upper - place), F.max(place - lower)

    aggs = []
    for name, place in places.items():
        aggs += [v.alias(f"{name}_{x}") for v, x in zip(between(place), "abvw")]
    found = picked.groupBy(*group).agg(*aggs)

    def mixed(name: str) -> Column:
        # As F.percentile has it, so that both ways give the same bits.
        a, b, v, w = (F.col(f"{name}_{x}") for x in "abvw")
        return F.when((w == 0) | (a == b), a).otherwise(v * a + w * b).alias(name)

    return small_table(found.select(*group, mixed("lo"), mixed("hi")), MAX_GROUPS).hinted()


def rank_below(
    rows: DataFrame, grid: Grid, group: Sequence[str], spread_by: Sequence[str], value: str = "value"
) -> DataFrame:
    """Adds ``below_rows`` (rows of the group strictly below the value) and ``n`` (rows of the group)."""
    if grid.table is None:
        whole = W.partitionBy(*group)
        known = rows.where(F.concat(*group).isNotNull())
        return known.withColumns({"below_rows": F.rank().over(whole.orderBy(value)) - 1, "n": F.count(value).over(whole)})
    bucketed = with_bucket(rows, grid, group, value)
    offsets = _hint_offsets(bucket_offsets(bucketed, group).select(*group, "bucket", "below", "n"), grid)
    salt = F.when(F.col("bucket") % 2 == 1, F.pmod(F.hash(*spread_by), F.lit(_SALTS))).otherwise(F.lit(0))
    local = W.partitionBy(*group, "bucket", "salt").orderBy(value)
    return (
        bucketed.withColumn("salt", salt)
        .withColumn("inside", F.rank().over(local) - 1)
        .join(offsets, list(group) + ["bucket"])
        .withColumn("below_rows", F.col("below") + F.col("inside"))
        .drop("bucket", "salt", "inside", "below")
    )


def ordered_position(df: DataFrame, key: str, name: str = "position", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Global 0-based position of each row in the order of a *unique* key, computed range by range.

    ``df`` is read three times: hand in a stored table.
    """
    buckets = buckets_for(df.count(), target_rows)
    sampled = df.select(key).orderBy(F.xxhash64(key), key).limit(buckets * 8).collect()
    keys = sorted(r[0] for r in sampled if r[0] is not None)
    cuts = keys[8::8]
    bounds = F.array(*[F.lit(k) for k in cuts]).cast(f"array<{dict(df.dtypes)[key]}>")
    bucketed = add_bucket(df, key, bounds, len(cuts)).withColumn("g", F.lit(0))
    # At most two buckets per cut plus one, hence a bounded table.
    offsets = F.broadcast(bucket_offsets(bucketed.select("g", "bucket"), ["g"]).select("bucket", "below"))
    inside = F.row_number().over(W.partitionBy("bucket").orderBy(key)) - 1
    return (
        bucketed.withColumn("inside", inside)
        .join(offsets, "bucket")
        .withColumn(name, (F.col("below") + F.col("inside")).cast("bigint"))
        .drop("bucket", "g", "inside", "below")
    )
