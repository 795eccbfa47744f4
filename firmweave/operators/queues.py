"""Work queues: what is due, in which order, on which shard, and what is already done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions.text import col, is_blank
from firmweave.functions.times import at, instant, minus, plus


def due(ts: Column | str, days: int, now, value: Column | str | None = None) -> Column:
    """Value blank, time missing or unparsable, or older than ``days``."""
    moment = instant(ts)
    old = moment.isNull() | (moment < minus(at(now), days=days))
    return old if value is None else (is_blank(value) | old)


def refresh_due(df: DataFrame, ts: str, days: int, now, value: str | None = None) -> DataFrame:
    """Rows that need a new check."""
    return df.where(due(ts, days, now, value))


def due_queue_topk(df: DataFrame, n: int, ts: str, days: int, now, value: str | None = None,
                   key: str = "orgnr") -> DataFrame:
    """The first n due rows: never checked first, then oldest (ties by key). A distributed top-n."""
    return refresh_due(df, ts, days, now, value).orderBy(instant(ts).asc_nulls_first(), key).limit(n)


def scheduled_queue_topk(df: DataFrame, n: int, next_at: str, now, key: str = "orgnr") -> DataFrame:
    """The first n rows whose next check is unset or has come."""
    when = F.coalesce(instant(next_at), F.lit("1970-01-01 00:00:00").cast("timestamp"))
    ready = F.col(next_at).isNull() | (instant(next_at) <= at(now))
    return df.where(~is_blank(key) & ready).orderBy(when, key).limit(n)


def stable_hash_shard(key: Column | str, shards: int) -> Column:
    """MD5 of the key as a 128-bit number, modulo the shard count.

    Horner's rule over four 32-bit digits keeps every step inside 64 bits.
    """
    digest = F.md5(col(key).cast("binary"))
    out = F.lit(0).cast("bigint")
    for i in range(4):
        digit = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        out = (out * F.lit((1 << 32) % shards) + digit) % F.lit(shards)
    return out.cast("int")


def with_shard(df: DataFrame, shards: int, key: str = "orgnr") -> DataFrame:
    return df.withColumn("shard_id", stable_hash_shard(key, shards))


def resume_anti_join(targets: DataFrame, done: DataFrame, key: str = "orgnr") -> DataFrame:
    """Targets not found in earlier output."""
    return targets.join(done.select(key), key, "left_anti")


def next_check_schedule(df: DataFrame, status: str = "status", hard: str = "hard_error", checked: str = "checked_at",
                        refresh_days: int = 90, hard_days: int = 14, soft_days: int = 2) -> DataFrame:
    """Adds ``next_check_at``: the full period after an answer, less after a soft or a hard error."""
    answered = F.col(status).isin("ok", "unknown", "not_found")
    days = F.when(answered, refresh_days).when(F.col(hard), hard_days).otherwise(soft_days)
    return df.withColumn("next_check_at", plus(F.col(checked), days=days))
