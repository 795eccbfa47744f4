"""Coverage, distribution, freshness, delivery and reputation reports."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions.text import is_blank, percent
from firmweave.functions.times import at, minus
from firmweave.session import lookup_join, staged


def column_coverage(df: DataFrame, text: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Per column: filled rows and their percent. One pass, one row of counts, then unpivoted."""
    counts = [F.count_if(~is_blank(c)).alias(c) for c in text]
    counts += [F.count(c).alias(c) for c in numbers]
    row = df.agg(F.count("*").alias("_total"), *counts)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in [*text, *numbers]])
    return row.select("_total", F.explode(cells).alias("x")).select(
        "x.column", "x.n", percent(F.col("x.n"), F.col("_total")).alias("pct")
    )


def _label(col: str) -> Column:
    value = F.trim(F.col(col).cast("string"))
    return F.coalesce(F.when(value != "", value), F.lit("(empty)")).alias("value")


def value_distribution(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent values; blank counts as ``(empty)``; ties by value."""
    return df.groupBy(_label(col)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def top_values(df: DataFrame, col: str, n: int = 10, tracked: int = 10_000) -> DataFrame:
    """``value_distribution`` of a column with very many values, of which few are frequent: the same rows.

    A sketch of bounded size finds the values that may be frequent; only those are counted, so the rare ones are never shuffled. A value that the
    sketch does not give has at most 7 / ``tracked`` of all rows (twice the sketch's error), so the result is whole where the last count is above that, or
    where the values found are all rows. Otherwise all values are counted.
    """
    rows = df.select(_label(col))
    sketch = staged(rows.agg(F.expr(f"approx_top_k(value, {tracked}, {tracked})").alias("t"), F.count("*").alias("total")))
    found = staged(sketch.select(F.explode("t.item").alias("value"), F.lit(True).alias("_found")))  # at most ``tracked`` rows
    exact = staged(lookup_join(rows, found, ["value"], ["value"]).where("_found").groupBy("value").agg(F.count("*").alias("n")))
    top = exact.orderBy(F.desc("n"), "value").limit(n)
    total, covered = sketch.first().total, exact.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held, least = top.agg(F.count("*"), F.min("n")).first()
    if covered == total or (held == n and least * tracked > 7 * total):
        return top
    return value_distribution(df, col, n)


def freshness_windows(df: DataFrame, ts: str, now) -> DataFrame:
    """Rows in the last 24 hours, 7 and 30 days, rows never stamped, newest stamp."""
    since = lambda days: F.count_if(F.col(ts) >= minus(at(now), days=days))
    return df.agg(
        F.count("*").alias("total"), since(1).alias("last_24h"), since(7).alias("last_7d"), since(30).alias("last_30d"),
        F.count_if(F.col(ts).isNull()).alias("never"), F.max(ts).alias("newest"),
    )


def top_n_groups(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent non-blank values; ties by value."""
    return value_distribution(df.where(~is_blank(col)), col, n)


def feed_reconciliation(feed_rows: DataFrame, checks: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Per feed: files and rows delivered against companies checked and the newest check.

    ``feed_rows``: feed, file, n; ``kinds``: feed -> check key.
    """
    delivered = feed_rows.groupBy("feed").agg(F.count("*").alias("files"), F.sum("n").alias("rows"))
    names = F.create_map(*[F.lit(x) for feed, key in kinds.items() for x in (key, feed)])
    # Two steps instead of a distinct count, so that one hot company or kind is reduced before the shuffle.
    per_company = (
        checks.where(F.col("checked_at").isNotNull())
        .withColumn("feed", F.try_element_at(names, F.col("check_key")))
        .where(F.col("feed").isNotNull())
        .groupBy("feed", "orgnr")
        .agg(F.max("checked_at").alias("newest"))
    )
    checked = per_company.groupBy("feed").agg(F.count("*").alias("companies"), F.max("newest").alias("newest_check"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return delivered.join(checked, "feed", "full_outer").select(
        "feed", zero("files"), zero("rows"), zero("companies"), "newest_check"
    )


def _message_flags(events: DataFrame) -> DataFrame:
    """Per message: what its events say. Events without a message are left out."""
    has = lambda kinds: F.bool_or(F.col("type").isin(*kinds))
    return (
        events.where(F.col("message_id").isNotNull())
        .groupBy(F.col("message_id").alias("id"))
        .agg(has(fv.FAIL_EVENTS).alias("_f"), has(fv.DELIVERED_EVENTS).alias("_d"), has(fv.ACCEPT_EVENTS).alias("_a"))
    )


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def classify_messages(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``delivery_class``: the first that applies of FAILED, DELIVERED, ACCEPTED, QUEUED, UNKNOWN."""
    status = F.coalesce(F.col("status"), F.lit(""))
    no_event = F.col("_f").isNull()
    cls = (
        F.when(_yes("_f") | status.isin("failed", "error") | ~is_blank("error"), "FAILED")
        .when(_yes("_d"), "DELIVERED")
        .when(_yes("_a") | status.isin("sent", "accepted"), "ACCEPTED")
        .when(status.isin("queued", "scheduled") & no_event, "QUEUED")
        .otherwise("UNKNOWN")
    )
    return messages.join(_message_flags(events), "id", "left").withColumn("delivery_class", cls)


CLASSES = ("FAILED", "DELIVERED", "ACCEPTED", "QUEUED", "UNKNOWN")


def delivery_class(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Count and percent of each class; the classes sum to the total."""
    row = classify_messages(messages, events).agg(
        F.count("*").alias("_total"), *[F.count_if(F.col("delivery_class") == c).alias(c) for c in CLASSES]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("delivery_class"), F.col(c).alias("n")) for c in CLASSES])
    return row.select("_total", F.explode(cells).alias("x")).select(
        "x.delivery_class", "x.n", percent(F.col("x.n"), F.col("_total")).alias("pct")
    )


def stale_accepted(messages: DataFrame, events: DataFrame, now, hours: Sequence[int] = (6, 24)) -> DataFrame:
    """Messages accepted but neither delivered nor failed, older than each number of hours."""
    waiting = messages.join(_message_flags(events).where("_a AND NOT _d AND NOT _f"), "id")
    age = F.coalesce("sent_at", "created_at")
    row = waiting.agg(*[F.count_if(age < minus(at(now), hours=h)).alias(str(h)) for h in hours])
    cells = F.array(*[F.struct(F.lit(h).alias("older_than_hours"), F.col(f"`{h}`").alias("n")) for h in hours])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def reputation_verdict(messages: DataFrame, events: DataFrame, dns_facts: DataFrame, now) -> DataFrame:
    """Bounce rate (7 days), complaint rate (30 days) and the verdict OK, WARNING or DEAD.

    ``dns_facts``: one row (spf, dmarc, listed).
    """
    recent = lambda days: F.col("created_at") >= minus(at(now), days=days)
    one = lambda test: test.cast("bigint")
    sent_like = F.col("status").isin(*fv.SENT_LIKE)
    sent = messages.select(one(recent(7) & sent_like).alias("sent_7d"), one(recent(30) & sent_like).alias("sent_30d"))
    bad = events.select(
        one(recent(7) & F.col("type").isin("bounced", "bounce")).alias("bounces_7d"),
        one(recent(30) & (F.col("type") == "complaint")).alias("complaints_30d"),
    )
    # The three inputs in one aggregation: missing columns are NULL and do not count.
    counts = ("sent_7d", "sent_30d", "bounces_7d", "complaints_30d")
    row = (
        sent.unionByName(bad, allowMissingColumns=True)
        .unionByName(dns_facts.select("spf", "dmarc", "listed"), allowMissingColumns=True)
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
            *[F.coalesce(f(c), F.lit(False)).alias(c) for c, f in (("spf", F.bool_and), ("dmarc", F.bool_and), ("listed", F.bool_or))],
        )
    )
    rate = lambda n, total: F.when(F.col(total) > 0, F.col(n) / F.col(total)).otherwise(F.lit(0.0))

    def severity(rate_col: str, total: str, limits: tuple) -> Column:
        warn, dead, least = limits
        graded = F.when(F.col(rate_col) >= dead, 2).when(F.col(rate_col) >= warn, 1).otherwise(0)
        return F.when(F.col(total) >= least, graded).otherwise(0)

    worst = F.greatest(
        F.when(F.col("spf") & F.col("dmarc"), 0).otherwise(1),
        F.when(F.col("listed"), 2).otherwise(0),
        severity("bounce_rate_7d", "sent_7d", fv.BOUNCE_RATE_7D),
        severity("complaint_rate_30d", "sent_30d", fv.COMPLAINT_RATE_30D),
    )
    return (
        row.withColumn("bounce_rate_7d", rate("bounces_7d", "sent_7d"))
        .withColumn("complaint_rate_30d", rate("complaints_30d", "sent_30d"))
        .withColumn("verdict", F.when(worst == 2, "DEAD").when(worst == 1, "WARNING").otherwise("OK"))
    )


def sequence_queue_report(links: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Links queued per campaign; counted before the join, so campaigns are never a hot join key."""
    depth = links.groupBy("campaign_id").agg(F.count("*").alias("n"))
    return depth.join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign")), "campaign_id").select(
        "campaign", "n"
    )


def latest_links(links: DataFrame, campaigns: DataFrame, n: int = 10) -> DataFrame:
    """The n newest links, with their campaign's name."""
    named = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign"))
    known = links.join(named.select("campaign_id"), "campaign_id", "left_semi")
    return known.orderBy(F.desc("id")).limit(n).join(named, "campaign_id").select(
        "id", "lead_id", "campaign", "current_step", "current_variant", "next_send_at", "stopped_reason"
    )


def tier_summary(links: DataFrame) -> DataFrame:
    """Rows per tier 1 to 5, zero included."""
    row = links.agg(*[F.count_if(F.col("tier") == t).alias(str(t)) for t in range(1, 6)])
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(f"`{t}`").alias("n")) for t in range(1, 6)])
    return row.select(F.explode(cells).alias("x")).select("x.*")
