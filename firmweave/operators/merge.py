"""Merges: pure functions (current table, incoming rows) -> new table.

Incoming rows are first reduced per key by aggregates with map-side combine (``min_by`` / ``max_by``), never
by a window, so one key with a third of all rows costs no more than any other. Row order is an explicit
column; nothing depends on how the rows are distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions.text import blank_to_null, full_strip, int_or_null, is_blank
from firmweave.functions.times import at, instant, iso_z, plus
from firmweave.operators.standardize import ownership_bucket, span_of_code


def first_filled(value: str, order: str) -> Column:
    """Aggregate: the first non-blank value in feed order."""
    return F.min_by(F.col(value), F.when(~is_blank(value), F.col(order)))


def newest(cols: Sequence[str], ts: str, order: str) -> Column:
    """Aggregate: the columns of the row with the latest instant; of equal instants the earliest row."""
    rank = F.struct((-F.unix_micros(ts)).alias("t"), F.col(order).alias("o"))
    return F.min_by(F.struct(*cols, ts), F.when(F.col(ts).isNotNull(), rank))


def fill_if_blank_merge(master: DataFrame, feed: DataFrame, value: str, order: str, key: str = "orgnr",
                        target: str | None = None) -> DataFrame:
    """Set the column where it is blank; the first non-blank feed value wins; unknown keys change nothing."""
    target = target or value
    best = feed.groupBy(key).agg(first_filled(value, order).alias("_new"))
    out = master.join(best, key, "left")
    return out.withColumn(target, F.when(is_blank(target), F.coalesce("_new", target)).otherwise(F.col(target))).select(
        *master.columns
    )


def newest_wins_merge(master: DataFrame, feed: DataFrame, cols: Mapping[str, str], ts: str, order: str,
                      target_ts: str, key: str = "orgnr") -> DataFrame:
    """Replace a column group (feed column -> master column) when the feed is strictly newer or the master has no time."""
    best = feed.where(F.col(ts).isNotNull()).groupBy(key).agg(newest(list(cols), ts, order).alias("_new"))
    newer = F.coalesce(F.col(f"_new.{ts}") > F.col(target_ts), F.col("_new").isNotNull() & F.col(target_ts).isNull())
    changes = {to: F.when(newer, F.col(f"_new.{frm}")).otherwise(F.col(to)) for frm, to in cols.items()}
    changes[target_ts] = F.when(newer, F.col(f"_new.{ts}")).otherwise(F.col(target_ts))
    return master.join(best, key, "left").withColumns(changes).select(*master.columns)


@dataclass(frozen=True)
class FeedRule:
    """How one observation feed updates the master."""

    name: str
    marker_ts: str
    marker: Mapping[str, str]  # feed column -> master column, replaced together when newer
    value: str | None = None  # feed column filled independently of the marker
    value_target: str | None = None
    needs_time: bool = True  # rows without a time are skipped entirely
    defaults: Mapping[str, str] = field(default_factory=dict)  # lower-cased, with this default
    raw: tuple[str, ...] = ()  # taken as they are (numbers, arrays)
    keep_blank: tuple[str, ...] = ()  # text that stays '' instead of becoming NULL


# The five signal feeds plus the two that nothing applied before.
SIGNAL_FEEDS: dict[str, FeedRule] = {
    r.name: r
    for r in (
        FeedRule("website", "website_checked_at", {"status": "website_status"}, "found_website", "website",
                 needs_time=False, defaults={"status": "checked"}),
        FeedRule("email", "emails_checked_at", {"status": "email_status"}, "emails", "emails",
                 needs_time=False, defaults={"status": "checked"}),
        FeedRule("tech", "tech_checked_at", {
            "microsoft_status": "microsoft_status", "microsoft_strength": "microsoft_strength",
            "microsoft_confidence": "microsoft_confidence", "it_support_signal": "it_support_signal",
            "it_support_confidence": "it_support_confidence", "err_reason": "tech_err_reason",
        }, raw=("microsoft_strength",), keep_blank=("err_reason",)),
        FeedRule("site_review", "site_review_checked_at", {
            "site_score": "site_score", "site_flags": "site_flags", "err_reason": "site_review_err_reason",
        }, raw=("site_score", "site_flags"), keep_blank=("err_reason",)),
        FeedRule("hiring", "hiring_checked_at", {
            "hiring_status": "hiring_status", "hiring_what_text": "hiring_what_text", "hiring_count": "hiring_count",
            "err_reason": "hiring_err_reason", "hiring_urls": "hiring_external_urls",
        }, raw=("hiring_count", "hiring_urls"), keep_blank=("err_reason", "hiring_what_text")),
        FeedRule("line_of_work", "line_of_work_updated_at", {
            "final_label": "line_of_work", "w_raw": "line_of_work_raw", "final_conf": "line_of_work_conf",
            "final_bucket": "line_of_work_bucket", "source": "line_of_work_source",
        }, raw=("final_conf",)),
        FeedRule("segments", "segment_groups_checked_at", {"segment_groups_after": "segment_groups"}),
    )
}


def job_url_text(external: Column, evidence: Column) -> Column:
    """External job addresses plus the evidence address, deduplicated, as compact JSON; NULL when empty."""
    urls = F.transform(F.coalesce(external, F.array().cast("array<string>")), full_strip)
    tail = F.when(~is_blank(evidence), F.array(full_strip(evidence))).otherwise(F.array().cast("array<string>"))
    merged = F.array_distinct(F.filter(F.concat(urls, tail), lambda u: u != ""))
    return F.when(F.size(merged) > 0, F.to_json(merged))


def prepare_feed(feed: DataFrame, rule: FeedRule) -> DataFrame:
    """Feed rows as the rule reads them: clean key, parsed time (``_ts``), cleaned columns.

    A row whose time is present but cannot be parsed has no usable time. Lists become compact JSON; job addresses
    are put together from the feed's own columns where they are not given.
    """
    if "hiring_urls" in rule.marker and "hiring_urls" not in feed.columns:
        feed = feed.withColumn("hiring_urls", job_url_text(F.col("external_job_urls"), F.col("evidence_url")))
    cols, types = {}, dict(feed.dtypes)
    for c in list(rule.marker) + ([rule.value] if rule.value else []):
        if c in rule.raw:
            cols[c] = F.to_json(c) if types[c].startswith("array") else F.col(c)
        elif c in rule.defaults:
            cols[c] = F.coalesce(F.lower(blank_to_null(c)), F.lit(rule.defaults[c]))
        elif c in rule.keep_blank:
            cols[c] = full_strip(F.coalesce(F.col(c), F.lit("")))
        else:
            cols[c] = blank_to_null(c)
    known = feed.withColumn("orgnr", blank_to_null("orgnr")).withColumn("_ts", instant("checked_at"))
    known = known.where(F.col("orgnr").isNotNull())
    if rule.needs_time:
        known = known.where(F.col("_ts").isNotNull())
    return known.withColumns(cols).select("orgnr", "_ts", "feed_order", *cols)


def observations(feeds: Mapping[str, DataFrame], rules: Mapping[str, FeedRule] = SIGNAL_FEEDS) -> tuple[DataFrame, list[Column]]:
    """Feed rows side by side, and the aggregates that reduce them by ``orgnr``: per feed its newest marker
    (``_m_<feed>``) and first value (``_v_<feed>``). Both only compare rows, so parts may be reduced in any order, also as a stream."""
    rows, aggs = None, []
    for name, feed in feeds.items():
        rule, ready = rules[name], prepare_feed(feed, rules[name])
        rank = F.struct((-F.unix_micros("_ts")).alias("t"), F.col("feed_order").alias("o"))
        cols = {f"_m_{name}": F.struct(*rule.marker, "_ts"), f"_r_{name}": F.when(F.col("_ts").isNotNull(), rank)}
        aggs.append(F.min_by(f"_m_{name}", f"_r_{name}").alias(f"_m_{name}"))
        if rule.value:
            cols |= {f"_v_{name}": F.col(rule.value), f"_o_{name}": F.when(~is_blank(rule.value), F.col("feed_order"))}
            aggs.append(F.min_by(f"_v_{name}", f"_o_{name}").alias(f"_v_{name}"))
        own = ready.select("orgnr", *[v.alias(k) for k, v in cols.items()])
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return rows, aggs


def _apply(
    master: DataFrame, feeds: Mapping[str, DataFrame], rules: Mapping[str, FeedRule]
) -> tuple[DataFrame, DataFrame]:
    """Feeds reduced by key in one shuffle, then applied."""
    rows, aggs = observations(feeds, rules)
    return apply_reduced(master, rows.groupBy("orgnr").agg(*aggs), list(feeds), rules)


def apply_reduced(
    master: DataFrame, reduced: DataFrame, feeds: Sequence[str], rules: Mapping[str, FeedRule] = SIGNAL_FEEDS
) -> tuple[DataFrame, DataFrame]:
    """Reduced feeds into the master by one join, and one row per company and feed that changed it.

    Value and marker are two independent decisions. The feeds set different columns, so their order does not matter.
    """
    targets = [t for n in feeds for t in (*rules[n].marker.values(), rules[n].marker_ts, rules[n].value_target) if t]
    if len(targets) != len(set(targets)):
        raise ValueError(f"feeds must set different columns, not {sorted({t for t in targets if targets.count(t) > 1})}")
    types = dict(master.dtypes)
    decided, changes = {}, {}
    for name in feeds:
        rule, m, newer, filled = rules[name], f"_m_{name}", f"_newer_{name}", f"_filled_{name}"
        stored, stamp = instant(rule.marker_ts), F.col(f"{m}._ts")
        decided[newer] = F.coalesce(stamp > stored, stamp.isNotNull() & stored.isNull(), F.lit(False))
        for frm, to in rule.marker.items():
            changes[to] = F.when(F.col(newer), F.col(f"{m}.{frm}").cast(types[to])).otherwise(F.col(to))
        stamp = stamp if types[rule.marker_ts] != "string" else iso_z(stamp)
        changes[rule.marker_ts] = F.when(F.col(newer), stamp).otherwise(F.col(rule.marker_ts))
        decided[filled] = F.lit(False)
        if rule.value:
            decided[filled] = is_blank(rule.value_target) & F.col(f"_v_{name}").isNotNull()
            changes[rule.value_target] = F.when(F.col(filled), F.col(f"_v_{name}")).otherwise(F.col(rule.value_target))
    step = master.join(reduced, "orgnr", "left").withColumns(decided)
    marks = F.array(*[
        F.struct(F.lit(n).alias("feed"), F.col(f"_filled_{n}").alias("_filled"), F.col(f"_newer_{n}").alias("_newer")) for n in feeds
    ])
    changed = step.select(F.explode(F.filter(marks, lambda x: x["_filled"] | x["_newer"])).alias("c")).select("c.*")
    return step.withColumns(changes).select(*master.columns), changed


def apply_feed(master: DataFrame, feed: DataFrame, rule: FeedRule) -> tuple[DataFrame, DataFrame]:
    """One feed into the master; also (feed, value changed, marker changed) per changed company for the counters."""
    return _apply(master, {rule.name: feed}, {rule.name: rule})


def signal_feeds_apply(
    master: DataFrame, feeds: Mapping[str, DataFrame], rules: Mapping[str, FeedRule] = SIGNAL_FEEDS
) -> tuple[DataFrame, DataFrame]:
    """All feeds (name -> rows) into the master, plus one counter row per feed that changed anything.

    The feeds are reduced by key in one shuffle and joined to the master once; the counters come from that join.
    """
    merged, changed = _apply(master, feeds, rules)
    summary = changed.groupBy("feed").agg(
        F.count_if("_filled").alias("applied_value"), F.count_if("_newer").alias("applied_marker")
    )
    return merged, summary


def register_upsert(master: DataFrame, standardized: DataFrame, order: str = "row_order") -> DataFrame:
    """Insert new companies; fill four NULL columns of known ones; the last row's status always wins."""
    fill = ("name", "postort", "registration_date", "legal_form")
    agg = standardized.groupBy("orgnr").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fill],
        # A new company without a name in its first row is stored under its number and keeps that name.
        F.min_by(F.struct("name"), order).alias("_first"),
        F.max_by("company_status", order).alias("_status"),
    )
    both = master.withColumn("_old", F.lit(True)).join(agg, "orgnr", "full_outer")
    is_new = F.col("_old").isNull()
    changes = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in fill[1:]}
    changes["name"] = F.when(
        is_new, F.coalesce("_first.name", F.concat(F.lit("ORG "), F.col("orgnr")))
    ).otherwise(F.coalesce("name", "_name"))
    changes["company_status"] = F.coalesce("_status", "company_status")
    return both.withColumns(changes).select(*master.columns)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Add the rows whose key the target lacks; the first row of a repeated key."""
    cols = [c for c in target.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), order).alias("_r"))
    new = first.join(target.select(*key), list(key), "left_anti").select(*key, "_r.*")
    return target.unionByName(new.select(*target.columns))


def keyed_upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], order: str,
                 insert_only: Sequence[str] = ("created_at",)) -> DataFrame:
    """Overwrite the non-key columns of known keys (but the insert-only ones), insert the others; last row wins."""
    cols = [c for c in target.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    both = target.withColumn("_old", F.lit(True)).join(last, list(key), "full_outer")
    given, known = F.col("_r").isNotNull(), F.col("_old").isNotNull()
    pick = lambda c: (
        F.when(given & ~(known & F.lit(c in insert_only)), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c)
    )
    return both.select(*key, *[pick(c) for c in cols]).select(*target.columns)


# Check kind -> (status column or fixed word, checked_at, next_check_at, err_reason).
CHECK_KINDS = {
    "website": ("website_status", "website_checked_at", None, None),
    "email": ("email_status", "emails_checked_at", None, None),
    "site_review": ("=checked", "site_review_checked_at", None, "site_review_err_reason"),
    "hiring": ("hiring_status", "hiring_checked_at", None, "hiring_err_reason"),
    "tech": ("=checked", "tech_checked_at", None, "tech_err_reason"),
    "scb": ("scb_status", "scb_checked_at", "scb_next_check_at", "scb_err_reason"),
    "scb_discover": ("=discovered", "scb_discovered_at", None, None),
}


def checks_unpivot(companies: DataFrame, kinds: Mapping[str, tuple] = CHECK_KINDS) -> DataFrame:
    """Wide status columns -> one row per company and check kind. Kinds without any column are left out."""

    def value(c: str | None) -> Column:
        if c is None or c not in companies.columns:
            return F.lit(None).cast("string")
        return blank_to_null(F.col(c).cast("string"))

    items = []
    for kind, (status, checked, nxt, err) in kinds.items():
        if not any(c in companies.columns for c in (status, checked, nxt, err) if c):
            continue
        word = F.when(value(checked).isNotNull(), F.lit(status[1:])) if status.startswith("=") else value(status)
        items.append(
            F.struct(
                F.lit(kind).alias("check_key"), word.alias("status"), value(checked).alias("checked_at"),
                value(nxt).alias("next_check_at"), value(err).alias("err_reason"),
            )
        )
    return companies.select("orgnr", F.explode(F.array(*items)).alias("c")).select("orgnr", "c.*")


def change_log_diff(old: DataFrame, new: DataFrame, fields: Sequence[str], changed_at, source: str,
                    key: str = "orgnr") -> DataFrame:
    """One row per key and field whose text differs (NULL against NULL does not)."""
    pair = lambda c: F.struct(
        F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old_value"),
        F.col(f"n.{c}").cast("string").alias("new_value"),
    )
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    differing = F.filter(F.array(*[pair(c) for c in fields]), lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return joined.select(F.col(f"n.{key}").alias(key), F.explode(differing).alias("d")).select(
        key, "d.*", at(changed_at).alias("changed_at"), F.lit(source).alias("source")
    )


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, fields: Sequence[str], key: str = "orgnr", buckets: int = 256) -> DataFrame:
    """``bucket``, ``rows``, ``digest``: 128 bits of each bucket of keys that change with any text of ``fields``; one small row for each bucket."""
    texts = [F.col(c).cast("string") for c in (key, *fields)]
    told = [x for t in texts for x in (t.isNull(), t)]  # a NULL leaves a hash as it was
    both = [F.bit_xor(F.xxhash64(F.lit(seed), *told)) for seed in (1, 2)]
    return df.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("rows"), F.struct(both[0].alias("a"), both[1].alias("b")).alias("digest"))


def write_with_digests(df: DataFrame, path: str, fields: Sequence[str], key: str = "orgnr", buckets: int = 256) -> None:
    """A version of a table as plain Parquet in buckets of keys (``rows``), and its digests beside it (``digests``)."""
    df.withColumn("bucket", _bucket(key, buckets)).write.partitionBy("bucket").parquet(f"{path}/rows")
    spark = df.sparkSession
    written = spark.read.schema(df.withColumn("bucket", F.lit(0)).schema).parquet(f"{path}/rows")
    bucket_digests(written.select(*df.columns), fields, key, buckets).write.parquet(f"{path}/digests")


def differing_buckets(spark, old_path: str, new_path: str) -> list[int]:
    """Numbers of the buckets whose digests differ: at most as many as there are buckets."""
    old, new = (spark.read.parquet(f"{p}/digests") for p in (old_path, new_path))
    same = F.col("o.digest").eqNullSafe(F.col("n.digest")) & F.col("o.rows").eqNullSafe(F.col("n.rows"))
    differing = old.alias("o").join(new.alias("n"), "bucket", "full_outer").where(~same)
    return [r[0] for r in differing.select("bucket").orderBy("bucket").collect()]


def change_log_between(
    spark, old_path: str, new_path: str, fields: Sequence[str], changed_at, source: str, key: str = "orgnr"
) -> DataFrame:
    """``change_log_diff`` of two written versions that reads and joins only the buckets whose digests differ.

    Keys are unique in a version. Both versions need the same number of buckets.
    """
    numbers = differing_buckets(spark, old_path, new_path)
    read = lambda p: spark.read.parquet(f"{p}/rows").where(F.col("bucket").isin(numbers)).drop("bucket")
    return change_log_diff(read(old_path), read(new_path), fields, changed_at, source, key)


RUN_COLUMNS = ("scb_status", "scb_err_reason", "scb_checked_at", "scb_next_check_at")


def map_enrichment(records: DataFrame, labels: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Source field names -> 25 master columns; only ``ok`` records carry facts."""
    ok = F.col("status") == "ok"
    cols = {}
    for source, target, kind in fv.ENRICHMENT_FIELDS:
        value = int_or_null(F.col(f"`{source}`")) if kind == "int" else blank_to_null(F.col(f"`{source}`").cast("string"))
        cols[target] = F.when(ok, value)
    out = records.select("orgnr", "status", "err_reason", "record_order", *[v.alias(k) for k, v in cols.items()])
    span = span_of_code(F.col("employees_class_code"))
    out = out.withColumns({"employees_min": span["lo"], "employees_max": span["hi"]})
    for text, codes in (labels or {}).items():
        from firmweave.operators.standardize import code_table_fill

        out = code_table_fill(out, codes, f"{text}_code", text)
    return out


ENRICHED = tuple(t for _, t, _ in fv.ENRICHMENT_FIELDS) + ("employees_min", "employees_max")
_INTS = {t for _, t, k in fv.ENRICHMENT_FIELDS if k == "int"} | {"employees_min", "employees_max"}


def enrichment_merge(
    master: DataFrame, records: DataFrame, now, refresh_days: int = 90, labels: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Statistics-office records into the master, plus the run's counts (stat, value, n).

    Text fills where NULL or empty, integers only where NULL; the run columns are always overwritten.
    """
    mapped = map_enrichment(records, labels)
    best = mapped.groupBy("orgnr").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_order"))).alias(f"_{c}") for c in ENRICHED],
        F.max_by(F.struct("status", "err_reason"), "record_order").alias("_run"),
    )
    types = dict(master.dtypes)
    seen = F.col("_run").isNotNull()
    changes = {}
    for c in ENRICHED:
        empty = F.col(c).isNull() if c in _INTS else (F.col(c).isNull() | (F.col(c) == ""))
        changes[c] = F.when(empty & seen, F.col(f"_{c}").cast(types[c])).otherwise(F.col(c))
    checked = at(now)
    run = {
        "scb_status": F.col("_run.status"),
        "scb_err_reason": F.col("_run.err_reason"),
        "scb_checked_at": checked,
        "scb_next_check_at": plus(checked, days=refresh_days),
    }
    changes.update({c: F.when(seen, v.cast(types[c])).otherwise(F.col(c)) for c, v in run.items()})
    merged = master.join(best, "orgnr", "left").withColumns(changes).select(*master.columns)

    ok = F.col("status") == "ok"
    filled = lambda c: F.count_if(ok & F.col(c).isNotNull())
    bucket = ownership_bucket("private_public", "sector")
    activity = F.col("company_status_code")
    stats = {("filled", c): filled(c) for c in ENRICHED}
    stats.update({("null", c): F.count_if(ok & F.col(c).isNull()) for c in ENRICHED})
    stats.update({("status", s): F.count_if(F.col("status") == s) for s in ("ok", "not_found")})
    stats[("status", "err")] = F.count_if(~F.col("status").isin("ok", "not_found"))
    stats[("activity", "active")] = F.count_if(ok & (activity == "1"))
    stats[("activity", "deregistered")] = F.count_if(ok & (activity == "0"))
    stats[("activity", "missing")] = F.count_if(F.col("status") == "not_found")
    stats.update({("ownership", b): F.count_if(bucket == b) for b in ("privat", "offentlig", fv.UNKNOWN)})
    prefixes = {"403": "403", "429": "429", "timeout": "timeout", "5xx": "5xx"}
    failed = ~F.col("status").isin("ok", "not_found")
    stats.update({("error", k): F.count_if(failed & F.col("err_reason").startswith(p)) for k, p in prefixes.items()})
    row = mapped.agg(*[v.alias(f"{k[0]}|{k[1]}") for k, v in stats.items()])
    cells = [
        F.struct(F.lit(k[0]).alias("stat"), F.lit(k[1]).alias("value"), F.col(f"`{k[0]}|{k[1]}`").alias("n")) for k in stats
    ]
    return merged, row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
