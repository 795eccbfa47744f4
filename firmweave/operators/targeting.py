"""Targeting: pick companies, suppress, tier, stagger, load into the campaign queue."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmweave.functions import fixed_values as fv
from firmweave.functions.text import is_blank, string_array
from firmweave.functions.times import at, instant
from firmweave.operators.merge import insert_if_absent, keyed_upsert
from firmweave.operators.ranking import TARGET_ROWS, add_bucket, buckets_for, ordered_position
from firmweave.session import lookup_join, small_table, staged

FILTERS = ("city", "sni", "employees", "founded", "tech", "review")
CANDIDATE_COLUMNS = (
    "orgnr", "name", "city", "employees", "sni_codes", "website", "emails", "website_status", "email_status",
    "created_at", "started_at", "tech_flag", "review_flag",
)


@dataclass(frozen=True)
class TargetSpec:
    require_website_status: str = "found"
    require_email_status: str = "found"
    require_sni_present: bool = True
    exclude_do_not_contact: bool = True
    cities: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()
    code_groups: tuple[str, ...] = ()
    code_match: str = "prefix"  # or "exact"
    employees: tuple[str, ...] = ()  # "a-b" or "n+"
    founded_min: str | None = None
    founded_max: str | None = None
    tech: bool = False
    review: bool = False
    limit: int | None = None
    limit_stage: str = "last"  # after all filters; "sql": before the founded/tech/review/suppression filters
    stagger_minutes: int = 2

    def active(self, patterns: Sequence[str]) -> dict[str, bool]:
        return {
            "city": bool(self.cities),
            "sni": bool(patterns) or self.require_sni_present,
            "employees": bool(self.employees),
            "founded": bool(self.founded_min or self.founded_max),
            "tech": self.tech,
            "review": self.review,
        }


def employee_ranges(column: Column, ranges: Sequence[str]) -> Column:
    """OR of ``a-b`` and ``n+`` ranges."""
    tests = []
    for r in (r.strip() for r in ranges):
        if r.endswith("+"):
            tests.append(column >= int(r[:-1]))
        elif r:
            lo, hi = r.split("-", 1)
            tests.append(column.between(int(lo), int(hi)))
    return reduce(lambda a, b: a | b, tests)


def _code_pool(column: str, mode: str) -> Column:
    """The texts of a comma- or JSON-shaped text that a code may be (exact) or start (prefix), lower-case."""
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    tokens = F.array_append(F.split(text, ",", -1), F.trim(text))
    quoted = F.split(text, '"', -1)
    shown = 2 if mode == "exact" else 1  # an exact code has a closing quote
    return F.concat(tokens, F.slice(quoted, 2, F.greatest(F.size(quoted) - shown, F.lit(0))))


def code_match(column: str, patterns: Sequence[str], mode: str = "prefix") -> Column:
    """Does any code of a comma- or JSON-shaped text equal (start with) one of the patterns? ASCII case ignored."""
    wanted = [p.strip().lower() for p in patterns if p.strip()]
    pool = _code_pool(column, mode)
    if mode == "exact":
        return F.arrays_overlap(pool, string_array(wanted))
    by_length = defaultdict(list)
    for p in wanted:
        by_length[len(p)].append(p)

    def heads(n: int) -> Column:
        return F.transform(pool, lambda t: F.left(t, F.lit(n)))

    tests = [F.arrays_overlap(heads(n), string_array(group)) for n, group in sorted(by_length.items())]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def industry_code_match(df: DataFrame, patterns: Sequence[str], mode: str = "prefix", column: str = "sni_codes") -> DataFrame:
    return df.where(code_match(column, patterns, mode)) if patterns else df


MAX_PATTERNS = 10_000


def industry_group_patterns(groups: DataFrame, items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(group_key, pattern) of the asked groups."""
    wanted = groups.where(F.col("group_key").isin(list(keys)))
    return (
        wanted.join(items, wanted["id"] == items["group_id"])
        .where(F.col("pattern").isNotNull() & (F.col("pattern") != ""))
        .select("group_key", "pattern")
    )


def codes_with_prefix(codes: DataFrame, patterns: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The distinct values of ``codes`` that start with one of ``patterns`` (both with a column ``_code``, patterns not empty).

    A pattern that starts with another one adds nothing. What is left are disjoint ranges of codes: a code can only be in the range of the
    greatest pattern that isn't above it. Codes and patterns are sorted together, bucket by bucket, and each code looks at the last pattern
    before it; a bucket begins with the greatest pattern of those before. A code is one row however long it is.
    """
    shorter = F.transform(F.sequence(F.lit(1), F.length("_code") - 1), lambda n: F.left("_code", n))
    longer = patterns.where(F.length("_code") > 1).select("_code", F.explode(shorter).alias("_start"))
    covered = longer.join(patterns.select(F.col("_code").alias("_start")), "_start", "left_semi").select("_code").distinct()
    own = patterns.distinct().join(covered, "_code", "left_anti")
    both = staged(own.select("_code", F.lit(True).alias("_pattern")).unionByName(codes.distinct().select("_code", F.lit(False).alias("_pattern"))))
    buckets = buckets_for(both.count(), target_rows)
    sampled = both.select("_code").orderBy(F.xxhash64("_code"), "_code", "_pattern").limit(buckets * 8).collect()
    cuts = sorted({r[0] for r in sampled})[8::8]
    placed = add_bucket(both, "_code", string_array(cuts), len(cuts))
    # At most two buckets for a cut and one more.
    most = placed.where("_pattern").groupBy("bucket").agg(F.max("_code").alias("_most"))
    every = placed.select("bucket").distinct().join(most, "bucket", "left")
    before = F.max("_most").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    begin = every.select("bucket", before.alias("_begin"))
    inside = F.last(F.when(F.col("_pattern"), F.col("_code")), True).over(
        W.partitionBy("bucket").orderBy("_code", F.desc("_pattern")).rowsBetween(W.unboundedPreceding, W.currentRow))
    found = placed.withColumn("_last", inside).join(F.broadcast(begin), "bucket")
    return found.where(~F.col("_pattern") & F.startswith("_code", F.coalesce("_last", "_begin"))).select("_code")


def industry_group_match(
    df: DataFrame, groups: DataFrame, items: DataFrame, keys: Sequence[str], mode: str = "prefix", column: str = "sni_codes",
    key: str = "orgnr",
) -> DataFrame:
    """The rows with a code of the groups, by a join: for any number of patterns. Without keys all rows.

    The same rows as ``industry_code_match`` with the patterns of ``industry_group_expand``; groups without
    patterns match nothing.
    """
    if not keys:
        return df
    pattern = F.lower(F.trim("pattern"))
    wanted = industry_group_patterns(groups, items, keys).select(pattern.alias("_code"), F.lit(True).alias("_hit")).where("_code <> ''").distinct()
    codes = df.select(key, F.explode(F.array_distinct(_code_pool(column, mode))).alias("_code"))
    if mode != "exact":
        wanted = codes_with_prefix(codes.select("_code"), wanted.select("_code")).withColumn("_hit", F.lit(True))
    hits = lookup_join(codes, wanted, ["_code"], [key]).where("_hit").select(key).distinct()
    return df.join(hits, key, "left_semi")


def industry_group_expand(groups: DataFrame, items: DataFrame, keys: Sequence[str]) -> list[str]:
    """The patterns as filter values. Raises when the groups have none, or more than a filter should hold:
    ``industry_group_match`` takes any number."""
    if not keys:
        return []
    found = small_table(industry_group_patterns(groups, items, keys).orderBy("group_key", "pattern"), MAX_PATTERNS)
    if not found.proven:
        raise ValueError(f"more than {MAX_PATTERNS} patterns in groups {list(keys)}: use industry_group_match")
    patterns = found.local.column("pattern").to_pylist()
    if not patterns:
        raise ValueError(f"no patterns found for groups {list(keys)}")
    return patterns


def _candidates(companies: DataFrame) -> DataFrame:
    """The columns targeting reads; those a layout lacks are NULL."""
    aliases = {"tech_flag": ("tech_footprint_status", "tech_footprint"), "review_flag": ("website_review_status", "site_review_status")}

    def pick(c: str) -> Column:
        for name in (c, *aliases.get(c, ())):
            if name in companies.columns:
                return F.col(name).alias(c)
        return F.lit(None).cast("string").alias(c)

    return companies.select(*[pick(c) for c in CANDIDATE_COLUMNS])


def founded_at(df: DataFrame) -> Column:
    return F.coalesce(instant("started_at"), instant("created_at"))


def target_filter(companies: DataFrame, spec: TargetSpec, patterns: Sequence[str] = ()) -> DataFrame:
    """Companies that meet the spec, ordered by key. With a limit this is a distributed top-n, else no sort."""
    df = _eligible(companies, spec, patterns)
    return df.orderBy("orgnr").limit(spec.limit) if spec.limit is not None and spec.limit_stage == "last" else df


def _eligible(companies: DataFrame, spec: TargetSpec, patterns: Sequence[str]) -> DataFrame:
    """As ``target_filter``, but for a limit that comes last."""
    df = _candidates(companies)
    keep = (
        (F.col("website_status") == spec.require_website_status)
        & (F.col("email_status") == spec.require_email_status)
        & ~is_blank("emails")
    )
    if spec.require_sni_present:
        code = F.trim(F.coalesce(F.col("sni_codes"), F.lit("")))
        keep = keep & ~code.isin("", fv.NO_SNI, "00000")
    if spec.cities:
        keep = keep & F.col("city").isin(list(spec.cities))
    if spec.employees:
        keep = keep & employee_ranges(F.col("employees"), spec.employees)
    patterns = [*spec.codes, *patterns]
    if patterns:
        keep = keep & code_match("sni_codes", patterns, spec.code_match)
    df = df.where(keep)
    if spec.limit is not None and spec.limit_stage == "sql":
        df = df.orderBy("orgnr").limit(spec.limit)
    if spec.founded_min or spec.founded_max:
        born = founded_at(df)
        if spec.founded_min:
            df = df.where(born >= at(spec.founded_min))
        if spec.founded_max:
            df = df.where(born <= at(spec.founded_max))
    if spec.tech and any(c in companies.columns for c in ("tech_footprint_status", "tech_footprint")):
        df = df.where(~is_blank("tech_flag"))
    if spec.review and any(c in companies.columns for c in ("website_review_status", "site_review_status")):
        df = df.where(~is_blank("review_flag"))
    return df


def suppression_anti_join(candidates: DataFrame, do_not_contact: DataFrame, leads: DataFrame, events: DataFrame) -> DataFrame:
    """Without companies on the list, leads marked do_not_contact, or leads with an unsubscribe or bounce."""
    hit_leads = events.where(F.col("type").isin(*fv.BLOCKING_EVENTS)).select(F.col("lead_id").alias("id")).distinct()
    blocked = (
        do_not_contact.select("orgnr")
        .unionByName(leads.where(F.col("status") == "do_not_contact").select("orgnr"))
        .unionByName(leads.join(hit_leads, "id", "left_semi").select("orgnr"))
    )
    return candidates.join(blocked, "orgnr", "left_anti")


def tier_score(candidates: DataFrame, active: dict[str, bool]) -> DataFrame:
    """Adds ``tier`` (1 + missing data of active filters, at most 5), ``score`` and the ``flags`` struct."""
    present = {
        "city": ~is_blank("city"),
        "sni": ~is_blank("sni_codes"),
        "employees": F.col("employees").isNotNull(),
        "founded": founded_at(candidates).isNotNull(),
        "tech": ~is_blank("tech_flag"),
        "review": ~is_blank("review_flag"),
    }
    used = [f for f in FILTERS if active.get(f)]
    misses = reduce(lambda a, b: a + b, [(~present[f]).cast("int") for f in used], F.lit(0))
    flags = F.struct(*[(present[f] if f in used else F.lit(True)).alias(f"{f}_ok") for f in FILTERS])
    tier = F.least(F.lit(1) + F.col("_misses"), F.lit(5))
    score = (F.lit(6) - F.col("tier")) * 100 + F.greatest(F.lit(0), F.lit(10) - F.col("_misses")) + len(used)
    return (
        candidates.withColumn("_misses", misses)
        .withColumn("tier", tier)
        .withColumn("score", score)
        .withColumn("flags", flags)
        .drop("_misses")
    )


def stagger_schedule(df: DataFrame, base, minutes: int, key: str = "orgnr") -> DataFrame:
    """next_send_at = base + position in key order x minutes. Hand in a stored table: it is read more than once."""
    placed = ordered_position(df, key)
    return placed.withColumn(
        "next_send_at", F.timestamp_seconds(F.unix_seconds(at(base)) + F.col("position").cast("bigint") * (60 * max(minutes, 0)))
    ).drop("position")


def stable_id(key: Column | str) -> Column:
    """A repeatable 60-bit id for a new row, from its key."""
    text = F.md5((F.col(key) if isinstance(key, str) else key).cast("binary"))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Campaign:
    id: int
    audience: str


def lead_campaign_load(
    companies: DataFrame,
    leads: DataFrame,
    links: DataFrame,
    events: DataFrame,
    do_not_contact: DataFrame,
    spec: TargetSpec,
    campaign: Campaign,
    now,
    group_patterns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads, campaign links, summary row) after loading the spec's companies into the campaign."""
    patterns = [*spec.codes, *group_patterns]
    active = spec.active(patterns)
    picked = _eligible(companies, spec, group_patterns)
    if spec.exclude_do_not_contact:
        picked = suppression_anti_join(picked, do_not_contact, leads, events)
    if spec.limit is not None and spec.limit_stage == "last":
        picked = picked.orderBy("orgnr").limit(spec.limit)
    # Read by the leads, the links and the summary: computed once.
    ready = staged(stagger_schedule(staged(tier_score(picked, active)), now, spec.stagger_minutes))

    stamp = at(now)
    rows = ready.select(
        stable_id("orgnr").alias("id"), "orgnr", F.col("name").alias("company_name"),
        F.coalesce("city", F.lit("")).alias("city"), "sni_codes", "website", "emails",
        F.lit(campaign.audience).alias("lead_type"), F.lit("new").alias("status"),
        stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(0).alias("_o"),
    )
    new_leads = keyed_upsert(leads, rows, ["orgnr"], "_o", insert_only=("id", "status", "created_at"))

    constants = {
        "active_filters": F.struct(*[F.lit(active[f]).alias(f) for f in FILTERS]),
        "sni_groups": string_array(spec.code_groups),
        "sni_manual": string_array(spec.codes),
        "employees_ranges": string_array(spec.employees),
        "founded_min": F.lit(spec.founded_min or ""),
        "founded_max": F.lit(spec.founded_max or ""),
    }
    flags = F.to_json(F.struct(
        *[F.col(f"flags.{f}_ok").alias(f"{f}_ok") for f in FILTERS], *[v.alias(k) for k, v in constants.items()]
    ))
    # A known lead keeps its id, a new one has the id it was just given.
    known = leads.select("orgnr", F.col("id").alias("_known_id"))
    with_id = ready.join(known, "orgnr", "left").withColumn("lead_id", F.coalesce("_known_id", stable_id("orgnr")))
    link_rows = with_id.select(
        F.conv(F.substring(F.md5(F.concat_ws("/", F.col("lead_id").cast("string"), F.lit(str(campaign.id))).cast("binary")), 1, 15), 16, 10)
        .cast("bigint").alias("id"),
        "lead_id", F.lit(campaign.id).alias("campaign_id"), F.lit(1).alias("current_step"),
        F.lit(None).cast("string").alias("current_variant"), "next_send_at", F.lit(None).cast("string").alias("stopped_reason"),
        stamp.alias("created_at"), stamp.alias("updated_at"), "tier", flags.alias("match_flags"), "score", F.lit(0).alias("_o"),
    )
    all_links = insert_if_absent(links, link_rows, ["lead_id", "campaign_id"], "_o")
    fresh = link_rows.join(links.select("lead_id", "campaign_id"), ["lead_id", "campaign_id"], "left_anti")
    tally = ready.select("tier", F.lit(0).alias("linked")).unionByName(
        fresh.select(F.lit(None).cast("int").alias("tier"), F.lit(1).alias("linked"))
    )
    summary = tally.agg(
        F.count("tier").alias("matched_after_filters"), F.count("tier").alias("upserted_leads"),
        *[F.count_if(F.col("tier") == t).alias(f"t{t}") for t in range(1, 6)],
        F.count_if(F.col("linked") == 1).alias("new_campaign_links"),
    )
    return new_leads, all_links, summary
