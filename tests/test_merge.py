import re

import random

import pytest
from pyspark.sql import functions as F

from firmweave.operators import merge

WIDE = (
    "orgnr string, website string, website_status string, website_checked_at timestamp, emails string, email_status string, "
    "emails_checked_at timestamp, site_score int, site_flags string, site_review_err_reason string, site_review_checked_at timestamp"
)


def master(spark, *keys, **cols):
    df = spark.createDataFrame([(k,) for k in keys], "orgnr string")
    for part in WIDE.split(", ")[1:]:
        name, kind = part.split()
        df = df.withColumn(name, F.lit(cols.get(name)).cast(kind))
    return df


def web(spark, *items):
    """(order, orgnr, website, status, checked_at)"""
    return spark.createDataFrame(list(items), "feed_order int, orgnr string, found_website string, status string, checked_at string")


def apply_web(m, feed):
    return merge.apply_feed(m, feed, merge.SIGNAL_FEEDS["website"])[0]


def state(df):
    r = df.first()
    return r.website, r.website_status, r.website_checked_at and r.website_checked_at.isoformat()


def test_value_and_marker_are_independent(spark):
    feed = web(
        spark, (1, "1", "", "NOT_FOUND", "2024-03-01T00:00:00Z"), (2, "1", "https://first.se", None, None),
        (3, "1", "https://later.se", "Found", "2024-02-01T00:00:00+00:00"), (4, "9", "https://x.se", "found", "2024-01-01"),
    )
    out = apply_web(master(spark, "1"), feed)
    # The first non-blank value wins though its row has no time; the newest marker wins though it has no value.
    assert out.count() == 1
    assert state(out) == ("https://first.se", "not_found", "2024-03-01T00:00:00")


def test_status_defaults_to_checked(spark):
    assert state(apply_web(master(spark, "1"), web(spark, (1, " 1 ", None, " ", "2024-01-01T00:00:00Z"))))[1] == "checked"


def test_equal_instant_is_not_newer(spark):
    m = master(spark, "1", website_status="old", website_checked_at="2024-01-01 12:00:00")
    assert state(apply_web(m, web(spark, (1, "1", "", "same", "2024-01-01T14:00:00+02:00"))))[1] == "old"
    assert state(apply_web(m, web(spark, (1, "1", "", "later", "2024-01-01T14:00:01+02:00"))))[1] == "later"


def test_tie_keeps_the_earlier_row(spark):
    feed = web(spark, (2, "1", "", "second", "2024-01-01"), (1, "1", "", "first", "2024-01-01T00:00:00Z"))
    assert state(apply_web(master(spark, "1"), feed))[1] == "first"


def test_unparsable_times(spark):
    m = master(spark, "1", website_status="old").withColumn("website_checked_at", F.lit("rubbish"))
    out = apply_web(m, web(spark, (1, "1", "", "bad", "soon"), (2, "1", "", "good", "2024-01-01T00:00:00Z"))).first()
    assert (out.website_status, out.website_checked_at) == ("good", "2024-01-01T00:00:00Z")


def test_apply_twice_and_shuffled(spark, rows):
    rng = random.Random(7)
    items = [
        (i, str(rng.randrange(20)), rng.choice(["", f"https://w{i}.se"]), rng.choice(["a", "b"]), f"2024-01-{1 + i % 28:02d}T{i % 24:02d}:{i % 60:02d}:00Z")
        for i in range(400)
    ]
    m = master(spark, *[str(k) for k in range(25)])
    once = apply_web(m, web(spark, *items))
    again = apply_web(once, web(spark, *items))
    mixed = items[:]
    rng.shuffle(mixed)
    assert rows(once) == rows(again) == rows(apply_web(m, web(spark, *mixed)))


def test_against_replay_with_one_hot_key(spark):
    rng = random.Random(3)
    items = [
        (i, "hot" if i % 3 == 0 else str(rng.randrange(9)), rng.choice(["", " ", f"https://w{i}.se"]), f"s{i}", rng.choice([None, f"2024-01-{rng.randrange(1, 9):02d}"]))
        for i in range(300)
    ]
    want = {}
    for order, key, site, status, at in items:
        w = want.setdefault(key, [None, None, None])
        if site.strip() and not w[0]:
            w[0] = site
        if at and (w[2] is None or at > w[2]):
            w[1], w[2] = status, at
    out = apply_web(master(spark, "hot", *map(str, range(9))), web(spark, *items)).collect()
    for r in out:
        site, status, at = want.get(r.orgnr, [None, None, None])
        assert (r.website, r.website_status, r.website_checked_at and r.website_checked_at.strftime("%Y-%m-%d")) == (site, status, at)


def test_feeds_that_need_a_time_and_counters(spark):
    review = spark.createDataFrame(
        [(1, "1", "2024-01-01", 5, '["x"]', None), (2, "2", None, 7, None, ""), (3, "1", "2023-01-01", 9, None, "")],
        "feed_order int, orgnr string, checked_at string, site_score int, site_flags string, err_reason string",
    )
    out, summary = merge.signal_feeds_apply(
        master(spark, "1", "2"), {"site_review": review, "website": web(spark, (1, "2", "https://a.se", "x", None))}
    )
    got = {r.orgnr: (r.site_score, r.site_flags, r.site_review_err_reason, r.website) for r in out.collect()}
    assert got == {"1": (5, '["x"]', "", None), "2": (None, None, None, "https://a.se")}
    assert {r.feed: (r.applied_value, r.applied_marker) for r in summary.collect()} == {"site_review": (0, 1), "website": (1, 0)}


def test_feeds_join_the_master_once_and_set_different_columns(spark):
    feeds = {"website": web(spark, (1, "1", "https://a.se", "x", "2024-01-01"))}
    review = spark.createDataFrame([(1, "2", "2024-01-01", 5, "[]", None)], "feed_order int, orgnr string, checked_at string, site_score int, site_flags string, err_reason string")
    out, _ = merge.signal_feeds_apply(master(spark, "1", "2"), {**feeds, "site_review": review})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Aggregate ") == 1
    clash = merge.FeedRule("other", "emails_checked_at", {"status": "website_status"})
    with pytest.raises(ValueError, match="website_status"):
        merge.signal_feeds_apply(master(spark, "1"), {**feeds, "other": feeds["website"]}, {**merge.SIGNAL_FEEDS, "other": clash})


def test_job_url_text(spark):
    df = spark.createDataFrame([([" a ", "b", "a"], "b"), (None, " "), (None, "e")], "x array<string>, e string")
    assert [r[0] for r in df.select(merge.job_url_text(F.col("x"), F.col("e"))).collect()] == ['["a","b"]', None, '["e"]']


def test_register_upsert(spark, rows):
    kind = "orgnr string, name string, postort string, registration_date string, legal_form string, company_status string"
    m = spark.createDataFrame([("1", None, "Lund", None, None, "active"), ("3", "C", None, None, None, "inactive")], kind)
    s = spark.createDataFrame(
        [("1", "A", "Ystad", None, "AB", "active", 1), ("1", "B", None, "2001", None, "inactive", 2), ("2", None, None, None, None, "active", 3), ("2", "Late", "Kivik", None, None, "active", 4)],
        kind + ", row_order int",
    )
    assert rows(merge.register_upsert(m, s)) == [
        ("1", "A", "Lund", "2001", "AB", "inactive"), ("2", "ORG 2", "Kivik", None, None, "active"), ("3", "C", None, None, None, "inactive"),
    ]


def test_insert_if_absent_and_upsert(spark, rows):
    t = spark.createDataFrame([("1", 2020, 5, "x")], "k string, y int, v int, created_at string")
    r = spark.createDataFrame([("1", 2020, 6, "n", 1), ("1", 2021, 7, "n", 2), ("1", 2021, 8, "n", 1)], "k string, y int, v int, created_at string, o int")
    once = merge.insert_if_absent(t, r, ["k", "y"], "o")
    assert rows(once) == [("1", 2020, 5, "x"), ("1", 2021, 8, "n")]
    assert rows(merge.insert_if_absent(once, r, ["k", "y"], "o")) == rows(once)
    up = merge.keyed_upsert(t, r, ["k", "y"], "o")
    assert rows(up) == [("1", 2020, 6, "x"), ("1", 2021, 7, "n")]
    assert up.groupBy("k", "y").count().where("count > 1").count() == 0
    # NULL overwrites too.
    null = spark.createDataFrame([("1", 2020, None, "n", 1)], "k string, y int, v int, created_at string, o int")
    assert rows(merge.keyed_upsert(t, null, ["k", "y"], "o")) == [("1", 2020, None, "x")]


def test_checks_unpivot(spark, rows):
    df = spark.createDataFrame([("1", " ", "2024", "2024", None), ("2", "found", None, " ", "x")], "orgnr string, website_status string, website_checked_at string, scb_discovered_at string, tech_err_reason string")
    assert rows(merge.checks_unpivot(df), "orgnr", "check_key", "status", "checked_at", "err_reason") == [
        ("1", "scb_discover", "discovered", "2024", None), ("1", "tech", None, None, None), ("1", "website", None, "2024", None),
        ("2", "scb_discover", None, None, None), ("2", "tech", None, None, "x"), ("2", "website", "found", None, None),
    ]


def test_change_log(spark, rows):
    old = spark.createDataFrame([("1", None, "a", 5), ("2", None, None, None)], "orgnr string, x string, y string, n int")
    new = spark.createDataFrame([("1", "v", "a", 6), ("2", None, None, None)], "orgnr string, x string, y string, n int")
    out = merge.change_log_diff(old, new, ["x", "y", "n"], "2024-01-01", "t")
    assert rows(out, "orgnr", "field", "old_value", "new_value") == [("1", "n", "5", "6"), ("1", "x", None, "v")]


def test_enrichment_asymmetry(spark):
    from firmweave.functions.fixed_values import ENRICHMENT_FIELDS

    assert len(ENRICHMENT_FIELDS) == 23 and len(merge.ENRICHED) == 25
    values = {"Företagsnamn": "New", "Stkl, kod": "2", "Antal arbetsställen": "7", "PostOrt": "Lund", "Företagsstatus, kod": "1"}
    rec = lambda o, status, err, vals: (o, status, err, 1, *[vals.get(f) for f, _, _ in ENRICHMENT_FIELDS])
    schema = "orgnr string, status string, err_reason string, record_order int, " + ", ".join(f"`{f}` string" for f, _, _ in ENRICHMENT_FIELDS)
    records = spark.createDataFrame([rec("1", "ok", "", values), rec("2", "err", "403 x", values)], schema)
    cols = {t: ("int" if k == "int" else "string") for _, t, k in ENRICHMENT_FIELDS}
    m = spark.createDataFrame([("1",), ("2",), ("3",)], "orgnr string").select(
        "orgnr", *[F.lit(None).cast(k).alias(t) for t, k in cols.items()], F.lit(0).alias("employees_min"), F.lit(None).cast("int").alias("employees_max"),
        *[F.lit(None).cast("string").alias(c) for c in ("scb_status", "scb_err_reason")], *[F.lit(None).cast("timestamp").alias(c) for c in ("scb_checked_at", "scb_next_check_at")],
    ).withColumns({"name": F.lit(""), "postort": F.lit(" ")})
    out, stats = merge.enrichment_merge(m, records, "2024-01-01")
    got = {r.orgnr: r for r in out.collect()}
    # Text fills when NULL or empty (spaces stay), integers only when NULL.
    assert (got["1"].name, got["1"].postort, got["1"].workplaces_count, got["1"].employees_min, got["1"].employees_max) == ("New", " ", 7, 0, 9)
    assert (got["2"].name or "", got["2"].scb_status, got["2"].scb_err_reason, str(got["2"].scb_next_check_at)) == ("", "err", "403 x", "2024-03-31 00:00:00")
    assert got["3"].scb_status is None and got["3"].name == ""
    n = {(r.stat, r.value): r.n for r in stats.collect()}
    assert n["status", "ok"] == 1 and n["error", "403"] == 1 and n["activity", "active"] == 1 and n["filled", "postort"] == 1


def test_changes_between_versions_read_differing_buckets_only(spark, tmp_path, rows):
    old = spark.range(500).selectExpr("CAST(id AS STRING) AS orgnr", "CAST(id % 7 AS STRING) AS city", "CAST(NULL AS INT) AS employees")
    new = old.selectExpr("orgnr", "CASE WHEN orgnr = '77' THEN NULL ELSE city END AS city", "CASE WHEN orgnr IN ('77', '3') THEN 5 END AS employees").where("orgnr <> '400'")
    paths = [str(tmp_path / n) for n in "ab"]
    for df, p in zip((old, new), paths):
        merge.write_with_digests(df, p, ["city", "employees"], buckets=32)
    got = merge.change_log_between(spark, *paths, ["city", "employees"], "2024-01-01 00:00:00", "x")
    plan = got._jdf.queryExecution().executedPlan().toString()  # before a run: afterwards the text holds the initial and the final plan
    assert rows(got) == rows(merge.change_log_diff(old, new, ["city", "employees"], "2024-01-01 00:00:00", "x")) and got.count() == 3
    buckets = sorted({r[0] for r in spark.read.parquet(f"{paths[0]}/rows").where("orgnr IN ('77', '3', '400')").select("bucket").collect()})
    scans = re.findall(r"PartitionFilters: \[([^\n]*?)\], PushedFilters", plan)
    assert len(scans) == 2 and all("bucket" in x for x in scans), plan
    assert merge.differing_buckets(spark, *paths) == buckets
    assert merge.differing_buckets(spark, paths[0], paths[0]) == []
    assert merge.change_log_between(spark, paths[0], paths[0], ["city", "employees"], "2024-01-01 00:00:00", "x").count() == 0


def test_digests_tell_where_a_null_stands(spark):
    of = lambda a, b: merge.bucket_digests(spark.createDataFrame([("1", a, b)], "orgnr string, x string, y string"), ["x", "y"]).first().digest
    assert len({of("a", None), of(None, "a"), of("a", "a"), of(None, None), of("", None)}) == 5
