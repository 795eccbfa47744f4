import json
import random

import pytest
from pyspark.sql import functions as F

from firmweave.operators import targeting as tg
from firmweave.plans import outreach_queries

BASE = "orgnr string, name string, city string, employees int, sni_codes string, website string, emails string, website_status string, email_status string, created_at string, started_at string"


def companies(spark, *items):
    """(orgnr, overrides)"""
    names = [c.split()[0] for c in BASE.split(", ")]
    default = dict(name="N", city="Lund", employees=5, sni_codes="62010", website="https://a.se", emails="a@a.se", website_status="found", email_status="found")
    return spark.createDataFrame([tuple({**default, "orgnr": k, **o}.get(c) for c in names) for k, o in items], BASE)


def keys(df):
    return sorted(r.orgnr for r in df.collect())


def test_hard_requirements(spark):
    df = companies(
        spark, ("1", {}), ("2", {"emails": " "}), ("3", {"sni_codes": " __NO_SNI__ "}), ("4", {"sni_codes": "00000"}), ("5", {"website_status": "parked"}),
        ("6", {"email_status": None}), ("7", {"sni_codes": None}), ("8", {"emails": None}),
    )
    assert keys(tg.target_filter(df, tg.TargetSpec())) == ["1"]
    assert keys(tg.target_filter(df, tg.TargetSpec(require_sni_present=False))) == ["1", "3", "4", "7"]


def test_optional_filters(spark):
    df = companies(
        spark, ("1", {"employees": 4}), ("2", {"employees": 5}), ("3", {"employees": 300}), ("4", {"employees": None}), ("5", {"city": "Ystad"}),
        ("6", {"started_at": "2020-01-01", "created_at": "2024-01-01"}), ("7", {"created_at": "2024-01-01 00:00:00"}), ("8", {"started_at": "x", "created_at": "y"}),
    )
    some = lambda **kw: keys(tg.target_filter(df, tg.TargetSpec(**kw)))
    assert some(employees=("0-4", "250+")) == ["1", "3"]
    assert some(cities=("Ystad",)) == ["5"]
    assert some(founded_min="2021-01-01") == ["7"] and some(founded_max="2020-01-01") == ["6"]
    # The tech filter needs the column to exist.
    assert len(some(tech=True)) == 8
    with_tech = df.withColumn("tech_footprint", F.when(F.col("orgnr") == "2", "yes").otherwise(" "))
    assert keys(tg.target_filter(with_tech, tg.TargetSpec(tech=True))) == ["2"]


def test_limit_stage(spark):
    df = companies(spark, ("1", {}), ("2", {"started_at": "2024-01-01"}), ("3", {"started_at": "2024-01-01"}))
    spec = dict(founded_min="2023-01-01", limit=2)
    assert keys(tg.target_filter(df, tg.TargetSpec(**spec, limit_stage="sql"))) == ["2"]  # the limit came first
    assert keys(tg.target_filter(df, tg.TargetSpec(**spec))) == ["2", "3"]
    assert keys(tg.target_filter(df, tg.TargetSpec(founded_min="2023-01-01", limit=1))) == ["2"]


@pytest.mark.parametrize("mode,pattern,text,want", [
    ("exact", "69201", "69201", True), ("exact", "69201", " 69201 ", True), ("exact", "69201", "1,69201,2", True), ("exact", "69201", "1,69201", True), ("exact", "6920", "69201", False),
    ("exact", "69201", '["69201", "7"]', True), ("exact", "69201", '["692011"]', False), ("exact", "abc", "ABC,x", True), ("exact", "69201", "1, 69201", False),
    ("prefix", "692", "69201", True), ("prefix", "692", "1,69201", True), ("prefix", "692", '["1", "69201"]', True), ("prefix", "920", "69201", False), ("prefix", "692", "1, 69201", False),
    ("prefix", "692", None, False), ("prefix", "692", "", False),
])
def test_code_match(spark, mode, pattern, text, want):
    df = spark.createDataFrame([(text,)], "sni_codes string")
    assert df.select(tg.code_match("sni_codes", [pattern, "99999"], mode)).first()[0] is want


def test_groups(spark):
    g = spark.createDataFrame([(1, "a", "exact"), (2, "b", "prefix")], "id int, group_key string, match_mode string")
    i = spark.createDataFrame([(1, "62"), (1, ""), (2, "41")], "group_id int, pattern string")
    assert tg.industry_group_expand(g, i, ["a", "b"]) == ["62", "41"]
    assert tg.industry_group_expand(g, i, []) == []
    with pytest.raises(ValueError):
        tg.industry_group_expand(g, i, ["zzz"])


def test_group_match_takes_any_number_of_patterns(spark):
    g = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none")], "id int, group_key string")
    i = spark.createDataFrame([(1, "62"), (1, " "), (1, None), (2, "41A")], "group_id int, pattern string")
    i = i.union(spark.range(20_000).selectExpr("1", "concat('9', lpad(id, 6, '0'))"))
    texts = ["62010,1", "1,62", '["10", "623"]', "162", "", None, "41a20", "9000007", "x" * 50_000, "62010,1"]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "orgnr string, sni_codes string")
    keys = lambda out: sorted(int(r.orgnr) for r in out.collect())
    assert keys(tg.industry_group_match(df, g, i, ["a", "b"])) == [0, 1, 2, 6, 7, 9]
    assert keys(tg.industry_group_match(df, g, i, ["a"], "exact")) == [1, 7]
    assert keys(tg.industry_group_match(df, g, i, ["none"])) == [] and tg.industry_group_match(df, g, i, []) is df
    for mode in ("exact", "prefix"):
        assert keys(tg.industry_group_match(df, g, i.where("pattern < '9'"), ["a", "b"], mode)) == keys(tg.industry_code_match(df, ["62", "41A"], mode))


def tables(spark):
    leads = spark.createDataFrame(
        [(10, "1", "new"), (11, "2", "do_not_contact"), (12, "3", None), (13, "4", "new")], "id bigint, orgnr string, status string"
    ).selectExpr("id", "orgnr", "'Old' AS company_name", "'Old' AS city", "'1' AS sni_codes", "'w' AS website", "'e' AS emails", "'x' AS lead_type", "status", "TIMESTAMP'2020-01-01' AS created_at", "TIMESTAMP'2020-01-01' AS updated_at")
    links = spark.createDataFrame([(1, 10, 7)], "id bigint, lead_id bigint, campaign_id int").selectExpr(
        "id", "lead_id", "campaign_id", "3 AS current_step", "'B' AS current_variant", "TIMESTAMP'2020-01-01' AS next_send_at", "CAST(NULL AS STRING) AS stopped_reason",
        "TIMESTAMP'2020-01-01' AS created_at", "TIMESTAMP'2020-01-01' AS updated_at", "2 AS tier", "'{}' AS match_flags", "5 AS score")
    events = spark.createDataFrame([(12, "bounce"), (13, "delivered"), (None, "unsubscribe")], "lead_id bigint, type string")
    dnc = spark.createDataFrame([("6",), (None,)], "orgnr string")
    return leads, links, events, dnc


def test_suppression(spark):
    leads, _, events, dnc = tables(spark)
    c = spark.createDataFrame([(str(i),) for i in range(1, 8)], "orgnr string")
    assert keys(tg.suppression_anti_join(c, dnc, leads, events)) == ["1", "4", "5", "7"]


def test_tier_and_score(spark):
    df = tg._candidates(companies(spark, ("1", {}), ("2", {"city": " ", "sni_codes": None, "employees": None})))
    got = {r.orgnr: (r.tier, r.score, r.flags.city_ok, r.flags.tech_ok) for r in tg.tier_score(df, {f: True for f in tg.FILTERS}).collect()}
    assert got["1"] == (4, 200 + 7 + 6, True, False)  # founded, tech, review missing
    assert got["2"] == (5, 100 + 4 + 6, False, False)
    plain = {r.orgnr: (r.tier, r.score, r.flags.city_ok) for r in tg.tier_score(df, {"sni": True}).collect()}
    assert plain == {"1": (1, 511, True), "2": (2, 410, True)}


def test_load_is_repeatable(spark, rows):
    leads, links, events, dnc = tables(spark)
    c = companies(spark, *[(str(i), {}) for i in range(1, 8)])
    spec = tg.TargetSpec(cities=("Lund",), stagger_minutes=5)
    campaign = tg.Campaign(7, "customer")
    new_leads, new_links, summary = tg.lead_campaign_load(c, leads, links, events, dnc, spec, campaign, "2024-01-01")
    got = {r.orgnr: r for r in new_leads.collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5", "7"]
    assert (got["1"].id, got["1"].company_name, got["1"].status, got["1"].created_at.year, got["1"].updated_at.year) == (10, "N", "new", 2020, 2024)
    assert (got["2"].company_name, got["5"].status, got["5"].created_at.year) == ("Old", "new", 2024)
    by_lead = {r.lead_id: r for r in new_links.collect()}
    assert len(by_lead) == 4 and by_lead[10].current_step == 3 and by_lead[10].tier == 2  # an existing link is left alone
    order = [str(by_lead[got[k].id].next_send_at) for k in ("4", "5", "7")]
    assert order == ["2024-01-01 00:05:00", "2024-01-01 00:10:00", "2024-01-01 00:15:00"]
    assert json.loads(by_lead[got["5"].id].match_flags)["active_filters"] == {"city": True, "sni": True, "employees": False, "founded": False, "tech": False, "review": False}
    assert summary.first().asDict() == {"matched_after_filters": 4, "upserted_leads": 4, "t1": 4, "t2": 0, "t3": 0, "t4": 0, "t5": 0, "new_campaign_links": 3}
    again = tg.lead_campaign_load(c, new_leads, new_links, events, dnc, spec, campaign, "2024-01-01")
    assert rows(again[0]) == rows(new_leads) and rows(again[1]) == rows(new_links)
    assert again[2].first().new_campaign_links == 0


def test_queries_without_a_limit_take_all_companies(spark, monkeypatch):
    df = companies(spark, *[(f"{k:04d}", {"city": "NATION_1", "sni_codes": "62010"}) for k in range(700)])
    leads, links, events, dnc = tables(spark)
    given = {"leads": leads, "lead_campaigns": links, "outcome_events": events.selectExpr("*", "cast(NULL AS timestamp) AS created_at"), "do_not_contact": dnc}
    monkeypatch.setattr(outreach_queries, "_targets", lambda *_: df)
    monkeypatch.setattr(outreach_queries, "adapter", lambda spark, sf_dir, name: given[name])
    run = lambda name: outreach_queries.QUERIES[name](spark, "")
    assert run("target_filter").count() == 300 and run("target_filter_all").count() == 700
    assert run("lead_campaign_summary_all").first().matched_after_filters == 700
    assert run("lead_campaign_load_all").where("link_tier = 1").count() == 700


@pytest.mark.parametrize("target_rows", [1_000_000, 20])
def test_prefix_ranges_equal_brute_force(spark, target_rows):
    """Patterns inside others, equal to codes, below and above all codes; many buckets with few patterns each."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("0123é") for _ in range(rng.randint(1, n)))
    codes, patterns = {word(7) for _ in range(1500)} | {"", "~", "0"}, {word(5) + rng.choice(["", "9"]) for _ in range(60)} | {"2222", "~~"}
    found = tg.codes_with_prefix(spark.createDataFrame([(c,) for c in codes] * 2, "_code string"), spark.createDataFrame([(p,) for p in patterns], "_code string"), target_rows)
    got = [r[0] for r in found.collect()]
    assert sorted(got) == sorted(c for c in codes if any(c.startswith(p) for p in patterns))
    none = spark.createDataFrame([], "_code string")
    assert tg.codes_with_prefix(spark.createDataFrame([("1",)], "_code string"), none).count() == 0 and tg.codes_with_prefix(none, none).count() == 0


def test_many_patterns_without_more_rows(spark):
    """300,000 patterns: no step of the plan makes rows of a code's prefixes."""
    codes = spark.range(200_000).selectExpr("CAST(id * 7 AS STRING) AS _code")
    patterns = spark.range(300_000).selectExpr("CAST(id * 11 + 100000 AS STRING) AS _code")
    want = sum(any(c[:n] in seen for n in range(6, len(c) + 1)) for seen in [{str(i * 11 + 100000) for i in range(300_000)}] for c in (str(i * 7) for i in range(200_000)))
    assert tg.codes_with_prefix(codes, patterns).count() == want
