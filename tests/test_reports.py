import pytest
from pyspark.sql import functions as F

from firmweave.operators import reports as rp

NOW = "2024-01-31 00:00:00"


def test_coverage_and_distribution(spark, rows):
    df = spark.createDataFrame([("a", 1), (" ", None), (None, 3), ("a ", None)], "t string, n int")
    assert rows(rp.column_coverage(df, ["t"], ["n"])) == [("n", 2, 50.0), ("t", 2, 50.0)]
    assert rows(rp.column_coverage(df.where("false"), ["t"])) == [("t", 0, 0.0)]
    assert [tuple(r) for r in rp.value_distribution(df, "t", 5).collect()] == [("(empty)", 2), ("a", 2)]
    assert [tuple(r) for r in rp.top_n_groups(df, "t", 5).collect()] == [("a", 2)]


def test_freshness(spark):
    stamps = ["2024-01-30 00:00:00", "2024-01-29 23:59:59", "2024-01-24 00:00:00", "2024-01-01 00:00:00", "2023-01-01 00:00:00", None]
    df = spark.createDataFrame([(s,) for s in stamps], "t string").withColumn("t", F.col("t").cast("timestamp"))
    r = rp.freshness_windows(df, "t", NOW).first()
    assert (r.total, r.last_24h, r.last_7d, r.last_30d, r.never, str(r.newest)) == (6, 1, 3, 4, 1, "2024-01-30 00:00:00")


def messages(spark, *items):
    return spark.createDataFrame(list(items), "id int, status string, error string, created_at string, sent_at string").withColumns(
        {c: F.col(c).cast("timestamp") for c in ("created_at", "sent_at")})


def test_delivery_classes_are_exclusive(spark):
    m = messages(
        spark, (1, "sent", "", NOW, None), (2, "sent", "", NOW, None), (3, "queued", None, NOW, None), (4, "queued", " ", NOW, None), (5, "draft", None, NOW, None),
        (6, "sent", "boom", NOW, None), (7, "draft", None, NOW, None), (8, None, None, NOW, None),
    )
    e = spark.createDataFrame([(1, "delivered"), (2, "delivered"), (2, "complaint"), (4, "opened"), (7, "accepted"), (None, "bounce"), (None, "delivered")], "message_id int, type string")
    got = {r.id: r.delivery_class for r in rp.classify_messages(m, e).collect()}
    assert got == {1: "DELIVERED", 2: "FAILED", 3: "QUEUED", 4: "UNKNOWN", 5: "UNKNOWN", 6: "FAILED", 7: "ACCEPTED", 8: "UNKNOWN"}
    counts = rp.delivery_class(m, e).collect()
    assert sum(r.n for r in counts) == 8 and len(counts) == 5


def test_stale_accepted(spark):
    m = messages(spark, (1, "", "", "2024-01-30 17:59:59", None), (2, "", "", "2024-01-30 18:00:00", None), (3, "", "", "2024-01-01", "2024-01-30 23:00:00"), (4, "", "", "2024-01-29", None), (5, "", "", "2024-01-01", None))
    e = spark.createDataFrame([(1, "sent"), (2, "sent"), (3, "accepted"), (4, "accepted"), (5, "accepted"), (5, "delivered")], "message_id int, type string")
    assert {r.older_than_hours: r.n for r in rp.stale_accepted(m, e, NOW).collect()} == {6: 2, 24: 1}


@pytest.mark.parametrize("sent,bounces,complaints,dns,verdict", [
    (100, 0, 0, (True, True, False), "OK"), (100, 5, 0, (True, True, False), "WARNING"), (100, 10, 0, (True, True, False), "DEAD"), (19, 19, 0, (True, True, False), "OK"),
    (100, 0, 1, (True, True, False), "DEAD"), (99, 0, 9, (True, True, False), "OK"), (1000, 0, 3, (True, True, False), "WARNING"), (0, 0, 0, (True, False, False), "WARNING"), (0, 0, 0, (True, True, True), "DEAD"),
])
def test_verdict(spark, sent, bounces, complaints, dns, verdict):
    m = spark.range(sent).selectExpr("id", "'sent' AS status", f"TIMESTAMP'{NOW}' AS created_at")
    e = spark.range(bounces).selectExpr("'bounce' AS type", f"TIMESTAMP'{NOW}' AS created_at").union(spark.range(complaints).selectExpr("'complaint'", f"TIMESTAMP'{NOW}'"))
    d = spark.createDataFrame([dns], "spf boolean, dmarc boolean, listed boolean")
    assert rp.reputation_verdict(m, e, d, NOW).first().verdict == verdict


def test_small_reports(spark, rows):
    links = spark.createDataFrame([(1, 1, 1, 1), (2, 2, 1, 3), (3, 3, 9, None)], "id int, lead_id int, campaign_id int, tier int").selectExpr(
        "*", "1 AS current_step", "'A' AS current_variant", "CAST(NULL AS TIMESTAMP) AS next_send_at", "'' AS stopped_reason")
    camp = spark.createDataFrame([(1, "c1")], "id int, name string")
    assert rows(rp.sequence_queue_report(links, camp)) == [("c1", 2)]
    assert sorted(r.id for r in rp.latest_links(links, camp, 5).collect()) == [1, 2]
    assert rows(rp.tier_summary(links)) == [(1, 1), (2, 0), (3, 1), (4, 0), (5, 0)]


def test_reconciliation(spark):
    files = spark.createDataFrame([("websites", "a", 3), ("websites", "b", 4), ("emails", "c", 1)], "feed string, file string, n int")
    checks = spark.createDataFrame([("1", "website", "2024-01-01"), ("1", "website", "2024-01-02"), ("2", "website", None), ("1", "tech", "2024-01-03"), ("1", "other", "2024-01-03")], "orgnr string, check_key string, checked_at string")
    got = {r.feed: tuple(r)[1:] for r in rp.feed_reconciliation(files, checks, {"websites": "website", "emails": "email", "tech": "tech"}).collect()}
    assert got == {"websites": (2, 7, 1, "2024-01-02"), "emails": (1, 1, 0, None), "tech": (0, 0, 1, "2024-01-03")}


def test_top_values_of_a_million_values_are_exact(spark, rows):
    """Few frequent values among a million that occur once: counted without a full count; ties, and no frequent value at all, too."""
    df = spark.range(2_000_000).selectExpr(
        "CASE WHEN id % 10 < 2 THEN 'a' WHEN id % 10 = 2 THEN ' b ' WHEN id % 10 = 3 THEN 'c' WHEN id % 20 = 4 THEN NULL WHEN id % 20 = 14 THEN '  ' ELSE CAST(id AS STRING) END AS v", "CAST(id % 50000 AS STRING) AS flat")
    for n, column in ((2, "v"), (3, "v"), (4, "v"), (6, "v"), (5, "flat")):
        assert rows(rp.top_values(df, column, n)) == rows(rp.value_distribution(df, column, n))
    plan = rp.top_values(df, "v", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan  # only what was counted is read
    few = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    assert rows(rp.top_values(few, "v", 5)) == rows(rp.value_distribution(few, "v", 5)) == [("(empty)", 1), ("x", 2)]
    assert rp.top_values(few.limit(0), "v", 5).count() == 0
