import hashlib

from pyspark.sql import functions as F

from firmweave.operators import queues

NOW = "2024-06-01 00:00:00"


def test_due(spark, rows):
    df = spark.createDataFrame(
        [("1", "x", "2024-05-30"), ("2", " ", "2024-05-30"), ("3", "x", None), ("4", "x", "junk"), ("5", "x", "2024-03-03T00:00:00Z"), ("6", "x", "2024-03-02T23:59:59Z")],
        "orgnr string, v string, t string",
    )
    assert rows(queues.refresh_due(df, "t", 90, NOW, "v"), "orgnr") == [("2",), ("3",), ("4",), ("6",)]
    assert [r.orgnr for r in queues.due_queue_topk(df, 3, "t", 90, NOW).collect()] == ["3", "4", "6"]


def test_scheduled(spark):
    df = spark.createDataFrame([("1", "2024-05-01"), ("2", None), ("3", "2024-07-01"), ("", None), ("4", "2024-04-01")], "orgnr string, n string")
    assert [r.orgnr for r in queues.scheduled_queue_topk(df, 5, "n", NOW).collect()] == ["2", "4", "1"]


def test_shards_cover_and_match_the_definition(spark):
    keys = [str(5560000000 + i) for i in range(300)] + ["åäö", ""]
    for n in (1, 3, 7, 16):
        got = queues.with_shard(spark.createDataFrame([(k,) for k in keys], "orgnr string"), n).collect()
        for r in got:
            assert r.shard_id == int(hashlib.md5(r.orgnr.encode()).hexdigest(), 16) % n


def test_next_check(spark):
    df = spark.createDataFrame([("ok", False), ("not_found", True), ("err", True), ("err", False)], "status string, hard_error boolean")
    df = df.withColumn("checked_at", F.lit("2024-01-01").cast("timestamp"))
    assert [str(r.next_check_at.date()) for r in queues.next_check_schedule(df).collect()] == ["2024-03-31", "2024-03-31", "2024-01-15", "2024-01-03"]


def test_resume(spark, rows):
    t = spark.createDataFrame([("1",), ("2",)], "orgnr string")
    d = spark.createDataFrame([("2",), (None,)], "orgnr string")
    assert rows(queues.resume_anti_join(t, d)) == [("1",)]
