from pyspark.sql import functions as F

from firmweave import session
from firmweave.session import lookup_join, shared_dir, small_table, spread_scan, staged


def test_small_table_proves_its_size(spark):
    df = spark.range(5).withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    few = small_table(df, 5)
    assert few.proven and sorted(map(tuple, few.df.collect())) == sorted(map(tuple, df.collect()))
    many = small_table(df, 4)
    assert not many.proven and many.df.count() == 5


def test_lookup_join_all_ways(spark):
    rows = spark.range(300).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id % 40 AS STRING)) AS k")
    lookup = spark.range(30).selectExpr("CAST(id AS STRING) AS k", "id * 10 AS v").union(spark.sql("SELECT 'hot', -1L"))
    want = sorted(map(str, rows.join(lookup, "k", "left").select("id", "k", "v").collect()))
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    for limit, hot_rows, hinted in ((100, 1000, True), (5, 1000, False), (31, 1000, True), (5, 50, True), (5, 0, False)):
        out = lookup_join(rows, lookup, ["k"], ["id"], max_rows=limit, hot_rows=hot_rows).select("id", "k", "v")
        assert sorted(map(str, out.collect())) == want
        assert ("broadcast" in plan(out)) is hinted


def test_lookup_of_few_but_long_rows_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    rows, lookup = spark.range(9).selectExpr("id", "id % 3 AS k"), spark.range(3).selectExpr("id AS k", "repeat('x', 900) AS v")
    out = lookup_join(rows, lookup, ["k"], ["id"])
    assert out.where("length(v) = 900").count() == 9
    assert "broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_staged_goes_to_the_shared_folder(spark):
    out = staged(spark.range(3))
    assert out.count() == 3 and all(spark.conf.get("spark.checkpoint.dir") in f for f in out.inputFiles())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).coalesce(1).write.parquet(path)
    assert spread_scan(spark.read.parquet(path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_scan(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20
