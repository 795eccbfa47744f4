"""Feed files with values of other types, from the file to the rows that the merge reads."""

import json
import re
import time
from pathlib import Path

from pyspark.sql import functions as F

from firmweave.operators import merge, pages
from firmweave.plans import register_queries
from firmweave.sources import feeds

TIME = "2024-01-01T00:00:00Z"


def written(tmp_path, rows):
    path = tmp_path / "feed.ndjson"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return [str(path)]


def test_hiring_and_site_review_from_files(spark, tmp_path):
    hiring = [
        {"orgnr": "1", "checked_at": TIME, "hiring_status": "yes", "hiring_count": "3", "evidence_url": "https://e", "external_job_urls": ["https://x", "https://x", ""]},
        {"orgnr": "2", "checked_at": TIME, "hiring_status": "no", "hiring_count": 2.0, "external_job_urls": "text"},
        "[1]", "{}", "broken",
    ]
    rows, rejects = feeds.feed_scan(spark, written(tmp_path, hiring), "hiring")
    ready = {r.orgnr: r for r in merge.prepare_feed(rows, merge.SIGNAL_FEEDS["hiring"]).collect()}
    assert ready["1"].hiring_urls == '["https://x","https://e"]' and ready["1"].hiring_count == 3
    assert ready["2"].hiring_urls is None and ready["2"].hiring_count == 2
    assert rejects.count() == 3

    review = [{"orgnr": "1", "checked_at": TIME, "site_score": "7", "site_flags": ["no_https", "low_cta"]}, {"orgnr": "2", "checked_at": TIME, "site_score": 7.6}]
    (tmp_path / "b").mkdir()
    rows, rejects = feeds.feed_scan(spark, written(tmp_path / "b", review), "site_review")
    ready = {r.orgnr: r for r in merge.prepare_feed(rows, merge.SIGNAL_FEEDS["site_review"]).collect()}
    assert ready["1"].site_flags == '["no_https","low_cta"]' and ready["1"].site_score == 7 and ready["2"].site_score == 7
    assert rejects.count() == 0


def test_address_pattern_is_linear_and_finds_the_same(spark):
    text = "x" * 1_000_000 + " info@example.se, a@b.co-x@y.se"
    start = time.time()
    found = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(pages._EMAIL), F.lit(0))).first()[0]
    assert found == ["info@example.se", "a@b.co", "-x@y.se"] and time.time() - start < 20


def test_feeds_are_written_in_order_to_a_file_for_each_split(spark, tmp_path):
    rows = spark.range(300).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id) AS ts", "id % 7 AS user_id", "'view' AS event_type", "CAST(id AS double) AS value", "uuid() AS props")
    rows.coalesce(1).sortWithinPartitions(F.desc("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        roots = list(register_queries._feed_portions(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for portion in range(3):
        files = sorted((Path(roots[-1]) / "website" / f"portion_{portion}").glob("part-*"))
        found = [int(re.search(r"https://f(\d+)", line)[1]) for f in files for line in f.read_text().splitlines()]
        assert found == list(range(portion, 300, 3))
        assert len(files) > 2
