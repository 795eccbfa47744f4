import json

from firmweave.operators.merge import SIGNAL_FEEDS, apply_feed
from firmweave.sources.feeds import feed_scan
from firmweave.sources.snapshots import TableSnapshots
from firmweave.streaming.feed_stream import incremental_feed_apply


def test_stream_equals_batch_after_restarts(spark, tmp_path, rows):
    feed = tmp_path / "feed"
    feed.mkdir()
    store = TableSnapshots(spark, str(tmp_path / "master"))
    start = spark.range(6).selectExpr("CAST(id AS STRING) AS orgnr", "CAST(NULL AS STRING) AS website", "CAST(NULL AS STRING) AS website_status", "CAST(NULL AS TIMESTAMP) AS website_checked_at")
    store.write(start)
    run = lambda: incremental_feed_apply(spark, str(feed), store, str(tmp_path / "ckpt"), "website").awaitTermination()
    for batch in range(3):
        lines = [
            json.dumps({"orgnr": str(i % 6), "found_website": f"https://{batch}-{i}.se" if i % 2 else "", "status": f"s{batch}{i}", "checked_at": f"2024-0{1 + (batch * 5 + i) % 9}-01T00:00:00Z"})
            for i in range(batch, 9)
        ]
        (feed / f"part_{batch}.ndjson").write_text("\n".join([*lines, "{bad", ""]) + "\n")
        run()
    assert store.versions() == [0, 1, 2, 3]
    run()  # nothing new
    assert store.versions() == [0, 1, 2, 3]
    batch_rows, _ = feed_scan(spark, [str(feed / "*.ndjson")], "website")
    whole, _ = apply_feed(start, batch_rows, SIGNAL_FEEDS["website"])
    assert rows(store.read()) == rows(whole)
