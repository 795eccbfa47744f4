"""Headline queries, timed: one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; its time is the median. A query is timed from
building its plan to its last row, written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from firmweave.plans import catalog  # noqa: E402
from firmweave.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "health_score health_score_split winsorize_by_year rank_score_by_year latest_financial_snapshot filing_fact_extract filing_validate "
    "signal_feeds_apply signal_feeds_counters incremental_feed_apply register_bulk_scan newest_wins_merge keyed_upsert register_upsert enrichment_merge "
    "due_queue_topk stable_hash_shard lead_campaign_load target_filter suppression_anti_join "
    "due_send_queue message_render outcome_fold delivery_class value_distribution feed_reconciliation "
    "page_text_extract link_extract contact_extract site_quality_score tech_signal hiring_signal "
    "industry_text_classify domain_candidates probe_result_pick"
).split()


def timed(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query = catalog.QUERIES[name]
        timed(query, spark)
        seconds[name] = round(statistics.median(timed(query, spark) for _ in range(RUNS)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
