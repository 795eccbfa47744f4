"""Operator inputs derived from the driver tables, as SQL that Spark and DuckDB both run unchanged.

Money stays in integer units so that sums are exact in both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from firmweave.session import spread_scan

NOW = "2024-01-31 00:00:00"

ADAPTERS: dict[str, str] = {}

ADAPTERS["companies"] = """
SELECT cast(5500000000 + c_custkey AS string) AS orgnr, c_name AS name, n_name AS city, r_name AS region,
  cast(floor(abs(c_acctbal)) AS bigint) % 300 AS employees,
  CASE WHEN c_custkey % 10 = 0 THEN '__NO_SNI__' WHEN c_custkey % 10 = 1 THEN NULL
       ELSE concat(cast(62000 + (c_custkey % 7) * 1000 AS string), ',', cast(69000 + c_custkey % 11 AS string)) END AS sni_codes,
  lower(c_mktsegment) AS line_of_work,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('https://c', cast(c_custkey AS string), '.example.com') END AS website,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('info@c', cast(c_custkey AS string), '.example.com,it@c', cast(c_custkey AS string), '.example.com') END AS emails,
  CASE WHEN c_custkey % 3 = 0 THEN 'not_found' ELSE 'found' END AS website_status,
  CASE WHEN c_custkey % 4 = 0 THEN 'not_found' ELSE 'found' END AS email_status,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE TIMESTAMP '2023-08-01 00:00:00' + (c_custkey % 180) * INTERVAL '1' DAY END AS website_checked_at
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

ADAPTERS["company_financials"] = """
SELECT cast(5500000000 + o_custkey AS string) AS orgnr, make_date(year(o_orderdate), 12, 31) AS fiscal_year_end_date,
  cast(year(o_orderdate) AS int) AS fiscal_year_end_year,
  cast(sum(c) * 100 AS bigint) AS revenue_sek, cast(sum(c * ((o_orderkey % 21) - 8)) AS bigint) AS profit_sek,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE cast(sum(c * ((o_orderkey % 21) - 8) + (o_orderkey % 1000) * 100) AS bigint) END AS result_after_fin_sek,
  cast(sum(c) * 150 AS bigint) AS assets_total_sek, cast(sum(c) * ((o_custkey % 9) - 1) * 15 AS bigint) AS equity_total_sek,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE cast(((o_custkey % 9) - 1) * 10 AS double) END AS solidity_pct,
  cast(sum(o_orderkey % 977) * 1000 AS bigint) AS cash_sek,
  cast(sum(c) * (o_custkey % 4) * 10 AS bigint) AS liabilities_short_sek, cast(sum(c) * 20 AS bigint) AS liabilities_long_sek,
  max(o_orderdate) AS updated_at
FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS c FROM orders) o
GROUP BY o_custkey, year(o_orderdate)
"""

ADAPTERS["feed"] = """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, event_type AS status, ts AS checked_at,
  CASE WHEN event_type = 'error' THEN '' ELSE concat('https://f', cast(event_id AS string), '.example.org') END AS found_website,
  value AS site_score_raw
FROM events
"""

ADAPTERS["company_checks"] = """
SELECT event_id AS id, cast(5500000000 + user_id AS string) AS orgnr,
  CASE event_type WHEN 'view' THEN 'website' WHEN 'click' THEN 'email' WHEN 'signup' THEN 'tech' WHEN 'purchase' THEN 'hiring' ELSE 'site_review' END AS check_key,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE 'checked' END AS status,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS checked_at, ts + INTERVAL '90' DAY AS next_check_at
FROM events
"""

ADAPTERS["email_messages"] = """
SELECT o_orderkey AS id, o_custkey AS lead_id, cast(o_orderkey % 2 + 1 AS int) AS campaign_id,
  CASE WHEN o_orderkey % 10 < 6 THEN 'sent' WHEN o_orderkey % 10 < 8 THEN 'queued' WHEN o_orderkey % 10 = 8 THEN 'failed' ELSE 'draft' END AS status,
  CASE WHEN o_orderkey % 10 = 8 THEN o_orderpriority ELSE '' END AS error,
  TIMESTAMP '2024-01-01 00:00:00' + (o_orderkey % 43200) * INTERVAL '1' MINUTE AS created_at,
  CASE WHEN o_orderkey % 10 < 6 THEN TIMESTAMP '2024-01-01 00:05:00' + (o_orderkey % 43200) * INTERVAL '1' MINUTE END AS sent_at
FROM orders
"""

ADAPTERS["outcome_events"] = """
SELECT event_id AS id, user_id AS lead_id, cast(event_id % 2 + 1 AS int) AS campaign_id,
  CASE WHEN event_type IN ('signup', 'purchase') THEN NULL ELSE event_id % 1000 END AS message_id,
  CASE event_type WHEN 'view' THEN 'delivered' WHEN 'click' THEN 'accepted' WHEN 'error' THEN 'bounce'
       WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'complaint' ELSE 'reply' END
       ELSE CASE WHEN event_id % 2 = 0 THEN 'booked' ELSE 'won' END END AS type, ts AS created_at
FROM events
"""

ADAPTERS["leads"] = """
SELECT c_custkey AS id, cast(5500000000 + c_custkey AS string) AS orgnr, c_name AS company_name, n_name AS city,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('info@c', cast(c_custkey AS string), '.example.com') END AS emails,
  CASE WHEN c_custkey % 13 = 0 THEN 'do_not_contact' WHEN c_custkey % 13 = 1 THEN NULL ELSE 'new' END AS status
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

ADAPTERS["lead_campaigns"] = """
SELECT c_custkey AS id, c_custkey AS lead_id, cast(c_custkey % 2 + 1 AS int) AS campaign_id, cast(c_custkey % 3 + 1 AS int) AS current_step,
  CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'Z' END AS current_variant,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE TIMESTAMP '2024-01-15 00:00:00' + (c_custkey % 40) * INTERVAL '1' DAY END AS next_send_at,
  CASE WHEN c_custkey % 8 = 0 THEN 'replied' END AS stopped_reason,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE cast(c_custkey % 5 + 1 AS int) END AS tier, cast(c_custkey * 37 % 500 AS int) AS score
FROM customer
"""

ADAPTERS["do_not_contact"] = """
SELECT cast(5500000000 + s_suppkey * 3 AS string) AS orgnr FROM supplier
"""

ADAPTERS["site_pages"] = """
SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS site_key, page_id AS page_order, url, html FROM pages
"""

ADAPTERS["texts"] = """
SELECT doc_id, lower(text) AS text, source AS register_text FROM documents
"""


TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_SCHEMAS: dict[str, StructType] = {}

# Text tables: little data for the reader, much work per row.
HEAVY = ("pages", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:  # reading a schema costs a job
        _SCHEMAS[path] = spark.read.parquet(path).schema
    df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    return spread_scan(df) if name in HEAVY else df


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over the driver tables it names (and the given frames), leaving no view behind."""
    names = "|".join([*TABLES, *frames])
    braces = text.replace("{", "{{").replace("}", "}}")
    marked = re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 {\2}", braces)
    used = {n for _, n in re.findall(rf"\b(FROM|JOIN) \{{({names})\}}", marked)}
    inputs = {n: frames[n] if n in frames else table(spark, sf_dir, n) for n in used}
    return spark.sql(marked, **inputs)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, ADAPTERS[name])


def ctes(*names: str) -> str:
    """WITH-list that gives an SQL twin the same inputs."""
    return ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in names)
