"""Registered queries: sources, standardisation, merges, work queues, streaming."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmweave.operators import merge, queues, standardize as std
from firmweave.plans.adapters import NOW, adapter, ctes, sql
from firmweave.plans.finance_queries import KEYS as YEAR_KEYS, keyed
from firmweave.session import shared_dir
from firmweave.sources import feeds, filings, register, snapshots
from firmweave.streaming import feed_stream

# Inputs in SQL that Spark and DuckDB both run.
_KEY = "cast(5500000000 + c_custkey AS string)"
INPUTS = {
    "bulk": f"""
SELECT concat({_KEY}, '$', CASE WHEN c_custkey % 17 = 0 THEN 'PERSON-ID' ELSE 'ORGNR-IDORG' END) AS organisationsidentitet,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat(c_name, '$MAIN$2001-01-01|Old name$OTHER') END AS organisationsnamn,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('20', cast(10 + c_custkey % 14 AS string), '-03-01$x') END AS registreringsdatum,
  CASE c_custkey % 8 WHEN 0 THEN 'Aktiebolag AB-ORGFO' WHEN 1 THEN 'HB-ORGFO' WHEN 2 THEN 'KB-ORGFO' WHEN 3 THEN 'Ekonomisk förening'
    WHEN 4 THEN 'BRF-ORGFO' WHEN 5 THEN 'Stiftelse$y' WHEN 6 THEN 'Ideell förening' ELSE 'FL-ORGFO' END AS organisationsform,
  CASE WHEN c_custkey % 6 = 0 THEN '2020-05-05$z' ELSE '' END AS avregistreringsdatum,
  concat('Street ', cast(c_custkey AS string), '$$123 45$ ', n_name, ' $SE') AS postadress, c_custkey AS row_order
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "old_master": f"""
SELECT {_KEY} AS orgnr, concat(' ', c_name, ' ') AS name, n_name AS city,
  CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN concat(n_name, ' kommun') END AS scb_municipality,
  r_name AS scb_region, CASE WHEN c_custkey % 4 = 0 THEN '12' WHEN c_custkey % 4 = 1 THEN 'many' WHEN c_custkey % 4 = 2 THEN ' 7 ' END AS employees,
  CASE WHEN c_custkey % 9 = 0 THEN '__NO_SNI__' ELSE cast(62000 + c_custkey % 90 AS string) END AS sni_codes,
  'unknown' AS hiring_status, '' AS website, cast(c_acctbal AS string) AS line_of_work_conf
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "spellings": """
SELECT event_id, CASE event_id % 7
    WHEN 0 THEN concat(d, 'T', t, 'Z') WHEN 1 THEN concat(d, 'T', t, '+02:00') WHEN 2 THEN concat(d, ' ', t)
    WHEN 3 THEN concat(d, 'T', t) WHEN 4 THEN 'not a time' WHEN 5 THEN NULL ELSE ' ' END AS seen_at, d, t
FROM (SELECT event_id, concat('2023-0', cast(1 + event_id % 9 AS string), '-1', cast(event_id % 9 AS string)) AS d,
  concat('0', cast(2 + event_id % 7 AS string), ':1', cast(event_id % 10 AS string), ':30') AS t FROM events) x""",
    "sizes": f"""
SELECT {_KEY} AS orgnr,
  CASE c_custkey % 5 WHEN 0 THEN cast(c_custkey % 10 AS string) WHEN 1 THEN ' 4 ' WHEN 2 THEN '' END AS employees_class_code,
  CASE c_custkey % 7 WHEN 0 THEN '0 anställda' WHEN 1 THEN '1-4 anställda' WHEN 2 THEN '10–19 anställda' WHEN 3 THEN '500+ anställda'
    WHEN 4 THEN 'okänd' WHEN 5 THEN '' END AS employees_class,
  CASE WHEN c_custkey % 13 = 0 THEN 3 END AS employees_min, cast(NULL AS int) AS employees_max
FROM customer""",
    "coded": f"""
SELECT {_KEY} AS orgnr, cast(n_regionkey AS string) AS sector_code,
  CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN ' ' END AS sector
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "codes": "SELECT cast(r_regionkey AS string) AS code, r_name AS label FROM region WHERE r_regionkey < 4",
    "industry_payloads": f"""
SELECT {_KEY} AS orgnr, CASE c_custkey % 6
  WHEN 0 THEN '{{"organisationer":[]}}'
  WHEN 1 THEN concat('{{"organisationer":[{{"naringsgrenOrganisation":{{"sni":[{{"kod":"', code, '","klartext":"Text A"}},{{"kod":"69201","klartext":""}}]}}}}]}}')
  WHEN 2 THEN concat('{{"organisationer":[{{"naringsgrenOrganisation":{{"sni":[]}},"naringsgrenar":{{"sni":[{{"code":"', code, '","text":"Text B"}},{{"code":"1","text":"C"}}]}}}}]}}')
  WHEN 3 THEN concat('{{"organisationer":[{{"sni":[{{"kod":" ', code, ' ","beskrivning":"Text D"}},{{"klartext":"no code"}}]}}]}}')
  WHEN 4 THEN '{{"organisationer":[{{"namn":"x"}}]}}'
  ELSE concat('{{"organisationer":[{{"naringsgren":{{"sni":[{{"code":"', code, '"}}]}}}}]}}') END AS payload
FROM (SELECT c_custkey, cast(62000 + c_custkey % 97 AS string) AS code FROM customer) c""",
    "loose_payloads": f"""
SELECT {_KEY} AS orgnr, CASE c_custkey % 5
  WHEN 0 THEN concat('{{"Stkl, kod":"', k, '","antalArbetsställen":', k, ',"PostOrt":"Ort ', k, '","Säteslän":"Västra Götalands län"}}')
  WHEN 1 THEN concat('{{"foretag":{{"employeesClass":" ', k, ' ","workplaces":"', k, '","kommun":"', n_name, '"}}}}')
  WHEN 2 THEN '{{"other":1}}' WHEN 3 THEN 'broken {{' ELSE concat('{{"data":{{"county":"', n_name, ' län","postort":""}}}}') END AS payload, k, n_name, c_custkey
FROM (SELECT c_custkey, cast(c_custkey % 9 AS string) AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) c""",
    "owners": f"""
SELECT {_KEY} AS orgnr, CASE c_custkey % 4 WHEN 0 THEN ' Privat ' WHEN 1 THEN '' WHEN 2 THEN 'Publikt' END AS private_public,
  CASE c_custkey % 6 WHEN 0 THEN 'Statlig förvaltning' WHEN 1 THEN 'Kommunal' WHEN 2 THEN 'Privata företag' WHEN 3 THEN '' ELSE NULL END AS sector
FROM customer""",
    "feed_email": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, upper(event_type) AS status,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('a', cast(event_id AS string), '@f.example.org') END AS emails,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE cast(ts AS string) END AS checked_at
FROM events WHERE event_type <> 'view'""",
    "feed_website": """
SELECT event_id AS feed_order, concat(' ', cast(5500000000 + user_id AS string)) AS orgnr, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS status,
  CASE WHEN event_type = 'error' THEN '' ELSE concat('https://f', cast(event_id AS string), '.example.org') END AS found_website,
  cast(ts AS string) AS checked_at
FROM events""",
    "feed_tech": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, CASE WHEN value > 20 THEN 'yes' ELSE 'no' END AS microsoft_status,
  CASE WHEN value > 50 THEN 'strong' WHEN value > 20 THEN 'weak' END AS microsoft_strength, 'low' AS microsoft_confidence,
  CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE '' END AS it_support_signal, 'medium' AS it_support_confidence, cast(NULL AS string) AS err_reason,
  cast(ts AS string) AS checked_at
FROM events WHERE event_type <> 'click'""",
    "feed_site_review": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, cast(floor(value) AS int) % 11 AS site_score,
  CASE WHEN event_id % 3 = 0 THEN '403' ELSE '' END AS err_reason, cast(ts AS string) AS checked_at
FROM events WHERE event_type IN ('view', 'signup')""",
    "feed_hiring": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, CASE WHEN event_id % 3 = 0 THEN 'yes' ELSE 'no' END AS hiring_status,
  CASE WHEN event_id % 3 = 0 THEN 'driver' ELSE '' END AS hiring_what_text, cast(event_id % 3 AS int) AS hiring_count,
  CASE WHEN event_id % 2 = 0 THEN concat('https://j', cast(event_id AS string)) ELSE '' END AS evidence_url,
  CASE WHEN event_id % 5 = 0 THEN concat('https://j', cast(event_id AS string)) ELSE 'https://x' END AS external_url,
  '' AS err_reason, cast(ts AS string) AS checked_at
FROM events WHERE event_type IN ('purchase', 'error', 'click')""",
    "feed_line_of_work": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END AS final_label,
  concat('raw ', event_type) AS w_raw, (event_id % 4) * 0.25 AS final_conf, CASE WHEN event_id % 4 > 2 THEN 'HIGH' ELSE 'LOW' END AS final_bucket,
  'web' AS source, cast(ts AS string) AS checked_at
FROM events WHERE event_type <> 'signup'""",
    "feed_segments": """
SELECT event_id AS feed_order, cast(5500000000 + user_id AS string) AS orgnr, concat('segment_', cast(event_id % 9 AS string)) AS segment_groups_after,
  cast(ts AS string) AS checked_at
FROM events WHERE event_id % 3 <> 1""",
}
WIDE = """
SELECT orgnr, name, website, website_status, website_checked_at, emails, email_status,
  cast(NULL AS timestamp) AS emails_checked_at, cast(NULL AS string) AS microsoft_status, cast(NULL AS string) AS microsoft_strength,
  cast(NULL AS string) AS microsoft_confidence, cast(NULL AS string) AS it_support_signal, cast(NULL AS string) AS it_support_confidence,
  cast(NULL AS string) AS tech_err_reason, TIMESTAMP '2024-01-20 00:00:00' AS tech_checked_at, cast(0 AS int) AS site_score,
  cast(NULL AS string) AS site_flags, cast(NULL AS string) AS site_review_err_reason, cast(NULL AS timestamp) AS site_review_checked_at,
  'unknown' AS hiring_status, cast(NULL AS string) AS hiring_what_text, cast(NULL AS int) AS hiring_count,
  cast(NULL AS string) AS hiring_err_reason, cast(NULL AS string) AS hiring_external_urls, cast(NULL AS timestamp) AS hiring_checked_at
FROM companies"""
WIDEST = WIDE.replace("\nFROM companies", """,
  cast(NULL AS timestamp) AS line_of_work_updated_at, line_of_work, cast(NULL AS string) AS line_of_work_raw, cast(NULL AS double) AS line_of_work_conf,
  cast(NULL AS string) AS line_of_work_bucket, cast(NULL AS string) AS line_of_work_source, 'office' AS segment_groups,
  TIMESTAMP '2024-01-10 00:00:00' AS segment_groups_checked_at
FROM companies""")


def _in(spark, sf_dir, name):
    return sql(spark, sf_dir, INPUTS[name])


def _run_dir(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text_time(*cols):
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols}


def _companies(spark, sf_dir):
    return adapter(spark, sf_dir, "companies").withColumn("website_checked_at", F.col("website_checked_at").cast("timestamp"))


def _wide(spark, sf_dir):
    return sql(spark, sf_dir, WIDE, companies=_companies(spark, sf_dir))


# ---- sources and sinks ----


def _website_lines(spark, sf_dir):
    """The website feed as raw lines, with blank, broken, empty-object and keyless ones among them."""
    rows = _in(spark, sf_dir, "feed_website")
    good = F.to_json(F.struct(F.when(F.col("feed_order") % 19 != 0, F.col("orgnr")).alias("orgnr"), "status", "found_website", "checked_at"))
    bad = F.when(F.col("feed_order") % 23 == 0, "").when(F.col("feed_order") % 29 == 0, "{}").when(
        F.col("feed_order") % 31 == 0, "{broken").when(F.col("feed_order") % 37 == 0, "[1]")
    return rows.select("feed_order", F.coalesce(bad, good).alias("value"))


def _write_lines(lines, path, files=3):
    ordered = lines.repartitionByRange(files, "feed_order").sortWithinPartitions("feed_order")
    ordered.select("value").write.mode("append").text(path)


def _write_website_feed(spark, sf_dir):
    path = _run_dir(spark, "feed")
    _write_lines(_website_lines(spark, sf_dir), path)
    return path


def feed_scan(spark, sf_dir):
    path = _write_website_feed(spark, sf_dir)
    rows, rejects = feeds.feed_scan(spark, [f"{path}/part-*", f"{path}/*"], "website")
    kept = rows.select(F.lit("row").alias("kind"), F.coalesce(F.trim("orgnr"), F.lit("")).alias("orgnr"))
    out = rejects.select(F.col("reject").alias("kind"), F.lit("").alias("orgnr"))
    return kept.unionByName(out).groupBy("kind", "orgnr").agg(F.count("*").alias("n"))


def feed_write(spark, sf_dir):
    path = _run_dir(spark, "shards")
    df = queues.with_shard(_companies(spark, sf_dir).select("orgnr", "name", "line_of_work"), 4)
    feeds.feed_write(df, path)
    return spark.read.schema("orgnr string, name string, line_of_work string, shard_id int").json(path)


def register_bulk_scan(spark, sf_dir):
    root = _run_dir(spark, "bulk")
    bulk = _in(spark, sf_dir, "bulk").drop("row_order")
    upper = bulk.toDF(*[c.upper() for c in bulk.columns])
    with_nul = upper.withColumn(
        "ORGANISATIONSNAMN",
        F.when(F.col("ORGANISATIONSIDENTITET").like("%7$%"), F.lit("bad\x00line")).otherwise(F.col("ORGANISATIONSNAMN")),
    )
    options = {"sep": ";", "header": True, "emptyValue": ""}
    upper.write.options(**options).csv(f"{root}/bulk_2024-01-01.csv")
    with_nul.write.options(**options).csv(f"{root}/bulk_2024-02-01.csv")
    scanned = register.register_bulk_scan(spark, f"{root}/bulk_*.csv").drop("row_order")
    return scanned.na.fill("")


FILING_NAMES = """
SELECT concat('container.zip::', CASE WHEN orgnr LIKE '%3' THEN 'misc' ELSE orgnr END, '_', cast(fiscal_year_end_date AS string), '.xhtml') AS source_file,
  concat('<html>', cast(revenue_sek AS string), '</html>') AS xhtml
FROM company_financials"""


def filing_scan(spark, sf_dir):
    path = _run_dir(spark, "filings")
    docs = sql(spark, sf_dir, FILING_NAMES, company_financials=adapter(spark, sf_dir, "company_financials"))
    docs.write.parquet(path)
    return filings.packed_filing_scan(spark, path)


def table_snapshot(spark, sf_dir):
    store = snapshots.TableSnapshots(spark, _run_dir(spark, "financials"), partition_by=["fiscal_year_end_year"])
    df = adapter(spark, sf_dir, "company_financials").select(*YEAR_KEYS, "revenue_sek")
    store.write(df)
    store.write(store.read().withColumn("revenue_sek", F.col("revenue_sek") + 1))
    return keyed(store.read()).withColumn("version", F.lit(store.versions()[-1]))


# ---- standardisation ----


def register_standardize(spark, sf_dir):
    return std.register_standardize(_in(spark, sf_dir, "bulk")).drop("row_order")


MASTER_SHOWN = (
    "orgnr name kommun region postort employees sni_codes website hiring_status line_of_work_conf legal_form".split()
)


def master_projection(spark, sf_dir):
    return std.master_projection(_in(spark, sf_dir, "old_master")).select(*MASTER_SHOWN)


def timestamp_standardize(spark, sf_dir):
    rows, _ = std.timestamp_standardize(_in(spark, sf_dir, "spellings"), ["seen_at"])
    return rows.select("event_id", "seen_at")


def timestamp_standardize_counts(spark, sf_dir):
    return std.timestamp_standardize(_in(spark, sf_dir, "spellings"), ["seen_at"])[1]


def size_class_span(spark, sf_dir):
    return std.size_class_span(_in(spark, sf_dir, "sizes")).select("orgnr", "employees_min", "employees_max")


def code_table_fill(spark, sf_dir):
    return std.code_table_fill(_in(spark, sf_dir, "coded"), _in(spark, sf_dir, "codes"), "sector_code", "sector")


def industry_code_extract(spark, sf_dir):
    return std.industry_code_extract(_in(spark, sf_dir, "industry_payloads"))


def payload_flatten(spark, sf_dir):
    return std.payload_flatten(_in(spark, sf_dir, "loose_payloads"))


def ownership_bucket(spark, sf_dir):
    return _in(spark, sf_dir, "owners").select("orgnr", std.ownership_bucket("private_public", "sector").alias("bucket"))


# ---- merges ----


def fill_if_blank_merge(spark, sf_dir):
    out = merge.fill_if_blank_merge(
        _companies(spark, sf_dir), adapter(spark, sf_dir, "feed"), "found_website", "feed_order", target="website"
    )
    return out.select("orgnr", "website")


def newest_wins_merge(spark, sf_dir):
    feed = adapter(spark, sf_dir, "feed").withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    out = merge.newest_wins_merge(
        _companies(spark, sf_dir), feed, {"status": "website_status"}, "checked_at", "feed_order", "website_checked_at"
    )
    return out.select("orgnr", "website_status", "website_checked_at").withColumns(_text_time("website_checked_at"))


def _apply_all(spark, sf_dir):
    hiring = _in(spark, sf_dir, "feed_hiring").withColumn(
        "hiring_urls", merge.job_url_text(F.array("external_url"), F.col("evidence_url"))
    )
    review = _in(spark, sf_dir, "feed_site_review").withColumn("site_flags", F.to_json(F.array(F.lit("no_https"))))
    return merge.signal_feeds_apply(
        _wide(spark, sf_dir),
        {
            "website": _in(spark, sf_dir, "feed_website"),
            "email": _in(spark, sf_dir, "feed_email"),
            "tech": _in(spark, sf_dir, "feed_tech"),
            "site_review": review,
            "hiring": hiring,
        },
    )


TIMES = ("website_checked_at", "emails_checked_at", "tech_checked_at", "site_review_checked_at", "hiring_checked_at")


def signal_feeds_apply(spark, sf_dir):
    return _apply_all(spark, sf_dir)[0].withColumns(_text_time(*TIMES))


def signal_feeds_counters(spark, sf_dir):
    return _apply_all(spark, sf_dir)[1]


KINDS = ("website", "email", "tech", "site_review", "hiring", "line_of_work", "segments")
ALL_TIMES = (*TIMES, "line_of_work_updated_at", "segment_groups_checked_at")


def _feed_rows(spark, sf_dir, kind):
    rows = _in(spark, sf_dir, f"feed_{kind}")
    if kind == "site_review":
        rows = rows.withColumn("site_flags", F.array(F.lit("no_https"), F.concat(F.lit("low_"), F.col("site_score"))))
    if kind == "hiring":
        rows = rows.withColumn("external_job_urls", F.array("external_url")).drop("external_url")
    return rows


def _feed_lines(rows):
    """A feed as the lines its writers leave behind, with torn lines, doubled ones and text behind the object among them."""
    good = F.to_json(F.struct(*[c for c in rows.columns if c != "feed_order"]))
    o = F.col("feed_order")
    value = F.when(o % 23 == 0, F.concat(good, good)).when(o % 29 == 0, F.concat(good, F.lit(" trailing"))).when(
        o % 31 == 0, F.left(good, F.length(good) - 1)).when(o % 37 == 0, F.concat(good, F.lit(",{}"))).otherwise(good)
    return rows.select("feed_order", value.alias("value"))


def _file_bounds(feeds):
    """Per feed the places in ``feed_order`` that cut it into files of about one size, as many as its table has splits, two to 64. One job."""
    files = min(64, max(2, *(df.rdd.getNumPartitions() for df in feeds.values())))
    orders = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "feed_order") for k, df in feeds.items()])
    found = dict(orders.groupBy("kind").agg(F.percentile_approx("feed_order", [i / files for i in range(1, files)])).collect())
    return {k: found.get(k) or [] for k in feeds}


def _feed_portions(spark, sf_dir):
    """The seven feeds as files in three portions; yields their folder as each portion is there.

    Rows go straight to their file, in the order of the feed; their text is made there, once.
    """
    root, rows = _run_dir(spark, "feeds"), {k: _feed_rows(spark, sf_dir, k) for k in KINDS}
    bounds = _file_bounds(rows)
    for portion in range(3):
        for kind, df in rows.items():
            file = sum(((F.col("feed_order") > b).cast("int") for b in bounds[kind]), F.lit(0))
            own = df.where(F.col("feed_order") % 3 == portion).repartitionById(len(bounds[kind]) + 1, file).sortWithinPartitions("feed_order")
            _feed_lines(own).select("value").write.mode("append").text(f"{root}/{kind}/portion_{portion}")
        yield root


def feeds_end_to_end(spark, sf_dir):
    """Seven feeds from their files to the master."""
    *_, root = _feed_portions(spark, sf_dir)
    read = {k: feeds.feed_scan(spark, [f"{root}/{k}/*/part-*"], k)[0] for k in KINDS}
    master = sql(spark, sf_dir, WIDEST, companies=_companies(spark, sf_dir))
    return merge.signal_feeds_apply(master, read)[0].withColumns(_text_time(*ALL_TIMES))


def incremental_feed_state(spark, sf_dir):
    """The same feeds as they arrive in three portions, the stream restarted after each; state by company, master joined when read."""
    checkpoint, changes = _run_dir(spark, "checkpoint"), snapshots.TableSnapshots(spark, _run_dir(spark, "changes"))
    for root in _feed_portions(spark, sf_dir):
        feed_stream.feed_state(spark, {k: f"{root}/{k}/*" for k in KINDS}, changes, checkpoint).awaitTermination()
    master = sql(spark, sf_dir, WIDEST, companies=_companies(spark, sf_dir))
    return feed_stream.current_master(master, changes, list(KINDS)).withColumns(_text_time(*ALL_TIMES))


def _register_master(spark, sf_dir):
    return sql(spark, sf_dir, REGISTER_MASTER)


REGISTER_MASTER = f"""
SELECT {_KEY} AS orgnr, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, cast(NULL AS string) AS postort,
  CASE WHEN c_custkey % 3 = 0 THEN '1999-09-09' END AS registration_date, cast(NULL AS string) AS legal_form, 'active' AS company_status
FROM customer WHERE c_custkey % 2 = 0"""
# Each company appears twice, the second time with another status.
REGISTER_ROWS = """
SELECT orgnr, CASE WHEN row_order % 3 = 0 THEN NULL ELSE name END AS name, postort, registration_date, legal_form, company_status, row_order FROM s
UNION ALL SELECT orgnr, name || ' II', 'Later', '2022-02-02', 'OTHER', CASE WHEN row_order % 7 = 0 THEN 'inactive' ELSE 'active' END, row_order + 100000000 FROM s"""


def register_upsert(spark, sf_dir):
    rows = sql(spark, sf_dir, REGISTER_ROWS, s=std.register_standardize(_in(spark, sf_dir, "bulk")))
    return merge.register_upsert(_register_master(spark, sf_dir), rows)


def insert_if_absent(spark, sf_dir):
    df = adapter(spark, sf_dir, "company_financials").select(*YEAR_KEYS, "revenue_sek")
    known = df.where("fiscal_year_end_year % 2 = 0")
    rows = df.withColumn("revenue_sek", F.col("revenue_sek") * 10).withColumn("o", F.lit(1)).unionByName(
        df.withColumn("revenue_sek", F.lit(-1).cast("bigint")).withColumn("o", F.lit(2))
    )
    return keyed(merge.insert_if_absent(known, rows, ["orgnr", "fiscal_year_end_date"], "o"))


def keyed_upsert(spark, sf_dir):
    df = adapter(spark, sf_dir, "leads").select(F.col("orgnr"), "company_name", "city", "status")
    target = df.where("CAST(orgnr AS bigint) % 2 = 0").withColumn("created_at", F.lit("old"))
    rows = df.where("CAST(orgnr AS bigint) % 3 = 0").withColumn("created_at", F.lit("new"))
    rows = rows.withColumn("city", F.lit("first")).withColumn("o", F.lit(1)).unionByName(
        rows.withColumn("city", F.lit("second")).withColumn("status", F.lit("new")).withColumn("o", F.lit(2))
    )
    return merge.keyed_upsert(target, rows, ["orgnr"], "o", insert_only=("created_at", "status"))


def checks_unpivot(spark, sf_dir):
    df = _companies(spark, sf_dir).withColumns(
        {
            "tech_checked_at": F.when(F.substring("orgnr", -1, 1) == "4", F.lit("2024-01-01T00:00:00Z")),
            "tech_err_reason": F.lit(" "),
            "website_checked_at": F.date_format("website_checked_at", "yyyy-MM-dd"),
        }
    )
    return merge.checks_unpivot(df)


def change_log_diff(spark, sf_dir):
    old = _in(spark, sf_dir, "old_master")
    old = old.select("orgnr", F.col("city").alias("kommun"), F.col("scb_region").alias("region"), F.lit(None).cast("string").alias("postort"), "employees")
    new = std.master_projection(_in(spark, sf_dir, "old_master")).select("orgnr", "kommun", "region", "postort", "employees")
    out = merge.change_log_diff(old, new, ["kommun", "region", "postort", "employees"], NOW, "migration")
    return out.withColumns(_text_time("changed_at"))


def change_log_between(spark, sf_dir):
    """Two versions that differ for few companies, written with their digests."""
    old = _companies(spark, sf_dir).select("orgnr", "city", "employees")
    number = F.col("orgnr").cast("bigint")
    new = old.withColumn("employees", F.when(number % 97 == 0, F.col("employees") + 1).otherwise(F.col("employees")))
    new = new.withColumn("city", F.when(number % 89 != 0, F.col("city")))
    paths = [_run_dir(spark, name) for name in ("old", "new")]
    for df, path in zip((old, new), paths):
        merge.write_with_digests(df, path, ["city", "employees"], buckets=64)
    return merge.change_log_between(spark, *paths, ["city", "employees"], NOW, "register").withColumns(_text_time("changed_at"))


ENRICH_RECORDS = """
SELECT cast(5500000000 + c_custkey AS string) AS orgnr, c_custkey AS record_order,
  CASE c_custkey % 6 WHEN 0 THEN 'not_found' WHEN 1 THEN 'err' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 6 = 1 THEN CASE WHEN c_custkey % 4 = 1 THEN '403 forbidden' ELSE 'timeout' END ELSE '' END AS err_reason,
  concat(c_name, ' AB') AS v_name, cast(c_custkey % 9 AS string) AS v_size, cast(c_custkey % 40 AS string) AS v_work,
  n_name AS v_mun, CASE WHEN c_custkey % 5 = 0 THEN '0' ELSE '1' END AS v_stat, CASE WHEN c_custkey % 4 = 0 THEN 'Statlig' ELSE ' ' END AS v_sector
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_RECORD_VALUES = {
    "Företagsnamn": "v_name", "Stkl, kod": "v_size", "Antal arbetsställen": "v_work", "Säteskommun": "v_mun",
    "Företagsstatus, kod": "v_stat", "Sektor": "v_sector",
}


def _enrichment(spark, sf_dir):
    from firmweave.functions.fixed_values import ENRICHMENT_FIELDS

    raw = sql(spark, sf_dir, ENRICH_RECORDS)
    fields = [
        (F.col(_RECORD_VALUES[f]) if f in _RECORD_VALUES else F.lit(None).cast("string")).alias(f)
        for f, _, _ in ENRICHMENT_FIELDS
    ]
    records = raw.select("orgnr", "record_order", "status", "err_reason", *fields)
    base = _companies(spark, sf_dir).select("orgnr", F.when(F.substring("orgnr", -1, 1) == "2", F.lit("")).otherwise(F.col("name")).alias("name"))
    types = {t: ("int" if k == "int" else "string") for _, t, k in ENRICHMENT_FIELDS if t != "name"}
    types.update(employees_min="int", employees_max="int", scb_status="string", scb_err_reason="string",
                 scb_checked_at="timestamp", scb_next_check_at="timestamp")
    master = base.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})
    return merge.enrichment_merge(master, records, NOW)


def enrichment_merge(spark, sf_dir):
    out, _ = _enrichment(spark, sf_dir)
    return out.withColumns(_text_time("scb_checked_at", "scb_next_check_at")).select(
        "orgnr", "name", "employees_class_code", "employees_min", "employees_max", "workplaces_count", "municipality",
        "company_status_code", "sector", "scb_status", "scb_err_reason", "scb_checked_at", "scb_next_check_at",
    )


def enrichment_run_stats(spark, sf_dir):
    return _enrichment(spark, sf_dir)[1].where("n > 0")


# ---- work queues ----


def refresh_due(spark, sf_dir):
    return queues.refresh_due(_companies(spark, sf_dir), "website_checked_at", 90, NOW, "website").select("orgnr")


def due_queue_topk(spark, sf_dir):
    return queues.due_queue_topk(_companies(spark, sf_dir), 200, "website_checked_at", 90, NOW).select("orgnr")


def scheduled_queue_topk(spark, sf_dir):
    checks = adapter(spark, sf_dir, "company_checks").withColumn("next_check_at", F.col("next_check_at").cast("timestamp"))
    return queues.scheduled_queue_topk(checks, 200, "next_check_at", "2024-04-10 00:00:00", key="id").select("id")


def stable_hash_shard(spark, sf_dir):
    return queues.with_shard(_companies(spark, sf_dir).select("orgnr"), 7)


def resume_anti_join(spark, sf_dir):
    return queues.resume_anti_join(_companies(spark, sf_dir).select("orgnr", "name"), adapter(spark, sf_dir, "feed"))


def next_check_schedule(spark, sf_dir):
    df = _companies(spark, sf_dir).select(
        "orgnr",
        F.when(F.col("website_checked_at").isNull(), "err").otherwise("ok").alias("status"),
        (F.col("employees") % 2 == 0).alias("hard_error"),
        F.lit(NOW).cast("timestamp").alias("checked_at"),
    )
    return queues.next_check_schedule(df).select("orgnr", "next_check_at").withColumns(_text_time("next_check_at"))


# ---- streaming ----


def incremental_feed_apply(spark, sf_dir):
    """Website feed files arriving in three portions, the stream restarted after each."""
    from firmweave.streaming.feed_stream import incremental_feed_apply as run

    path, checkpoint = _run_dir(spark, "feed"), _run_dir(spark, "checkpoint")
    store = snapshots.TableSnapshots(spark, _run_dir(spark, "master"))
    columns = ["orgnr", "website", "website_status", "website_checked_at"]
    store.write(_companies(spark, sf_dir).select(*columns))
    lines = _website_lines(spark, sf_dir)
    for portion in range(3):
        _write_lines(lines.where(F.col("feed_order") % 3 == portion), path)
        feed_stream.incremental_feed_apply(spark, path, store, checkpoint, "website").awaitTermination()
    return store.read().withColumns(_text_time("website_checked_at"))


QUERIES = {
    f.__name__: f
    for f in (
        feed_scan, feed_write, register_bulk_scan, filing_scan, table_snapshot,
        register_standardize, master_projection, timestamp_standardize, timestamp_standardize_counts, size_class_span, code_table_fill,
        industry_code_extract, payload_flatten, ownership_bucket,
        fill_if_blank_merge, newest_wins_merge, signal_feeds_apply, signal_feeds_counters, register_upsert,
        insert_if_absent, keyed_upsert, checks_unpivot, change_log_diff, change_log_between, enrichment_merge, enrichment_run_stats,
        refresh_due, due_queue_topk, scheduled_queue_topk, stable_hash_shard, resume_anti_join, next_check_schedule,
        incremental_feed_apply, feeds_end_to_end, incremental_feed_state,
    )
}

# ---- SQL twins ----

_CO = ctes("companies")
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _ts(c: str) -> str:
    return _TS.format(c=c)


def _in_sql(*names: str) -> str:
    return ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


_NB = "nullif(trim({c}), '')"


def _nb(c: str) -> str:
    return _NB.format(c=c)


_STANDARD = f"""std AS (SELECT split_part(organisationsidentitet, '$', 1) AS orgnr,
  {_nb("split_part(split_part(organisationsnamn, '|', 1), '$', 1)")} AS name, {_nb("split_part(postadress, '$', 4)")} AS postort,
  {_nb("split_part(registreringsdatum, '$', 1)")} AS registration_date,
  CASE WHEN contains(u, 'AB') THEN 'AB' WHEN contains(u, 'KOMMANDIT') OR starts_with(u, 'KB') THEN 'KB'
    WHEN contains(u, 'HANDELSBOLAG') OR starts_with(u, 'HB') THEN 'HB' WHEN contains(u, 'ENSKILD') OR starts_with(u, 'EF') THEN 'EF'
    WHEN contains(u, 'BOSTADSRÄTT') OR contains(u, 'BRF') THEN 'BRF' WHEN contains(u, 'EKONOMISK') OR starts_with(u, 'EK') THEN 'EK'
    WHEN contains(u, 'STIFTELSE') OR starts_with(u, 'ST') THEN 'ST' WHEN contains(u, 'IDEELL') THEN 'IDEELL' ELSE 'OTHER' END AS legal_form,
  CASE WHEN avregistreringsdatum <> '' THEN 'inactive' ELSE 'active' END AS company_status, row_order
  FROM (SELECT *, upper(split_part(organisationsform, '$', 1)) AS u FROM bulk) b
  WHERE split_part(organisationsidentitet, '$', 2) = 'ORGNR-IDORG')"""


def _marker(rule: str, feed: str, status: str, target_ts: str) -> str:
    """Newest feed row per company: earliest of the latest."""
    return f"""{rule}_m AS (SELECT orgnr, {status}, ts FROM (SELECT *, row_number() OVER (PARTITION BY orgnr ORDER BY ts DESC, feed_order) AS rn
  FROM (SELECT *, TRY_CAST(checked_at AS TIMESTAMP) AS ts FROM {feed}) WHERE ts IS NOT NULL) WHERE rn = 1)"""


def _feeds_sql(wide: str, inputs: str) -> str:
    return f"""{_CO}, wide AS ({wide}), {inputs},
fw AS (SELECT feed_order, trim(orgnr) AS orgnr, coalesce(lower({_nb('status')}), 'checked') AS status, {_nb('found_website')} AS val, checked_at FROM feed_website),
fe AS (SELECT feed_order, orgnr, lower(status) AS status, {_nb('emails')} AS val, checked_at FROM feed_email),
wv AS (SELECT orgnr, arg_min(val, feed_order) AS val FROM fw WHERE val IS NOT NULL GROUP BY 1),
ev AS (SELECT orgnr, arg_min(val, feed_order) AS val FROM fe WHERE val IS NOT NULL GROUP BY 1),
{_marker('w', 'fw', 'status', '')}, {_marker('e', 'fe', 'status', '')},
{_marker('t', 'feed_tech', 'microsoft_status, microsoft_strength, microsoft_confidence, ' + _nb('it_support_signal') + ' AS it_support_signal, it_support_confidence', '')},
{_marker('r', 'feed_site_review', 'site_score, err_reason', '')},
{_marker('h', 'feed_hiring', 'hiring_status, hiring_what_text, hiring_count, evidence_url, external_url', '')},
j AS (SELECT wide.*, coalesce(trim(wide.website), '') = '' AND wv.val IS NOT NULL AS wf, wv.val AS wval, coalesce(trim(wide.emails), '') = '' AND ev.val IS NOT NULL AS ef, ev.val AS eval,
  w_m.ts IS NOT NULL AND (website_checked_at IS NULL OR w_m.ts > website_checked_at) AS wn, w_m.status AS wst, w_m.ts AS wts,
  e_m.ts IS NOT NULL AS en, e_m.status AS est, e_m.ts AS ets,
  t_m.ts IS NOT NULL AND t_m.ts > tech_checked_at AS tn, t_m.ts AS tts, t_m.microsoft_status AS t1, t_m.microsoft_strength AS t2, t_m.microsoft_confidence AS t3, t_m.it_support_signal AS t4, t_m.it_support_confidence AS t5,
  r_m.ts IS NOT NULL AS rn, r_m.ts AS rts, r_m.site_score AS r1, r_m.err_reason AS r2,
  h_m.ts IS NOT NULL AS hn, h_m.ts AS hts, h_m.hiring_status AS h1, h_m.hiring_what_text AS h2, h_m.hiring_count AS h3,
  CASE WHEN evidence_url = '' OR evidence_url = external_url THEN '["' || external_url || '"]' ELSE '["' || external_url || '","' || evidence_url || '"]' END AS h4
  FROM wide LEFT JOIN wv USING (orgnr) LEFT JOIN ev USING (orgnr) LEFT JOIN w_m USING (orgnr) LEFT JOIN e_m USING (orgnr)
  LEFT JOIN t_m USING (orgnr) LEFT JOIN r_m USING (orgnr) LEFT JOIN h_m USING (orgnr))"""


_FEEDS_SQL = _feeds_sql(WIDE, _in_sql(*(f"feed_{k}" for k in KINDS[:5])))
# As written: three portions, each in order, without the lines that hold no single object.
_WRITTEN_SQL = ", ".join(
    f"feed_{k} AS (SELECT * REPLACE (feed_order % 3 * 1000000000 + feed_order AS feed_order) FROM ({INPUTS[f'feed_{k}']}) "
    "WHERE feed_order % 23 <> 0 AND feed_order % 29 <> 0 AND feed_order % 31 <> 0 AND feed_order % 37 <> 0)" for k in KINDS
)


def _if(flag: str, new: str, old: str) -> str:
    return f"CASE WHEN {flag} THEN {new} ELSE {old} END AS {old}"


_MERGED_SQL = ", ".join(
    ["orgnr", "name", _if("wf", "wval", "website"), _if("wn", "wst", "website_status"), _if("ef", "eval", "emails"), _if("en", "est", "email_status")]
    + [_if("tn", f"t{i}", c) for i, c in enumerate(["microsoft_status", "microsoft_strength", "microsoft_confidence", "it_support_signal", "it_support_confidence"], 1)]
    + [_if("tn", "''", "tech_err_reason"), _if("rn", "r1", "site_score"), "CASE WHEN rn THEN '[\"no_https\"]' END AS site_flags", _if("rn", "r2", "site_review_err_reason")]
    + [_if("hn", "h1", "hiring_status"), _if("hn", "h2", "hiring_what_text"), _if("hn", "h3", "hiring_count"), _if("hn", "''", "hiring_err_reason"), _if("hn", "h4", "hiring_external_urls")]
    + [f"{_ts(f'CASE WHEN {f}n THEN {f}ts ELSE {c} END')} AS {c}" for f, c in zip("wetrh", TIMES)]
)

_ALL_FEEDS_SQL = f"""WITH {_feeds_sql(WIDEST, _WRITTEN_SQL)},
{_marker('l', 'feed_line_of_work', _nb('final_label') + ' AS l1, w_raw AS l2, final_conf AS l3, final_bucket AS l4, source AS l5', '')}, {_marker('s', 'feed_segments', 'segment_groups_after AS s1', '')},
f AS (SELECT j.*, l_m.ts IS NOT NULL AS ln, l_m.ts AS lts, l1, l2, l3, l4, l5, s_m.ts IS NOT NULL AND s_m.ts > segment_groups_checked_at AS sn, s_m.ts AS sts, s1
  FROM j LEFT JOIN l_m USING (orgnr) LEFT JOIN s_m USING (orgnr))
SELECT """ + ", ".join(
    [_MERGED_SQL.replace("THEN '[\"no_https\"]' END", "THEN '[\"no_https\",\"low_' || r1 || '\"]' END")]
    + [_if("ln", f"l{i}", c) for i, c in enumerate(["line_of_work", "line_of_work_raw", "line_of_work_conf", "line_of_work_bucket", "line_of_work_source"], 1)]
    + [_if("sn", "s1", "segment_groups")]
    + [f"{_ts(f'CASE WHEN {f}n THEN {f}ts ELSE {c} END')} AS {c}" for f, c in zip("ls", ALL_TIMES[5:])]
) + " FROM f"


def _shard_sql(n: int) -> str:
    """The 128-bit digest modulo n, digit by digit."""
    out = "0"
    for i in range(4):
        out = f"(({out}) * {(1 << 32) % n} + ('0x' || substr(md5(orgnr), {8 * i + 1}, 8))::BIGINT) % {n}"
    return f"({out})::INTEGER"


# The line defects of the written feed, by feed order.
_LINES = f"""{_in_sql('feed_website')}, lines AS (SELECT *, CASE WHEN feed_order % 23 = 0 THEN 'blank' WHEN feed_order % 29 = 0 OR feed_order % 31 = 0 OR feed_order % 37 = 0 THEN 'error'
  WHEN feed_order % 19 = 0 THEN 'skipped' ELSE 'row' END AS kind FROM feed_website)"""

_SPELLED = f"""{_in_sql('spellings')}, x AS (SELECT event_id, seen_at, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 0 END AS off,
  (d || ' ' || t)::TIMESTAMP AS naive FROM spellings),
y AS (SELECT event_id, CASE WHEN off IS NULL THEN seen_at ELSE strftime(naive - off * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS seen_at, off, seen_at AS raw FROM x)"""

ORACLES = {
    "feed_scan": f"WITH {_LINES} SELECT kind, CASE WHEN kind = 'row' THEN trim(orgnr) ELSE '' END AS orgnr, count(*) AS n FROM lines WHERE kind <> 'blank' GROUP BY 1, 2",
    "feed_write": f"WITH {_CO} SELECT orgnr, name, line_of_work, {_shard_sql(4)} AS shard_id FROM companies",
    "register_bulk_scan": f"WITH {_in_sql('bulk')} SELECT organisationsidentitet, organisationsnamn, registreringsdatum, organisationsform, avregistreringsdatum, "
    "trim(postadress) AS postadress FROM bulk WHERE organisationsidentitet NOT LIKE '%7$%'",
    "filing_scan": f"WITH {ctes('company_financials')}, d AS ({FILING_NAMES}) SELECT source_file, xhtml, regexp_extract(source_file, '([0-9]{{10}})_([0-9-]{{10}})\\.xhtml$', 1) AS orgnr, "
    "regexp_extract(source_file, '([0-9]{10})_([0-9-]{10})\\.xhtml$', 2) AS end_date FROM d",
    "table_snapshot": f"WITH {ctes('company_financials')} SELECT orgnr, fiscal_year_end_date::VARCHAR AS fiscal_year_end_date, fiscal_year_end_year, revenue_sek + 1 AS revenue_sek, 1 AS version FROM company_financials",
    "register_standardize": f"WITH {_in_sql('bulk')}, {_STANDARD} SELECT orgnr, name, postort, registration_date, legal_form, company_status FROM std",
    "master_projection": f"""WITH {_in_sql('old_master')} SELECT orgnr, trim(name) AS name, coalesce({_nb('scb_municipality')}, {_nb('city')}) AS kommun, scb_region AS region, NULL::VARCHAR AS postort,
  CASE WHEN regexp_full_match(trim(employees), '[0-9]+') THEN trim(employees)::BIGINT END AS employees, sni_codes, NULL::VARCHAR AS website, hiring_status,
  TRY_CAST(line_of_work_conf AS DOUBLE) AS line_of_work_conf, NULL::VARCHAR AS legal_form FROM old_master""",
    "timestamp_standardize": f"WITH {_SPELLED} SELECT event_id, seen_at FROM y",
    "timestamp_standardize_counts": f"""WITH {_SPELLED} SELECT count(*) FILTER (off IS NULL AND trim(raw) <> '') AS seen_at_skipped,
  count(*) FILTER (off IS NOT NULL AND trim(raw) <> seen_at) AS seen_at_changed FROM y""",
    "size_class_span": f"""WITH {_in_sql('sizes')}, x AS (SELECT *, nullif(regexp_extract(coalesce(employees_class_code, ''), '[0-9]+'), '')::INT AS n, replace(lower(trim(coalesce(employees_class, ''))), '–', '-') AS s,
  employees_min IS NULL AND employees_max IS NULL AS open_span FROM sizes),
z AS (SELECT *, CASE WHEN n BETWEEN 0 AND 8 THEN [0,1,5,10,20,50,100,200,500][n + 1] WHEN starts_with(s, '0') THEN 0 ELSE nullif(regexp_extract(s, '([0-9]+)\\s*[-+]', 1), '')::INT END AS lo,
  CASE WHEN n BETWEEN 0 AND 8 THEN [0,4,9,19,49,99,199,499,NULL][n + 1] WHEN starts_with(s, '0') THEN 0 ELSE nullif(regexp_extract(s, '[0-9]+\\s*-\\s*([0-9]+)', 1), '')::INT END AS hi FROM x)
SELECT orgnr, CASE WHEN open_span THEN lo ELSE employees_min END AS employees_min, CASE WHEN open_span THEN hi ELSE employees_max END AS employees_max FROM z""",
    "code_table_fill": f"WITH {_in_sql('coded', 'codes')} SELECT orgnr, sector_code, coalesce({_nb('sector')}, label) AS sector FROM coded LEFT JOIN codes ON sector_code = code",
    "industry_code_extract": f"""WITH x AS (SELECT c_custkey, cast(62000 + c_custkey % 97 AS string) AS code FROM customer)
SELECT {_KEY} AS orgnr, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN code || ',69201' WHEN 2 THEN code || ',1' WHEN 4 THEN '__NO_SNI__' ELSE code END AS sni_codes,
  CASE c_custkey % 6 WHEN 1 THEN 'Text A' WHEN 2 THEN 'Text B | C' WHEN 3 THEN 'Text D' ELSE '' END AS sni_text,
  CASE c_custkey % 6 WHEN 0 THEN 'not_found' WHEN 4 THEN 'ok_no_sni' ELSE 'ok' END AS status FROM x""",
    "payload_flatten": f"""WITH {_in_sql('loose_payloads')} SELECT orgnr, CASE WHEN c_custkey % 5 IN (0, 1) THEN k ELSE 'unknown' END AS employees_class,
  CASE WHEN c_custkey % 5 IN (0, 1) THEN k::BIGINT END AS workplaces_count, CASE WHEN c_custkey % 5 = 0 THEN 'Ort ' || k ELSE 'unknown' END AS postort,
  CASE WHEN c_custkey % 5 = 1 THEN n_name ELSE 'unknown' END AS municipality, CASE c_custkey % 5 WHEN 0 THEN 'Västra Götaland' WHEN 4 THEN n_name ELSE 'unknown' END AS region,
  CASE WHEN c_custkey % 5 IN (2, 3) THEN 'unknown' ELSE 'ok' END AS status FROM loose_payloads""",
    "ownership_bucket": f"""WITH {_in_sql('owners')}, x AS (SELECT orgnr, lower(coalesce(private_public, '') || ' ' || coalesce(sector, '')) AS b FROM owners)
SELECT orgnr, CASE WHEN contains(b, 'stat') OR contains(b, 'kommun') OR contains(b, 'region') OR contains(b, 'offentlig') THEN 'offentlig' WHEN contains(b, 'privat') THEN 'privat' ELSE 'unknown' END AS bucket FROM x""",
    "fill_if_blank_merge": f"""WITH {ctes('companies', 'feed')}, v AS (SELECT orgnr, arg_min(found_website, feed_order) AS w FROM feed WHERE trim(found_website) <> '' GROUP BY 1)
SELECT orgnr, CASE WHEN coalesce(trim(website), '') = '' THEN coalesce(w, website) ELSE website END AS website FROM companies LEFT JOIN v USING (orgnr)""",
    "newest_wins_merge": f"""WITH {ctes('companies', 'feed')}, v AS (SELECT orgnr, status, checked_at FROM (SELECT *, row_number() OVER (PARTITION BY orgnr ORDER BY checked_at DESC, feed_order) AS rn FROM feed) WHERE rn = 1),
x AS (SELECT c.orgnr, website_status, website_checked_at, status, checked_at, checked_at IS NOT NULL AND (website_checked_at IS NULL OR checked_at > website_checked_at) AS n FROM companies c LEFT JOIN v USING (orgnr))
SELECT orgnr, CASE WHEN n THEN status ELSE website_status END AS website_status, {_ts('CASE WHEN n THEN checked_at ELSE website_checked_at END')} AS website_checked_at FROM x""",
    "signal_feeds_apply": f"WITH {_FEEDS_SQL} SELECT {_MERGED_SQL} FROM j",
    "signal_feeds_counters": f"WITH {_FEEDS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feed, count(*) FILTER ({v}) AS applied_value, count(*) FILTER ({m}) AS applied_marker FROM j HAVING count(*) FILTER ({v} OR {m}) > 0"
        for n, v, m in (("website", "wf", "wn"), ("email", "ef", "en"), ("tech", "false", "tn"), ("site_review", "false", "rn"), ("hiring", "false", "hn"))
    ),
    "feeds_end_to_end": _ALL_FEEDS_SQL,
    "incremental_feed_state": _ALL_FEEDS_SQL,
    "register_upsert": f"""WITH {_in_sql('bulk')}, {_STANDARD}, s AS (SELECT * FROM std), m AS ({REGISTER_MASTER}), r AS ({REGISTER_ROWS}),
a AS (SELECT orgnr, arg_min(name, row_order) FILTER (name IS NOT NULL) AS n, arg_min(postort, row_order) FILTER (postort IS NOT NULL) AS p,
  arg_min(registration_date, row_order) FILTER (registration_date IS NOT NULL) AS d, arg_min(legal_form, row_order) FILTER (legal_form IS NOT NULL) AS f,
  arg_max(company_status, row_order) AS st, min(row_order) AS first_row FROM r GROUP BY 1),
b AS (SELECT a.*, r.name AS first_name FROM a JOIN r ON a.orgnr = r.orgnr AND a.first_row = r.row_order)
SELECT coalesce(m.orgnr, b.orgnr) AS orgnr, CASE WHEN m.orgnr IS NULL THEN coalesce(first_name, 'ORG ' || b.orgnr) ELSE coalesce(m.name, n) END AS name, coalesce(m.postort, p) AS postort,
  coalesce(m.registration_date, d) AS registration_date, coalesce(m.legal_form, f) AS legal_form, coalesce(st, m.company_status) AS company_status FROM m FULL JOIN b ON m.orgnr = b.orgnr""",
    "insert_if_absent": f"""WITH {ctes('company_financials')} SELECT orgnr, fiscal_year_end_date::VARCHAR AS fiscal_year_end_date, fiscal_year_end_year,
  CASE WHEN fiscal_year_end_year % 2 = 0 THEN revenue_sek ELSE revenue_sek * 10 END AS revenue_sek FROM company_financials""",
    "keyed_upsert": f"""WITH {ctes('leads')}, x AS (SELECT *, orgnr::BIGINT % 2 = 0 AS old, orgnr::BIGINT % 3 = 0 AS new FROM leads)
SELECT orgnr, company_name, CASE WHEN new THEN 'second' ELSE city END AS city, CASE WHEN old THEN status ELSE 'new' END AS status, CASE WHEN old THEN 'old' ELSE 'new' END AS created_at FROM x WHERE old OR new""",
    "checks_unpivot": f"""WITH {_CO} SELECT orgnr, 'website' AS check_key, website_status AS status, strftime(website_checked_at, '%Y-%m-%d') AS checked_at, NULL::VARCHAR AS next_check_at, NULL::VARCHAR AS err_reason FROM companies
UNION ALL SELECT orgnr, 'email', email_status, NULL, NULL, NULL FROM companies
UNION ALL SELECT orgnr, 'tech', CASE WHEN right(orgnr, 1) = '4' THEN 'checked' END, CASE WHEN right(orgnr, 1) = '4' THEN '2024-01-01T00:00:00Z' END, NULL, NULL FROM companies""",
    "change_log_diff": f"""WITH {_in_sql('old_master')}, x AS (SELECT orgnr, city, coalesce({_nb('scb_municipality')}, city) AS kommun, employees, CASE WHEN regexp_full_match(trim(employees), '[0-9]+') THEN trim(employees) END AS e FROM old_master)
SELECT orgnr, 'kommun' AS field, city AS old_value, kommun AS new_value, '{NOW}' AS changed_at, 'migration' AS source FROM x WHERE city IS DISTINCT FROM kommun
UNION ALL SELECT orgnr, 'employees', employees, e, '{NOW}', 'migration' FROM x WHERE employees IS DISTINCT FROM e""",
    "change_log_between": f"""WITH {_CO} SELECT orgnr, 'employees' AS field, employees::VARCHAR AS old_value, (employees + 1)::VARCHAR AS new_value, '{NOW}' AS changed_at, 'register' AS source FROM companies WHERE orgnr::BIGINT % 97 = 0
UNION ALL SELECT orgnr, 'city', city, NULL, '{NOW}', 'register' FROM companies WHERE orgnr::BIGINT % 89 = 0""",
    "enrichment_merge": f"""WITH {_CO}, r AS ({ENRICH_RECORDS}), x AS (SELECT c.orgnr, CASE WHEN right(c.orgnr, 1) = '2' THEN '' ELSE name END AS name, r.*, status = 'ok' AS ok FROM companies c LEFT JOIN r ON c.orgnr = r.orgnr)
SELECT orgnr, CASE WHEN name = '' AND status IS NOT NULL THEN CASE WHEN ok THEN v_name END ELSE name END AS name, CASE WHEN ok THEN v_size END AS employees_class_code,
  CASE WHEN ok THEN [0,1,5,10,20,50,100,200,500][v_size::INT + 1] END AS employees_min, CASE WHEN ok THEN [0,4,9,19,49,99,199,499,NULL][v_size::INT + 1] END AS employees_max,
  CASE WHEN ok THEN v_work::INT END AS workplaces_count, CASE WHEN ok THEN v_mun END AS municipality, CASE WHEN ok THEN v_stat END AS company_status_code, CASE WHEN ok THEN {_nb('v_sector')} END AS sector,
  status AS scb_status, err_reason AS scb_err_reason, CASE WHEN status IS NOT NULL THEN '{NOW}' END AS scb_checked_at, CASE WHEN status IS NOT NULL THEN '2024-04-30 00:00:00' END AS scb_next_check_at FROM x""",
    "enrichment_run_stats": f"""WITH r AS ({ENRICH_RECORDS}), o AS (SELECT * FROM r WHERE status = 'ok'), u AS (
SELECT 'filled' AS stat, f AS value, count(*) AS n FROM o, (SELECT unnest(['name','employees_class_code','employees_min','workplaces_count','municipality','company_status_code']) AS f) GROUP BY f
UNION ALL SELECT 'filled', 'employees_max', count(*) FROM o WHERE v_size <> '8' UNION ALL SELECT 'null', 'employees_max', count(*) FROM o WHERE v_size = '8'
UNION ALL SELECT 'filled', 'sector', count(*) FROM o WHERE v_sector <> ' ' UNION ALL SELECT 'null', 'sector', count(*) FROM o WHERE v_sector = ' '
UNION ALL SELECT 'null', f, count(*) FROM o, (SELECT unnest(['employees_class','post_address','post_code','postort','municipality_code','region','region_code','legal_form','legal_form_code','company_status','tax_registration','tax_registration_code','industry_code','industry_code_primary','private_public_code','private_public','sector_code']) AS f) GROUP BY f
UNION ALL SELECT 'status', status, count(*) FROM r GROUP BY status
UNION ALL SELECT 'activity', CASE v_stat WHEN '1' THEN 'active' ELSE 'deregistered' END, count(*) FROM o GROUP BY v_stat UNION ALL SELECT 'activity', 'missing', count(*) FROM r WHERE status = 'not_found'
UNION ALL SELECT 'ownership', CASE WHEN status = 'ok' AND v_sector = 'Statlig' THEN 'offentlig' ELSE 'unknown' END AS b, count(*) FROM r GROUP BY b
UNION ALL SELECT 'error', CASE WHEN starts_with(err_reason, '403') THEN '403' ELSE 'timeout' END AS b, count(*) FROM r WHERE status = 'err' GROUP BY b) SELECT * FROM u WHERE n > 0""",
    "refresh_due": f"WITH {_CO} SELECT orgnr FROM companies WHERE trim(website) = '' OR website_checked_at IS NULL OR website_checked_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY",
    "due_queue_topk": f"WITH {_CO} SELECT orgnr FROM companies WHERE website_checked_at IS NULL OR website_checked_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY ORDER BY website_checked_at ASC NULLS FIRST, orgnr LIMIT 200",
    "scheduled_queue_topk": f"WITH {ctes('company_checks')} SELECT id FROM company_checks WHERE next_check_at <= TIMESTAMP '2024-04-10 00:00:00' ORDER BY next_check_at, id LIMIT 200",
    "stable_hash_shard": f"WITH {_CO} SELECT orgnr, {_shard_sql(7)} AS shard_id FROM companies",
    "resume_anti_join": f"WITH {ctes('companies', 'feed')} SELECT orgnr, name FROM companies WHERE orgnr NOT IN (SELECT orgnr FROM feed)",
    "next_check_schedule": f"""WITH {_CO} SELECT orgnr, {_ts(f"TIMESTAMP '{NOW}' + CASE WHEN website_checked_at IS NOT NULL THEN INTERVAL 90 DAY WHEN employees % 2 = 0 THEN INTERVAL 14 DAY ELSE INTERVAL 2 DAY END")} AS next_check_at FROM companies""",
    "incremental_feed_apply": f"""WITH {_CO}, {_LINES}, g AS (SELECT feed_order, trim(orgnr) AS orgnr, coalesce(lower({_nb('status')}), 'checked') AS status, {_nb('found_website')} AS val, checked_at FROM lines WHERE kind = 'row'),
wv AS (SELECT orgnr, arg_min(val, feed_order % 3 * 1000000000 + feed_order) AS val FROM g WHERE val IS NOT NULL GROUP BY 1), {_marker('w', 'g', 'status', '')},
x AS (SELECT c.*, val, w_m.status, ts, ts IS NOT NULL AND (website_checked_at IS NULL OR ts > website_checked_at) AS n FROM companies c LEFT JOIN wv USING (orgnr) LEFT JOIN w_m USING (orgnr))
SELECT orgnr, CASE WHEN coalesce(trim(website), '') = '' THEN coalesce(val, website) ELSE website END AS website, CASE WHEN n THEN status ELSE website_status END AS website_status,
  {_ts('CASE WHEN n THEN ts ELSE website_checked_at END')} AS website_checked_at FROM x""",
}
