"""Registered queries: targeting, send queue, outcomes, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from firmweave.operators import outreach, reports, targeting as tg
from firmweave.session import staged
from firmweave.plans.adapters import NOW, adapter, ctes, sql
from firmweave.plans.register_queries import _companies, _text_time, _ts, _write_website_feed
from firmweave.sources.feeds import feed_lines

# Companies as targeting reads them, with the optional columns.
TARGETS = """
SELECT orgnr, name, city, employees, sni_codes, website, emails, website_status, email_status,
  cast(website_checked_at AS string) AS created_at,
  CASE WHEN employees % 5 = 0 THEN '2023-11-05T10:00:00Z' END AS started_at,
  CASE WHEN employees % 3 = 0 THEN 'yes' WHEN employees % 3 = 1 THEN ' ' END AS tech_footprint_status
FROM companies"""
GROUPS = """SELECT 1 AS id, 'office' AS group_key, 'exact' AS match_mode UNION ALL SELECT 2, 'tech', 'prefix' UNION ALL SELECT 3, 'other', 'prefix'"""
ITEMS = """SELECT 1 AS group_id, '69' AS pattern UNION ALL SELECT 1, '65000' UNION ALL SELECT 2, '620' UNION ALL SELECT 2, NULL UNION ALL SELECT 3, '1'"""
MANUAL_STOPS = """
SELECT id, lead_id, campaign_id, message_id,
  CASE WHEN type = 'delivered' AND id % 5 = 0 THEN 'sent' WHEN type = 'accepted' AND id % 3 = 0 THEN 'failed' WHEN type = 'reply' AND id % 7 = 0 THEN 'manual_stop' ELSE type END AS type,
  concat('r', cast(id AS string)) AS reason, created_at FROM outcome_events"""
TEMPLATES = """
SELECT 1 AS id, 'Hello {{company_name}}' AS subject, 'Dear {{ contact_name | default:"friend" }} in {{city}}, {{missing | default:"n/a"}}{{gone}} {{website}}' AS body
UNION ALL SELECT 2, 'Again {{orgnr}}', 'No placeholder' UNION ALL SELECT 3, '{{your_company}}', '{{emails}}|{{your_contact_info}}'
UNION ALL SELECT 4, 'Last', '{{ city }}{{city}}'"""
CAMPAIGN_TEMPLATES = """
SELECT 1 AS campaign_id, 1 AS step, 'A' AS variant, 1 AS template_id UNION ALL SELECT 1, 1, 'B', 2 UNION ALL SELECT 1, 2, 'B', 3
UNION ALL SELECT 2, 1, 'C', 4 UNION ALL SELECT 2, 2, 'A', 1 UNION ALL SELECT 2, 2, 'B', 2"""
CAMPAIGNS = "SELECT 1 AS id, 'supplier_intro' AS name UNION ALL SELECT 2, 'customer_intro'"
# One template path per part: every folder form, both extensions.
TEMPLATE_PATHS = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'customer' WHEN p_partkey % 31 = 0 THEN 'other' ELSE 'supplier' END AS audience,
  CASE p_partkey % 9 WHEN 0 THEN 'email_customer_intro/intro_a.html' WHEN 1 THEN 'email_supplier_intro/Intro-B.txt' WHEN 2 THEN 'email_customer_intro/C.html'
    WHEN 3 THEN 'email_customer_followup_intro/followup_intro_1.html' WHEN 4 THEN 'email_x_followup_intro/followup_intro_2.txt' WHEN 5 THEN 'email_customer_review/review.html'
    WHEN 6 THEN 'email_y_followup/FU3_b.html' WHEN 7 THEN 'signature_main' ELSE 'email_customer_contract/contract.html' END AS name
FROM part"""

SPEC = tg.TargetSpec(
    cities=("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5", "NATION_6", "NATION_7"),
    codes=("62", "68"), employees=("0-49", "100-199", "250+"), limit=300, limit_stage="sql",
)
SPEC_ALL = replace(SPEC, limit=None)
FOUNDED = tg.TargetSpec(founded_min="2023-09-01", founded_max="2023-12-31", tech=True)


def _targets(spark, sf_dir):
    return sql(spark, sf_dir, TARGETS, companies=_companies(spark, sf_dir))


def _events(spark, sf_dir):
    df = sql(spark, sf_dir, MANUAL_STOPS, outcome_events=adapter(spark, sf_dir, "outcome_events"))
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _messages(spark, sf_dir):
    df = adapter(spark, sf_dir, "email_messages")
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "sent_at")})


def _links(spark, sf_dir):
    return adapter(spark, sf_dir, "lead_campaigns").withColumn("next_send_at", F.col("next_send_at").cast("timestamp"))


def _plain_events(spark, sf_dir):
    df = adapter(spark, sf_dir, "outcome_events")
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


# ---- targeting ----


def target_filter(spark, sf_dir):
    return tg.target_filter(_targets(spark, sf_dir), SPEC).select("orgnr", "city", "employees", "sni_codes")


def target_filter_all(spark, sf_dir):
    return tg.target_filter(_targets(spark, sf_dir), SPEC_ALL).select("orgnr", "city", "employees", "sni_codes")


def target_filter_founded(spark, sf_dir):
    return tg.target_filter(_targets(spark, sf_dir), FOUNDED).select("orgnr", "started_at")


def industry_code_match(spark, sf_dir):
    df = _companies(spark, sf_dir).select("orgnr", "sni_codes")
    df = df.withColumn("sni_codes", F.when(F.col("orgnr") % 2 == 0, F.concat(F.lit('["'), F.regexp_replace("sni_codes", ",", '", "'), F.lit('"]'))).otherwise(F.col("sni_codes")))
    return (
        tg.industry_code_match(df, ["65000", "69003"], "exact").withColumn("mode", F.lit("exact"))
        .unionByName(tg.industry_code_match(df, ["63", "6900"], "prefix").withColumn("mode", F.lit("prefix")))
    )


def industry_group_expand(spark, sf_dir):
    """The groups' patterns, and how many companies each of them matches."""
    patterns = tg.industry_group_expand(spark.sql(GROUPS), spark.sql(ITEMS), ["office", "tech"])
    df = _companies(spark, sf_dir).select("sni_codes")
    row = df.agg(*[F.count_if(tg.code_match("sni_codes", [p])).alias(p) for p in patterns])
    cells = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"`{p}`").alias("n")) for p in patterns])
    return row.select(F.explode(cells).alias("x")).select("x.*")


def industry_group_match(spark, sf_dir):
    df = _companies(spark, sf_dir).select("orgnr", "sni_codes")
    return tg.industry_group_match(df, spark.sql(GROUPS), spark.sql(ITEMS), ["office", "tech"])


def suppression_anti_join(spark, sf_dir):
    return tg.suppression_anti_join(
        _companies(spark, sf_dir).select("orgnr"), adapter(spark, sf_dir, "do_not_contact"),
        adapter(spark, sf_dir, "leads"), _plain_events(spark, sf_dir),
    )


def tier_score(spark, sf_dir):
    """Unfiltered candidates, all filters active."""
    df = tg._candidates(_targets(spark, sf_dir))
    out = tg.tier_score(df, {f: f != "review" for f in tg.FILTERS})
    return out.select("orgnr", "tier", "score", F.to_json("flags").alias("flags"))


def stagger_schedule(spark, sf_dir):
    out = tg.stagger_schedule(_companies(spark, sf_dir).select("orgnr"), NOW, 2)
    return out.withColumns(_text_time("next_send_at"))


def _load(spark, sf_dir, spec=SPEC):
    leads = adapter(spark, sf_dir, "leads").where("id % 3 <> 0")
    leads = leads.select(
        "id", "orgnr", "company_name", "city", F.lit(None).cast("string").alias("sni_codes"), F.lit(None).cast("string").alias("website"),
        "emails", F.lit("supplier").alias("lead_type"), "status", F.lit("2023-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.lit("2023-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )
    links = _links(spark, sf_dir).where("id % 3 <> 0").select(
        "id", F.col("lead_id"), "campaign_id", "current_step", "current_variant", "next_send_at", "stopped_reason",
        F.lit(NOW).cast("timestamp").alias("created_at"), F.lit(NOW).cast("timestamp").alias("updated_at"), "tier",
        F.lit("{}").alias("match_flags"), "score",
    )
    return tg.lead_campaign_load(
        _targets(spark, sf_dir), leads, links, _plain_events(spark, sf_dir), adapter(spark, sf_dir, "do_not_contact"),
        spec, tg.Campaign(2, "customer"), NOW,
    )


def _loaded(spark, sf_dir, spec):
    """Leads joined to their links of the loaded campaign."""
    leads, links, _ = _load(spark, sf_dir, spec)
    links = links.where("campaign_id = 2").select(
        F.col("lead_id").alias("id"), F.col("tier").alias("link_tier"), F.col("score").alias("link_score"), "next_send_at",
        F.get_json_object("match_flags", "$.city_ok").alias("city_ok"),
    )
    out = leads.select("id", "orgnr", "city", "lead_type", "status", "created_at").join(links, "id", "left")
    return out.withColumns(_text_time("created_at", "next_send_at"))


def lead_campaign_load(spark, sf_dir):
    """Of the first 300 companies, as its twin has it; ``lead_campaign_load_all`` loads all."""
    return _loaded(spark, sf_dir, SPEC)


def lead_campaign_load_all(spark, sf_dir):
    return _loaded(spark, sf_dir, SPEC_ALL)


def lead_campaign_summary(spark, sf_dir):
    return _load(spark, sf_dir)[2]


def lead_campaign_summary_all(spark, sf_dir):
    return _load(spark, sf_dir, SPEC_ALL)[2]


# ---- send queue and outcomes ----


def _queue(spark, sf_dir, campaign_id=1, n=None):
    leads = adapter(spark, sf_dir, "leads").withColumn("website", F.concat(F.lit("https://w"), "id")).withColumn("sni_codes", F.lit(None).cast("string"))
    return outreach.due_send_queue(_links(spark, sf_dir), leads, campaign_id, NOW, n)


def due_send_queue(spark, sf_dir):
    return _queue(spark, sf_dir, n=200).select("id", "orgnr", "tier", "score", "next_send_at").withColumns(_text_time("next_send_at"))


def template_pick(spark, sf_dir):
    return outreach.template_pick(_links(spark, sf_dir), spark.sql(CAMPAIGN_TEMPLATES)).select(
        "id", "campaign_id", "current_step", "current_variant", "variant", "template_id"
    )


def _rendered(spark, sf_dir):
    queue = outreach.template_pick(_queue(spark, sf_dir), spark.sql(CAMPAIGN_TEMPLATES))
    return outreach.message_render(
        queue, spark.sql(TEMPLATES), NOW, from_name="Firm", from_email="me@firm.example.com", signature_html="<b>Me</b>", signature_text="Me"
    )


def message_render(spark, sf_dir):
    return _rendered(spark, sf_dir).select("lead_id", "step", "variant", "to_email", "subject_rendered", "body_rendered", "text_rendered", "status")


def sequence_advance(spark, sf_dir):
    sent = _rendered(spark, sf_dir).select("lead_id", "campaign_id", "step", "variant")
    out = outreach.sequence_advance(_links(spark, sf_dir), sent, NOW)
    return out.select("id", "current_step", "current_variant", "next_send_at").withColumns(_text_time("next_send_at"))


def _folded(spark, sf_dir):
    return outreach.outcome_fold(
        adapter(spark, sf_dir, "leads"), _links(spark, sf_dir), _messages(spark, sf_dir), _events(spark, sf_dir)
    )


def outcome_fold(spark, sf_dir):
    """Lead status and stop reasons after the fold."""
    leads, links, _ = _folded(spark, sf_dir)
    return leads.select(F.col("id").alias("lead_id"), "status").join(
        links.select("lead_id", "campaign_id", "stopped_reason"), "lead_id", "left"
    )


def outcome_fold_in_parts(spark, sf_dir):
    """The same fold from three parts of the log, each merged into the stored state of those before."""
    events, state = _events(spark, sf_dir), None
    for part in range(3):
        new = outreach.outcome_state(events.where(F.col("id") % 3 == part))
        if state is None:
            state = staged(new)
        else:
            changed = staged(outreach.changed_outcomes(state, new))
            same = [state[c].eqNullSafe(changed[c]) for c in outreach.OUTCOME_KEYS]
            state = staged(state.join(changed, same[0] & same[1] & same[2], "left_anti").unionByName(changed))
    leads, links, _ = outreach.apply_outcomes(adapter(spark, sf_dir, "leads"), _links(spark, sf_dir), _messages(spark, sf_dir), state)
    return leads.select(F.col("id").alias("lead_id"), "status").join(links.select("lead_id", "campaign_id", "stopped_reason"), "lead_id", "left")


def outcome_fold_messages(spark, sf_dir):
    out = _folded(spark, sf_dir)[2]
    return out.select("id", "status", "error", "sent_at").withColumns(_text_time("sent_at"))


def sequence_catalog(spark, sf_dir):
    return outreach.sequence_catalog(sql(spark, sf_dir, TEMPLATE_PATHS))


def sequence_coverage(spark, sf_dir):
    return outreach.sequence_coverage(outreach.sequence_catalog(sql(spark, sf_dir, TEMPLATE_PATHS)))


# ---- reports ----


def column_coverage(spark, sf_dir):
    return reports.column_coverage(_companies(spark, sf_dir), ["website", "emails", "sni_codes", "region", "website_checked_at"], ["employees"])


def value_distribution(spark, sf_dir):
    return reports.value_distribution(_messages(spark, sf_dir), "error", 15)


def freshness_windows(spark, sf_dir):
    return reports.freshness_windows(_messages(spark, sf_dir), "sent_at", NOW).withColumns(_text_time("newest"))


def top_n_groups(spark, sf_dir):
    return reports.top_n_groups(adapter(spark, sf_dir, "leads"), "city", 10)


TOP_PARTS = "SELECT l_partkey AS part, CASE WHEN l_orderkey % 3 = 0 THEN ' hot ' WHEN l_orderkey % 20 = 1 THEN '' WHEN l_orderkey % 20 = 2 THEN 'warm' ELSE concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) END AS line FROM lineitem"


def top_values(spark, sf_dir):
    """A column with nearly as many values as rows and one without frequent values."""
    df = sql(spark, sf_dir, TOP_PARTS)
    line, part = reports.top_values(df, "line", 3), reports.top_values(df, "part", 12, tracked=512)
    return line.select(F.lit("line").alias("column"), "value", "n").unionByName(part.select(F.lit("part").alias("column"), "value", "n"))


KINDS = {"websites": "website", "emails": "email", "tech": "tech", "site_review": "site_review", "hiring": "hiring"}


def feed_reconciliation(spark, sf_dir):
    lines = feed_lines(spark, [_write_website_feed(spark, sf_dir)]).where("trim(value) <> ''")
    files = lines.groupBy("file_path").agg(F.count("*").alias("n")).select(F.lit("websites").alias("feed"), F.col("file_path").alias("file"), "n")
    out = reports.feed_reconciliation(files, adapter(spark, sf_dir, "company_checks"), KINDS)
    return out.withColumns(_text_time("newest_check"))


def delivery_class(spark, sf_dir):
    return reports.delivery_class(_messages(spark, sf_dir), _plain_events(spark, sf_dir))


def stale_accepted(spark, sf_dir):
    return reports.stale_accepted(_messages(spark, sf_dir), _plain_events(spark, sf_dir), "2024-01-20 00:00:00")


def reputation_verdict(spark, sf_dir):
    dns = spark.sql("SELECT true AS spf, false AS dmarc, false AS listed")
    out = reports.reputation_verdict(_messages(spark, sf_dir), _plain_events(spark, sf_dir), dns, NOW)
    return out.withColumns({c: F.round(c, 6) for c in ("bounce_rate_7d", "complaint_rate_30d")})


def sequence_queue_report(spark, sf_dir):
    return reports.sequence_queue_report(_links(spark, sf_dir), spark.sql(CAMPAIGNS))


def latest_links(spark, sf_dir):
    return reports.latest_links(_links(spark, sf_dir), spark.sql(CAMPAIGNS)).withColumns(_text_time("next_send_at"))


def tier_summary(spark, sf_dir):
    return reports.tier_summary(_links(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        target_filter, target_filter_all, target_filter_founded, industry_code_match, industry_group_expand, industry_group_match, suppression_anti_join, tier_score,
        stagger_schedule, lead_campaign_load, lead_campaign_load_all, lead_campaign_summary, lead_campaign_summary_all,
        due_send_queue, template_pick, message_render, sequence_advance, outcome_fold, outcome_fold_in_parts, outcome_fold_messages,
        sequence_catalog, sequence_coverage,
        column_coverage, value_distribution, freshness_windows, top_n_groups, top_values, feed_reconciliation, delivery_class, stale_accepted,
        reputation_verdict, sequence_queue_report, latest_links, tier_summary,
    )
}

# ---- SQL twins ----

_CO = ctes("companies")
_TG = f"{_CO}, targets AS ({TARGETS})"
_BASE = (
    "website_status = 'found' AND email_status = 'found' AND trim(coalesce(emails, '')) <> '' "
    "AND trim(coalesce(sni_codes, '')) NOT IN ('', '__NO_SNI__', '00000')"
)
_PICK = (
    f"{_BASE} AND city IN ({', '.join(repr(c) for c in SPEC.cities)}) AND (employees BETWEEN 0 AND 49 OR employees BETWEEN 100 AND 199 OR employees >= 250) "
    "AND (sni_codes LIKE '62%' OR sni_codes LIKE '%,62%' OR sni_codes LIKE '68%' OR sni_codes LIKE '%,68%')"
)
_PICKED = f"picked AS (SELECT * FROM targets WHERE {_PICK} ORDER BY orgnr LIMIT 300)"
_BORN = "coalesce(TRY_CAST(started_at AS TIMESTAMPTZ)::TIMESTAMP, TRY_CAST(created_at AS TIMESTAMP))"
_BLOCKED = f"""{ctes('do_not_contact', 'leads', 'outcome_events')},
blocked AS (SELECT orgnr FROM do_not_contact UNION SELECT orgnr FROM leads WHERE status = 'do_not_contact'
  UNION SELECT orgnr FROM leads JOIN outcome_events e ON e.lead_id = leads.id WHERE e.type IN ('unsubscribe', 'bounce'))"""
_ID = "('0x' || substr(md5({x}), 1, 15))::BIGINT"
_LOAD = f"""{_TG}, {_PICKED}, {_BLOCKED}, {ctes('lead_campaigns')},
ok AS (SELECT *, row_number() OVER (ORDER BY orgnr) - 1 AS idx FROM picked WHERE orgnr NOT IN (SELECT orgnr FROM blocked)),
ready AS (SELECT *, 1 AS tier, 500 + 10 + 3 AS score FROM ok),
old AS (SELECT * FROM leads WHERE id % 3 <> 0),
nl AS (SELECT coalesce(old.id, {_ID.format(x='r.orgnr')}) AS id, coalesce(old.orgnr, r.orgnr) AS orgnr, CASE WHEN r.orgnr IS NOT NULL THEN r.city ELSE old.city END AS city,
  CASE WHEN r.orgnr IS NOT NULL THEN 'customer' ELSE 'supplier' END AS lead_type, CASE WHEN old.id IS NULL THEN 'new' ELSE old.status END AS status,
  CASE WHEN old.id IS NULL THEN '{NOW}' ELSE '2023-01-01 00:00:00' END AS created_at, r.tier, r.score, r.idx FROM old FULL JOIN ready r ON old.orgnr = r.orgnr),
ol AS (SELECT * FROM lead_campaigns WHERE id % 3 <> 0 AND campaign_id = 2)"""
_EV = f"{ctes('outcome_events')}, ev AS ({MANUAL_STOPS})"
_FLAGS = """em AS (SELECT message_id AS id, bool_or(type IN ('bounced','complaint','bounce','failed')) AS f, bool_or(type = 'delivered') AS d, bool_or(type IN ('accepted','sent')) AS a
  FROM outcome_events WHERE message_id IS NOT NULL GROUP BY 1)"""
_QUEUE = f"""{ctes('lead_campaigns', 'leads')},
queue AS (SELECT lc.id, lc.lead_id, lc.campaign_id, lc.current_step, lc.current_variant, lc.next_send_at, lc.tier, lc.score, l.orgnr, l.company_name, l.city, l.emails, 'https://w' || l.id::VARCHAR AS website
  FROM lead_campaigns lc JOIN leads l ON l.id = lc.lead_id WHERE lc.campaign_id = 1 AND lc.stopped_reason IS NULL AND (lc.next_send_at IS NULL OR lc.next_send_at <= TIMESTAMP '{NOW}')
  AND l.status <> 'do_not_contact'{{order}})"""
_FIRST = " ORDER BY lc.tier ASC NULLS LAST, lc.score DESC, lc.next_send_at ASC NULLS FIRST, lc.id LIMIT 200"
_CT = f"""ct AS ({CAMPAIGN_TEMPLATES}), cf AS (SELECT campaign_id, step, min(variant) AS variant, arg_min(template_id, variant) AS template_id FROM ct GROUP BY 1, 2)"""


def _picked_template(source: str) -> str:
    return f"""SELECT q.*, coalesce(ct.variant, cf.variant) AS variant, coalesce(ct.template_id, cf.template_id) AS template_id FROM {source} q
  LEFT JOIN ct ON ct.campaign_id = q.campaign_id AND ct.step = q.current_step AND ct.variant = q.current_variant
  LEFT JOIN cf ON cf.campaign_id = q.campaign_id AND cf.step = q.current_step"""


ORACLES = {
    "target_filter": f"WITH {_TG}, {_PICKED} SELECT orgnr, city, employees, sni_codes FROM picked",
    "target_filter_founded": f"""WITH {_TG}, p AS (SELECT * FROM targets WHERE {_BASE})
SELECT orgnr, started_at FROM p WHERE {_BORN} >= TIMESTAMP '2023-09-01' AND {_BORN} <= TIMESTAMP '2023-12-31' AND trim(coalesce(tech_footprint_status, '')) <> ''""",
    "industry_code_match": f"""WITH {_CO}, x AS (SELECT orgnr, CASE WHEN orgnr::BIGINT % 2 = 0 THEN '["' || replace(sni_codes, ',', '", "') || '"]' ELSE sni_codes END AS sni_codes FROM companies)
SELECT orgnr, sni_codes, 'exact' AS mode FROM x WHERE {' OR '.join(f"trim(sni_codes) = '{p}' OR sni_codes LIKE '{p},%' OR sni_codes LIKE '%,{p},%' OR sni_codes LIKE '%,{p}' OR sni_codes LIKE '%" + '"' + p + '"' + "%'" for p in ('65000', '69003'))}
UNION ALL SELECT orgnr, sni_codes, 'prefix' FROM x WHERE {' OR '.join(f"trim(sni_codes) LIKE '{p}%' OR sni_codes LIKE '%,{p}%' OR sni_codes LIKE '%" + '"' + p + "%'" for p in ('63', '6900'))}""",
    "industry_group_expand": f"""WITH {_CO}, g AS ({GROUPS}), i AS ({ITEMS}), p AS (SELECT pattern FROM g JOIN i ON g.id = i.group_id WHERE group_key IN ('office', 'tech') AND pattern IS NOT NULL)
SELECT pattern, count(*) FILTER (sni_codes LIKE pattern || '%' OR sni_codes LIKE '%,' || pattern || '%') AS n FROM p, companies GROUP BY pattern""",
    "industry_group_match": f"""WITH {_CO}, g AS ({GROUPS}), i AS ({ITEMS}), p AS (SELECT pattern FROM g JOIN i ON g.id = i.group_id WHERE group_key IN ('office', 'tech') AND pattern IS NOT NULL)
SELECT orgnr, sni_codes FROM companies WHERE EXISTS (SELECT 1 FROM p WHERE sni_codes LIKE pattern || '%' OR sni_codes LIKE '%,' || pattern || '%')""",
    "suppression_anti_join": f"WITH {_CO}, {_BLOCKED} SELECT orgnr FROM companies WHERE orgnr NOT IN (SELECT orgnr FROM blocked)",
    "tier_score": f"""WITH {_TG}, x AS (SELECT orgnr, trim(coalesce(city, '')) <> '' AS c, trim(coalesce(sni_codes, '')) <> '' AS s, employees IS NOT NULL AS e, {_BORN} IS NOT NULL AS f,
  trim(coalesce(tech_footprint_status, '')) <> '' AS t FROM targets), m AS (SELECT *, (NOT c)::INT + (NOT s)::INT + (NOT e)::INT + (NOT f)::INT + (NOT t)::INT AS misses FROM x)
SELECT orgnr, least(1 + misses, 5) AS tier, (6 - least(1 + misses, 5)) * 100 + greatest(0, 10 - misses) + 5 AS score,
  '{{"city_ok":' || c || ',"sni_ok":' || s || ',"employees_ok":' || e || ',"founded_ok":' || f || ',"tech_ok":' || t || ',"review_ok":true}}' AS flags FROM m""",
    "stagger_schedule": f"WITH {_CO} SELECT orgnr, {_ts(f'TIMESTAMP {NOW!r} + (row_number() OVER (ORDER BY orgnr) - 1) * INTERVAL 2 MINUTE')} AS next_send_at FROM companies",
    "lead_campaign_load": f"""WITH {_LOAD} SELECT nl.id, nl.orgnr, nl.city, nl.lead_type, nl.status, nl.created_at, coalesce(ol.tier, CASE WHEN ol.id IS NULL THEN nl.tier END) AS link_tier,
  coalesce(ol.score, nl.score) AS link_score, {_ts(f"CASE WHEN ol.id IS NOT NULL THEN ol.next_send_at WHEN nl.tier IS NOT NULL THEN TIMESTAMP '{NOW}' + nl.idx * INTERVAL 2 MINUTE END")} AS next_send_at,
  CASE WHEN ol.id IS NULL AND nl.tier IS NOT NULL THEN 'true' END AS city_ok FROM nl LEFT JOIN ol ON ol.lead_id = nl.id""",
    "lead_campaign_summary": f"""WITH {_LOAD} SELECT count(*) AS matched_after_filters, count(*) AS upserted_leads, count(*) AS t1, 0::BIGINT AS t2, 0::BIGINT AS t3, 0::BIGINT AS t4, 0::BIGINT AS t5,
  count(*) FILTER (ol.id IS NULL) AS new_campaign_links FROM nl LEFT JOIN ol ON ol.lead_id = nl.id WHERE nl.tier IS NOT NULL""",
    "due_send_queue": f"WITH {_QUEUE.format(order=_FIRST)} SELECT id, orgnr, tier, score, {_ts('next_send_at')} AS next_send_at FROM queue",
    "template_pick": f"WITH {ctes('lead_campaigns')}, {_CT}, x AS ({_picked_template('lead_campaigns')}) SELECT id, campaign_id, current_step, current_variant, variant, template_id FROM x",
    "message_render": f"""WITH {_QUEUE.format(order='')}, {_CT}, x AS ({_picked_template('queue')})
SELECT lead_id, current_step AS step, variant, emails AS to_email,
  CASE template_id WHEN 1 THEN 'Hello ' || company_name WHEN 2 THEN 'Again ' || orgnr WHEN 3 THEN 'Firm' ELSE 'Last' END AS subject_rendered, b || '<br><br><b>Me</b>' AS body_rendered, b || chr(10) || chr(10) || 'Me' AS text_rendered, 'queued' AS status
FROM (SELECT *, CASE template_id WHEN 1 THEN 'Dear  in ' || city || ', n/a ' || website WHEN 2 THEN 'No placeholder' WHEN 3 THEN emails || '|me@firm.example.com' ELSE city || city END AS b FROM x) WHERE emails <> '' AND template_id IS NOT NULL""",
    "sequence_advance": f"""WITH {_QUEUE.format(order='')}, {_CT}, x AS ({_picked_template('queue')}), s AS (SELECT lead_id, campaign_id, current_step AS step, variant FROM x WHERE emails <> '' AND template_id IS NOT NULL)
SELECT lc.id, CASE WHEN s.step IS NOT NULL THEN s.step + 1 ELSE lc.current_step END AS current_step, CASE WHEN s.step IS NOT NULL THEN s.variant ELSE lc.current_variant END AS current_variant,
  {_ts(f"CASE WHEN s.step IS NOT NULL THEN TIMESTAMP '{NOW}' + INTERVAL 24 HOUR ELSE lc.next_send_at END")} AS next_send_at FROM lead_campaigns lc LEFT JOIN s ON s.lead_id = lc.lead_id AND s.campaign_id = lc.campaign_id""",
    "outcome_fold": f"""WITH {_EV}, {ctes('leads', 'lead_campaigns')},
st AS (SELECT lead_id, arg_max(s, (created_at, id)) AS s FROM (SELECT *, CASE WHEN type IN ('bounce','complaint','manual_stop') THEN 'do_not_contact' WHEN type = 'sent' AND message_id IS NULL THEN 'contacted' WHEN type IN ('booked','won') THEN type END AS s FROM ev) WHERE s IS NOT NULL GROUP BY 1),
ov AS (SELECT lead_id, campaign_id, arg_max(CASE type WHEN 'bounce' THEN 'bounced' ELSE type END, (created_at, id)) AS o FROM ev WHERE type IN ('bounce','booked','won') GROUP BY 1, 2),
gu AS (SELECT l.lead_id, l.campaign_id, arg_min(CASE type WHEN 'reply' THEN 'replied' ELSE type END, (e.created_at, e.id)) AS g FROM lead_campaigns l JOIN ev e ON e.lead_id = l.lead_id
  AND (e.type IN ('complaint','manual_stop') OR (e.type = 'reply' AND e.campaign_id = l.campaign_id)) GROUP BY 1, 2)
SELECT leads.id AS lead_id, coalesce(st.s, leads.status) AS status, lc.campaign_id, coalesce(ov.o, lc.stopped_reason, gu.g) AS stopped_reason FROM leads LEFT JOIN st ON st.lead_id = leads.id
  LEFT JOIN lead_campaigns lc ON lc.lead_id = leads.id LEFT JOIN ov ON ov.lead_id = lc.lead_id AND ov.campaign_id = lc.campaign_id LEFT JOIN gu ON gu.lead_id = lc.lead_id AND gu.campaign_id = lc.campaign_id""",
    "outcome_fold_messages": f"""WITH {_EV}, {ctes('email_messages')}, m AS (SELECT message_id AS id, arg_max(CASE type WHEN 'bounce' THEN 'bounced' ELSE type END, (created_at, ev.id)) AS s, max(created_at) FILTER (type = 'sent') AS st,
  arg_max(reason, (created_at, ev.id)) FILTER (type <> 'sent') AS r, bool_or(type <> 'sent') AS bad FROM ev WHERE message_id IS NOT NULL AND type IN ('sent','failed','bounce') GROUP BY 1)
SELECT e.id, coalesce(s, status) AS status, CASE WHEN bad THEN r ELSE error END AS error, {_ts('coalesce(st, sent_at)')} AS sent_at FROM email_messages e LEFT JOIN m ON e.id = m.id""",
    "sequence_catalog": f"""WITH t AS ({TEMPLATE_PATHS}), x AS (SELECT *, audience || '_intro' AS campaign,
  CASE p_kind WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 4 END AS step, CASE p_kind WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 6 THEN 'B' ELSE 'A' END AS variant FROM (SELECT *, (id % 9)::INT AS p_kind FROM t) WHERE audience <> 'other')
SELECT campaign, step, variant, max(id) AS template_id, arg_max(name, id) AS template_name FROM x WHERE step IS NOT NULL GROUP BY 1, 2, 3""",
    "column_coverage": f"WITH {_CO}, t AS (SELECT count(*) AS n FROM companies) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (trim(coalesce({c}::VARCHAR, '')) <> '') AS n, round(count(*) FILTER (trim(coalesce({c}::VARCHAR, '')) <> '') * 100.0::DOUBLE / (SELECT n FROM t), 1) AS pct FROM companies"
        for c in ("website", "emails", "sni_codes", "region", "website_checked_at", "employees")
    ),
    "value_distribution": f"WITH {ctes('email_messages')} SELECT coalesce(nullif(trim(error), ''), '(empty)') AS value, count(*) AS n FROM email_messages GROUP BY 1 ORDER BY n DESC, value LIMIT 15",
    "freshness_windows": f"""WITH {ctes('email_messages')} SELECT count(*) AS total, {', '.join(f"count(*) FILTER (sent_at >= TIMESTAMP '{NOW}' - INTERVAL {d} DAY) AS {n}" for d, n in ((1, 'last_24h'), (7, 'last_7d'), (30, 'last_30d')))},
  count(*) FILTER (sent_at IS NULL) AS never, {_ts('max(sent_at)')} AS newest FROM email_messages""",
    "top_n_groups": f"WITH {ctes('leads')} SELECT trim(city) AS value, count(*) AS n FROM leads WHERE trim(coalesce(city, '')) <> '' GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "feed_reconciliation": f"""WITH {ctes('company_checks')}, d AS (SELECT count(*) AS r FROM events WHERE event_id % 23 <> 0),
k AS (SELECT CASE check_key WHEN 'website' THEN 'websites' WHEN 'email' THEN 'emails' ELSE check_key END AS feed, count(DISTINCT orgnr) AS companies, max(checked_at) AS m FROM company_checks WHERE checked_at IS NOT NULL GROUP BY 1)
SELECT feed, CASE WHEN feed = 'websites' THEN 3::BIGINT ELSE 0::BIGINT END AS files, CASE WHEN feed = 'websites' THEN (SELECT r FROM d) ELSE 0::BIGINT END AS rows, companies, {_ts('m')} AS newest_check FROM k""",
    "delivery_class": f"""WITH {ctes('email_messages', 'outcome_events')}, {_FLAGS}, c AS (SELECT CASE WHEN coalesce(f, false) OR status IN ('failed','error') OR trim(coalesce(error, '')) <> '' THEN 'FAILED' WHEN coalesce(d, false) THEN 'DELIVERED'
  WHEN coalesce(a, false) OR status IN ('sent','accepted') THEN 'ACCEPTED' WHEN status IN ('queued','scheduled') AND f IS NULL THEN 'QUEUED' ELSE 'UNKNOWN' END AS k FROM email_messages m LEFT JOIN em ON em.id = m.id)
SELECT x.k AS delivery_class, count(c.k) AS n, round(count(c.k) * 100.0::DOUBLE / (SELECT count(*) FROM c), 1) AS pct FROM (SELECT unnest(['FAILED','DELIVERED','ACCEPTED','QUEUED','UNKNOWN']) AS k) x LEFT JOIN c ON c.k = x.k GROUP BY 1""",
    "stale_accepted": f"""WITH {ctes('email_messages', 'outcome_events')}, {_FLAGS}, w AS (SELECT coalesce(sent_at, created_at) AS age FROM email_messages m JOIN em ON em.id = m.id WHERE a AND NOT d AND NOT f)
SELECT h::INTEGER AS older_than_hours, (SELECT count(*) FROM w WHERE age < TIMESTAMP '2024-01-20 00:00:00' - h * INTERVAL 1 HOUR) AS n FROM (SELECT unnest([6, 24]) AS h)""",
    "reputation_verdict": f"""WITH {ctes('email_messages', 'outcome_events')}, n AS (SELECT TIMESTAMP '{NOW}' AS now),
s AS (SELECT count(*) FILTER (created_at >= now - INTERVAL 7 DAY) AS s7, count(*) FILTER (created_at >= now - INTERVAL 30 DAY) AS s30 FROM email_messages, n WHERE status IN ('sent','accepted','queued','scheduled','failed','error')),
b AS (SELECT count(*) FILTER (type IN ('bounced','bounce') AND created_at >= now - INTERVAL 7 DAY) AS b7, count(*) FILTER (type = 'complaint' AND created_at >= now - INTERVAL 30 DAY) AS c30 FROM outcome_events, n),
r AS (SELECT s7, s30, b7, c30, CASE WHEN s7 > 0 THEN b7 / s7 ELSE 0.0::DOUBLE END AS br, CASE WHEN s30 > 0 THEN c30 / s30 ELSE 0.0::DOUBLE END AS cr FROM s, b)
SELECT s7 AS sent_7d, s30 AS sent_30d, b7 AS bounces_7d, c30 AS complaints_30d, true AS spf, false AS dmarc, false AS listed, round(br, 6) AS bounce_rate_7d, round(cr, 6) AS complaint_rate_30d,
  CASE WHEN (s7 >= 20 AND br >= 0.10) OR (s30 >= 100 AND cr >= 0.01) THEN 'DEAD' ELSE 'WARNING' END AS verdict FROM r""",
    "sequence_queue_report": f"WITH {ctes('lead_campaigns')}, c AS ({CAMPAIGNS}) SELECT name AS campaign, count(*) AS n FROM lead_campaigns JOIN c ON c.id = campaign_id GROUP BY 1",
    "latest_links": f"WITH {ctes('lead_campaigns')}, c AS ({CAMPAIGNS}) SELECT l.id, lead_id, name AS campaign, current_step, current_variant, {_ts('next_send_at')} AS next_send_at, stopped_reason FROM lead_campaigns l JOIN c ON c.id = campaign_id ORDER BY l.id DESC LIMIT 10",
    "tier_summary": f"WITH {ctes('lead_campaigns')} SELECT t::INTEGER AS tier, count(l.id) AS n FROM (SELECT unnest(range(1, 6)) AS t) x LEFT JOIN lead_campaigns l ON l.tier = t GROUP BY 1",
}
for _name in ("target_filter", "lead_campaign_load", "lead_campaign_summary"):
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(_PICKED, f"picked AS (SELECT * FROM targets WHERE {_PICK})")
ORACLES["sequence_coverage"] = (
    f"WITH cat AS ({ORACLES['sequence_catalog']}) SELECT campaign, string_agg(DISTINCT step::VARCHAR, ',' ORDER BY step::VARCHAR) AS steps, count(*) AS templates FROM cat GROUP BY 1"
)
ORACLES["outcome_fold_in_parts"] = ORACLES["outcome_fold"]
ORACLES["top_values"] = f"""WITH t AS ({TOP_PARTS}), c AS (
SELECT 'line' AS "column", CASE WHEN trim(line) = '' THEN '(empty)' ELSE trim(line) END AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'part', part::VARCHAR, count(*) FROM t GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c) SELECT "column", value, n FROM r WHERE rn <= CASE WHEN "column" = 'line' THEN 3 ELSE 12 END"""
