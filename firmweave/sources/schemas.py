"""Declared schemas of the inputs."""

from __future__ import annotations

# Observation feeds: one JSON object per line.
_HEAD = "orgnr string, name string"
_SITE = _HEAD + ", website string, checked_at string, err_reason string"

FEEDS = {
    "website": _HEAD + ", found_website string, status string, err_reason string, checked_at string, "
    "db_website_before string, db_checked_at_before string",
    "email": _HEAD + ", website string, status string, err_reason string, emails string, checked_at string, "
    "db_emails_before string, db_emails_checked_at_before string, fetches_used int",
    "tech": _SITE + ", microsoft_status string, microsoft_strength string, microsoft_confidence string, "
    "it_support_signal string, it_support_confidence string",
    "site_review": _SITE + ", site_score int, site_flags array<string>",
    "hiring": _SITE + ", hiring_status string, hiring_what_text string, hiring_count int, evidence_url string, "
    "external_job_urls array<string>",
    "line_of_work": _SITE + ", sni_text string, w_label string, w_raw string, w_conf double, w_bucket string, "
    "final_label string, final_conf double, final_bucket string, source string, urls_used array<string>",
    "segments": _HEAD + ", line_of_work string, sni_text string, status string, err_reason string, "
    "segment_groups_before string, segment_groups_after string, checked_at string, "
    "segment_groups_checked_at_before string, shard_id int, shard_total int",
}

# Feeds whose rows are skipped when they carry no time.
NEEDS_TIME = {"tech", "site_review", "hiring", "line_of_work", "segments"}

COMPANY_FINANCIALS = (
    "orgnr string, fiscal_year_end_date date, fiscal_year_end_year int, revenue_sek bigint, profit_sek bigint, "
    "result_after_fin_sek bigint, assets_total_sek bigint, equity_total_sek bigint, solidity_pct double, "
    "cash_sek bigint, liabilities_short_sek bigint, liabilities_long_sek bigint, source_file string, "
    "updated_at timestamp"
)

REGISTER_BULK = (
    "organisationsidentitet string, organisationsnamn string, registreringsdatum string, organisationsform string, "
    "avregistreringsdatum string, postadress string"
)
