"""Registered queries over yearly accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmweave.operators import finance as fin
from firmweave.plans.adapters import NOW, adapter, ctes, sql

KEYS = ["orgnr", "fiscal_year_end_date", "fiscal_year_end_year"]
SIX = list(fin.MEASURES)

COMPANY_CLASSES = """
SELECT cast(5500000000 + c_custkey AS string) AS orgnr,
  CASE c_custkey % 9 WHEN 0 THEN '0 anställda' WHEN 1 THEN '1-4 anställda' WHEN 2 THEN '5–9 anställda'
    WHEN 3 THEN '10-19 anställda' WHEN 4 THEN '500+' WHEN 5 THEN NULL WHEN 6 THEN ' ' WHEN 7 THEN 'okänd' ELSE '20' END AS employees_class,
  CASE WHEN c_custkey % 4 = 0 THEN 'ok' WHEN c_custkey % 4 = 1 THEN '' END AS run_status
FROM customer
"""

CLASS_HISTORY = """
SELECT event_id AS id, cast(5500000000 + user_id AS string) AS orgnr, ts AS observed_at,
  CASE event_id % 6 WHEN 0 THEN '0 anställda' WHEN 1 THEN '1-4 anställda' WHEN 2 THEN '10-19 anställda'
    WHEN 3 THEN '500+' WHEN 4 THEN 'unknown' ELSE '20-49 anställda' END AS employees_class
FROM events
"""


def keyed(df):
    """Dates as text at the edge of a query."""
    return df.withColumn("fiscal_year_end_date", F.col("fiscal_year_end_date").cast("string"))


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def financial_ratios(spark, sf_dir):
    df = fin.financial_ratios(adapter(spark, sf_dir, "company_financials"))
    return rounded(keyed(df.select(*KEYS, *SIX)), SIX)


def winsorize_by_year(spark, sf_dir):
    df = fin.financial_ratios(adapter(spark, sf_dir, "company_financials")).select(*KEYS, *SIX)
    return rounded(keyed(fin.winsorize_by_year(df, SIX)), SIX)


def rank_score_by_year(spark, sf_dir):
    df = fin.financial_ratios(adapter(spark, sf_dir, "company_financials"))
    return rounded(keyed(fin.rank_score_by_year(df, fin.MEASURES).drop("value")), ["score"])


def growth_prev_year(spark, sf_dir):
    df = fin.growth_prev_year(adapter(spark, sf_dir, "company_financials"))
    return rounded(keyed(df.select(*KEYS, "growth")), ["growth"])


def health_score(spark, sf_dir):
    df = fin.health_score(adapter(spark, sf_dir, "company_financials"))
    return rounded(keyed(df), ["score_current", "score_growth", "score_total"])


def health_score_split(spark, sf_dir):
    """The same scores with years cut into many small buckets."""
    df = fin.health_score(adapter(spark, sf_dir, "company_financials"), target_rows=100)
    return rounded(keyed(df), ["score_current", "score_growth", "score_total"])


def _scores(spark, sf_dir):
    """A score table of mixed age: one company in three has a score as new as its facts."""
    df = adapter(spark, sf_dir, "company_financials")
    old = F.expr("CAST('1990-01-01' AS TIMESTAMP)")
    return df.where("fiscal_year_end_year % 2 = 0").select(
        "orgnr",
        "fiscal_year_end_date",
        F.when(F.substring("orgnr", -1, 1).isin("0", "3", "6", "9"), F.col("updated_at").cast("timestamp"))
        .otherwise(old)
        .alias("updated_at"),
    )


def stale_score_filter(spark, sf_dir):
    df = adapter(spark, sf_dir, "company_financials").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return keyed(fin.stale_score_filter(df, _scores(spark, sf_dir)).select(*KEYS))


def size_class_trend(spark, sf_dir):
    appended, trends = fin.size_class_trend(
        sql(spark, sf_dir, COMPANY_CLASSES), sql(spark, sf_dir, CLASS_HISTORY), NOW
    )
    return trends.select("orgnr", "employees_class", "employees_trend").join(
        appended.select("orgnr", "status"), "orgnr"
    )


def latest_financial_snapshot(spark, sf_dir):
    df = adapter(spark, sf_dir, "company_financials")
    out = fin.latest_financial_snapshot(df, fin.health_score(df)).withColumn(
        "financial_latest_year_end", F.col("financial_latest_year_end").cast("string")
    )
    return rounded(out, ["financial_score_total", "financial_revenue_trend_pct"])


QUERIES = {
    f.__name__: f
    for f in (
        financial_ratios,
        winsorize_by_year,
        rank_score_by_year,
        growth_prev_year,
        health_score,
        health_score_split,
        stale_score_filter,
        size_class_trend,
        latest_financial_snapshot,
    )
}

_FIN = ctes("company_financials")
_SLOG = "CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE sign({x}) * ln(1 + abs({x}::DOUBLE)) END"


def _slog(x: str) -> str:
    return _SLOG.format(x=x)


_RATIOS = f"""{_FIN},
r AS (SELECT *,
  CASE WHEN revenue_sek <> 0 THEN profit_sek::DOUBLE / revenue_sek::DOUBLE END AS profit_margin,
  {_slog('profit_sek')} AS profit_level,
  solidity_pct AS equity_ratio,
  CASE WHEN assets_total_sek <> 0 THEN (assets_total_sek - equity_total_sek)::DOUBLE / assets_total_sek::DOUBLE END AS debt_ratio,
  CASE WHEN liabilities_short_sek > 0 THEN cash_sek::DOUBLE / liabilities_short_sek::DOUBLE END AS cash_ratio,
  abs(result_after_fin_sek::DOUBLE - profit_sek::DOUBLE) / CASE WHEN result_after_fin_sek IS NULL THEN NULL ELSE greatest(1.0::DOUBLE, abs(result_after_fin_sek::DOUBLE)) END AS stability_gap
  FROM company_financials)"""
_GROWTH = f"""
prev AS (SELECT orgnr, fiscal_year_end_year + 1 AS y, arg_max(revenue_sek, fiscal_year_end_date) AS prev_rev, arg_max(profit_sek, fiscal_year_end_date) AS prev_prof
  FROM company_financials GROUP BY 1, 2),
g AS (SELECT r.*, 0.5 * ({_slog('r.revenue_sek')} - {_slog('prev_rev')}) + 0.5 * ({_slog('r.profit_sek')} - {_slog('prev_prof')}) AS growth
  FROM r LEFT JOIN prev ON r.orgnr = prev.orgnr AND r.fiscal_year_end_year = prev.y)"""
_KEYS = "orgnr, fiscal_year_end_date::VARCHAR AS fiscal_year_end_date, fiscal_year_end_year"


def _limits(cols, source):
    parts = ", ".join(
        f"quantile_cont({c}, 0.01) AS {c}__lo, quantile_cont({c}, 0.99) AS {c}__hi" for c in cols
    )
    return f"q AS (SELECT fiscal_year_end_year AS qy, {parts} FROM {source} GROUP BY 1)"


def _clamp(c):
    return f"CASE WHEN {c} < {c}__lo THEN {c}__lo WHEN {c} > {c}__hi THEN {c}__hi ELSE {c} END"


def _rank(c, up):
    share = (
        f"(rank() OVER (PARTITION BY fiscal_year_end_year ORDER BY {c} NULLS LAST) - 1)::DOUBLE"
        f" / count({c}) OVER (PARTITION BY fiscal_year_end_year) * 100.0"
    )
    return f"CASE WHEN {c} IS NOT NULL THEN {share if up else '100.0 - ' + share} END"


def _mean(cols):
    total = " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    count = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"CASE WHEN ({count}) > 0 THEN ({total}) / ({count}) END"


_SEVEN = {**fin.MEASURES, "growth": True}
_HEALTH = f"""{_RATIOS}, {_GROWTH}, {_limits(_SEVEN, 'g')},
w AS (SELECT orgnr, fiscal_year_end_date, fiscal_year_end_year, {', '.join(f'{_clamp(c)} AS {c}' for c in _SEVEN)}
  FROM g JOIN q ON fiscal_year_end_year = qy),
s AS (SELECT orgnr, fiscal_year_end_date, fiscal_year_end_year, {', '.join(f'{_rank(c, up)} AS {c}' for c, up in _SEVEN.items())} FROM w),
p AS (SELECT *, {', '.join(f'{_mean(parts)} AS p_{name}' for name, parts in fin.PILLARS.items())} FROM s),
c AS (SELECT *, coalesce({_mean([f'p_{n}' for n in fin.PILLARS])}, 0.0) AS cur FROM p),
health AS (SELECT orgnr, fiscal_year_end_date, fiscal_year_end_year, cur AS score_current, growth AS score_growth,
  CASE WHEN growth IS NULL THEN cur ELSE 0.7 * cur + 0.3 * growth END AS score_total FROM c)"""

ORACLES = {
    "financial_ratios": f"WITH {_RATIOS} SELECT {_KEYS}, {', '.join(f'round({c}, 6) AS {c}' for c in SIX)} FROM r",
    "winsorize_by_year": f"WITH {_RATIOS}, {_limits(SIX, 'r')} SELECT {_KEYS}, "
    f"{', '.join(f'round({_clamp(c)}, 6) AS {c}' for c in SIX)} FROM r JOIN q ON fiscal_year_end_year = qy",
    "rank_score_by_year": f"WITH {_RATIOS} "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT {_KEYS}, '{c}' AS measure, round({_rank(c, up)}, 6) AS score FROM r) WHERE score IS NOT NULL"
        for c, up in fin.MEASURES.items()
    ),
    "growth_prev_year": f"WITH {_RATIOS}, {_GROWTH} SELECT {_KEYS}, round(growth, 6) AS growth FROM g",
    "health_score": f"WITH {_HEALTH} SELECT {_KEYS}, round(score_current, 6) AS score_current, "
    "round(score_growth, 6) AS score_growth, round(score_total, 6) AS score_total, 'econ_v1' AS model_version FROM health",
    "stale_score_filter": f"WITH {_FIN} SELECT {_KEYS} FROM company_financials "
    "WHERE NOT (fiscal_year_end_year % 2 = 0 AND right(orgnr, 1) IN ('0','3','6','9'))",
    "size_class_trend": f"""WITH co AS ({COMPANY_CLASSES}), h AS ({CLASS_HISTORY}),
n AS (SELECT orgnr, coalesce(nullif(trim(employees_class), ''), 'unknown') AS cls, nullif(trim(run_status), '') AS run FROM co),
l AS (SELECT orgnr, arg_max(employees_class, (observed_at, id)) AS prev FROM h GROUP BY 1),
k AS (SELECT n.orgnr, cls, run, prev, l.orgnr IS NOT NULL AS seen,
  nullif(regexp_extract(cls, '[0-9]+'), '')::INT AS rn, nullif(regexp_extract(prev, '[0-9]+'), '')::INT AS ro
  FROM n LEFT JOIN l ON n.orgnr = l.orgnr)
SELECT orgnr, cls AS employees_class, coalesce(run, CASE WHEN cls <> 'unknown' THEN 'ok' ELSE 'unknown' END) AS status,
  CASE WHEN rn IS NULL OR (seen AND ro IS NULL) THEN 'unknown' WHEN NOT seen THEN 'same' WHEN rn > ro THEN 'up' WHEN rn < ro THEN 'down' ELSE 'same' END AS employees_trend
FROM k""",
    "latest_financial_snapshot": f"""WITH {_HEALTH},
l AS (SELECT orgnr, max(fiscal_year_end_date) AS d FROM company_financials GROUP BY 1),
x AS (SELECT f.orgnr, f.fiscal_year_end_date, f.fiscal_year_end_year, f.revenue_sek, prev_rev, health.score_total,
  CASE WHEN prev_rev <> 0 THEN (f.revenue_sek::DOUBLE - prev_rev::DOUBLE) / abs(prev_rev::DOUBLE) * 100.0 END AS pct
  FROM l JOIN company_financials f ON f.orgnr = l.orgnr AND f.fiscal_year_end_date = l.d
  LEFT JOIN prev ON prev.orgnr = f.orgnr AND prev.y = f.fiscal_year_end_year
  LEFT JOIN health ON health.orgnr = f.orgnr AND health.fiscal_year_end_date = f.fiscal_year_end_date)
SELECT orgnr, fiscal_year_end_date::VARCHAR AS financial_latest_year_end, revenue_sek AS financial_net_revenue_latest,
  round(score_total, 6) AS financial_score_total, round(pct, 6) AS financial_revenue_trend_pct,
  CASE WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' WHEN pct = 0 THEN 'same' ELSE 'unknown' END AS financial_revenue_trend FROM x""",
}

ORACLES["health_score_split"] = ORACLES["health_score"]
