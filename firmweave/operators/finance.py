"""Yearly accounts: ratios, winsorising, rank scores, growth, health score, trends."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmweave.functions.text import blank_to_null, full_strip
from firmweave.functions.times import at
from firmweave.operators import ranking
from firmweave.session import Small, staged

KEYS = ("orgnr", "fiscal_year_end_date", "fiscal_year_end_year")
YEAR = "fiscal_year_end_year"

# The measures of the score and whether more is better.
MEASURES = {
    "profit_margin": True,
    "profit_level": True,
    "equity_ratio": True,
    "debt_ratio": False,
    "cash_ratio": True,
    "stability_gap": False,
}
PILLARS = {
    "profitability": ("profit_margin", "profit_level"),
    "solvency": ("equity_ratio", "debt_ratio"),
    "liquidity": ("cash_ratio",),
    "stability": ("stability_gap",),
}


@dataclass(frozen=True)
class ScoreSpec:
    winsor_p: float = 0.01
    weight_current: float = 0.70
    weight_growth: float = 0.30
    model_version: str = "econ_v1"


def signed_log(c: Column) -> Column:
    x = c.cast("double")
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.log1p(F.abs(x)))


def financial_ratios(financials: DataFrame) -> DataFrame:
    """Six measures per company year; NULL where an input is missing or a divisor is unusable."""
    revenue, profit = F.col("revenue_sek"), F.col("profit_sek")
    assets, equity = F.col("assets_total_sek"), F.col("equity_total_sek")
    short_debt, after_fin = F.col("liabilities_short_sek"), F.col("result_after_fin_sek").cast("double")
    return financials.withColumns(
        {
            "profit_margin": F.when(revenue != 0, profit.cast("double") / revenue.cast("double")),
            "profit_level": F.when(profit.isNotNull(), signed_log(profit)),
            "equity_ratio": F.col("solidity_pct").cast("double"),
            "debt_ratio": F.when(assets != 0, (assets - equity).cast("double") / assets.cast("double")),
            "cash_ratio": F.when(
                short_debt > 0, F.col("cash_sek").cast("double") / short_debt.cast("double")
            ),
            "stability_gap": F.abs(after_fin - profit.cast("double")) / F.greatest(F.lit(1.0), F.abs(after_fin)),
        }
    )


def measure_rows(df: DataFrame, measures: list[str], keys=KEYS) -> DataFrame:
    """One narrow row per key and usable (non-NULL, finite) measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    usable = F.filter(
        pairs,
        lambda x: x["value"].isNotNull() & ~F.isnan(x["value"]) & (F.abs(x["value"]) < float("inf")),
    )
    return df.select(*keys, F.explode(usable).alias("m")).select(*keys, "m.measure", "m.value")


def clamped(value: Column, lo: Column, hi: Column) -> Column:
    return F.when(value < lo, lo).when(value > hi, hi).otherwise(value)


def winsorize_by_year(
    df: DataFrame, cols: list[str], p: float = 0.01, year: str = YEAR, target_rows: int = ranking.TARGET_ROWS
) -> DataFrame:
    """Clamp each column to its p and 1-p quantiles within the year (the row itself is not shuffled)."""
    group = [year, "measure"]
    df = staged(df)  # read by the count, the bounds, the limits and the result
    rows = measure_rows(df, cols, keys=[year])
    grid = ranking.value_grid(rows, group, target_rows=target_rows)
    limits = ranking.quantile_pairs(rows, grid, group, p)
    per_year = limits.groupBy(year).agg(
        *[
            F.max(F.when(F.col("measure") == c, F.col(side))).alias(f"{c}__{side}")
            for c in cols
            for side in ("lo", "hi")
        ]
    )
    joined = df.join(F.broadcast(per_year) if grid.few else per_year, year, "left")
    clamp = lambda c: F.when(F.col(f"{c}__lo").isNull(), F.col(c)).otherwise(
        clamped(F.col(c), F.col(f"{c}__lo"), F.col(f"{c}__hi"))
    )
    return joined.withColumns({c: clamp(c) for c in cols}).select(*df.columns)


def _scores(rows, grid: ranking.Grid, measures: dict[str, bool], year: str, keys) -> DataFrame:
    spread = [k for k in keys if k != year] or list(keys)
    ranked = ranking.rank_below(rows, grid, [year, "measure"], spread)
    share = F.col("below_rows") / F.col("n") * 100.0
    lower_better = [m for m, up in measures.items() if not up]
    score = F.when(F.col("measure").isin(lower_better), 100.0 - share).otherwise(share)
    return ranked.withColumn("score", score)


def rank_score_by_year(
    df: DataFrame, measures: dict[str, bool], keys=KEYS, year: str = YEAR, target_rows: int = ranking.TARGET_ROWS
) -> DataFrame:
    """Per key and measure: percent of the year's rows strictly below (100 minus that if lower is better)."""
    rows = staged(measure_rows(df, list(measures), keys))  # read by the count, the bounds and the ranks
    grid = ranking.value_grid(rows, [year, "measure"], target_rows=target_rows)
    return _scores(rows, grid, measures, year, keys).select(*keys, "measure", "value", "score")


def winsorized_rank_scores(
    df: DataFrame, measures: dict[str, bool], p: float, keys=KEYS, year: str = YEAR, target_rows: int = ranking.TARGET_ROWS
) -> DataFrame:
    """Winsorise, then rank. The limits join the split bounds, so the clamped tails are point buckets.

    ``df`` is read by every step: hand in a stored table.
    """
    group = [year, "measure"]
    rows = measure_rows(df, list(measures), keys)
    grid = ranking.value_grid(rows, group, target_rows=target_rows)
    limits = ranking.quantile_pairs(rows, grid, group, p)
    cut_rows = (
        rows.join(limits, group)
        .withColumn("value", clamped(F.col("value"), F.col("lo"), F.col("hi")))
        .drop("lo", "hi")
    )
    if grid.table is not None:
        bounds = F.array_sort(F.array_distinct(F.concat("bounds", F.array("lo", "hi"))))
        both = grid.table.df.join(limits, group).withColumn("bounds", bounds).select(*grid.table.df.columns)
        grid = grid._replace(table=Small(both, grid.table.local))
    return _scores(cut_rows, grid, measures, year, keys).select(*keys, "measure", "score")


def growth_prev_year(financials: DataFrame) -> DataFrame:
    """Half signed-log revenue change plus half signed-log profit change against the calendar year before.

    Of two year ends in one calendar year the later one is the base.
    """
    # Plain numbers in the buffers keep this a hash aggregate.
    previous = financials.groupBy("orgnr", (F.col(YEAR) + 1).alias(YEAR)).agg(
        F.max_by("revenue_sek", "fiscal_year_end_date").alias("prev_revenue"),
        F.max_by("profit_sek", "fiscal_year_end_date").alias("prev_profit"),
    )
    change = lambda now, then: signed_log(F.col(now)) - signed_log(F.col(then))
    growth = 0.5 * change("revenue_sek", "prev_revenue") + 0.5 * change("profit_sek", "prev_profit")
    return (
        financials.join(previous, ["orgnr", YEAR], "left")
        .withColumn("growth", growth)
        .select(*financials.columns, "growth")
    )


def mean_of_present(cols: list[Column]) -> Column:
    """Mean of the non-NULL values, NULL if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    count = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(count > 0, total / count)


def health_score(
    financials: DataFrame,
    companies: DataFrame | None = None,
    spec: ScoreSpec = ScoreSpec(),
    now=None,
    target_rows: int = ranking.TARGET_ROWS,
) -> DataFrame:
    """Score every company year from 0 to 100; years are scored together, companies unknown to the master not."""
    known = financials if companies is None else financials.join(companies.select("orgnr"), "orgnr", "left_semi")
    base = staged(growth_prev_year(financial_ratios(known)).select(*KEYS, *MEASURES, "growth"))
    measures = {**MEASURES, "growth": True}
    scored = winsorized_rank_scores(base, measures, spec.winsor_p, target_rows=target_rows)
    # One empty row per key keeps companies that lack every measure.
    every_key = base.select(*KEYS, F.lit("none").alias("measure"), F.lit(None).cast("double").alias("score"))
    wide = (
        scored.unionByName(every_key)
        .groupBy(*KEYS)
        .agg(*[F.max(F.when(F.col("measure") == m, F.col("score"))).alias(m) for m in measures])
    )
    pillars = [mean_of_present([F.col(m) for m in parts]) for parts in PILLARS.values()]
    current = F.coalesce(mean_of_present(pillars), F.lit(0.0))
    total = F.when(F.col("growth").isNull(), F.col("current")).otherwise(
        spec.weight_current * F.col("current") + spec.weight_growth * F.col("growth")
    )
    limit = lambda c: clamped(c, F.lit(0.0), F.lit(100.0))
    out = wide.withColumn("current", current).select(
        *KEYS,
        limit(F.col("current")).alias("score_current"),
        limit(F.col("growth")).alias("score_growth"),
        limit(total).alias("score_total"),
        F.lit(spec.model_version).alias("model_version"),
    )
    return out if now is None else out.withColumn("updated_at", at(now))


def stale_score_filter(financials: DataFrame, scores: DataFrame) -> DataFrame:
    """Company years whose facts are newer than their score, or that have none. Apply after ranking."""
    key = ["orgnr", "fiscal_year_end_date"]
    stamps = scores.groupBy(*key).agg(F.max("updated_at").alias("score_updated_at"))
    fresh = F.coalesce(F.col("updated_at") <= F.col("score_updated_at"), F.lit(False))
    return financials.join(stamps, key, "left").where(~fresh).drop("score_updated_at")


# Fixed value: the marker for an unknown size class.
UNKNOWN = "unknown"


def class_rank(c: Column) -> Column:
    """Order of a size class text: ``n+``, else ``a-b``, else any number in it."""
    s = F.lower(full_strip(c))
    plus = F.regexp_extract(s, r"([0-9]+)\s*\+", 1)
    span = F.regexp_extract(s, r"([0-9]+)\s*[-–]\s*[0-9]+", 1)
    first = F.regexp_extract(s, r"([0-9]+)", 1)
    number = F.coalesce(*[F.when(x != "", x) for x in (plus, span, first)])
    return F.when(s != UNKNOWN, number.try_cast("int"))


def size_class_trend(companies: DataFrame, history: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(history rows to append, trend per company) for today's classes against the latest earlier one.

    ``companies``: orgnr, employees_class, run_status; ``history``: id, orgnr, observed_at, employees_class.
    """
    latest = history.groupBy("orgnr").agg(
        F.max_by("employees_class", F.struct("observed_at", "id")).alias("prev_class"),
        F.lit(True).alias("seen"),
    )
    cls = F.coalesce(blank_to_null("employees_class"), F.lit(UNKNOWN))
    status = F.coalesce(
        blank_to_null("run_status"), F.when(F.col("cls") != UNKNOWN, F.lit("ok")).otherwise(F.lit(UNKNOWN))
    )
    old, new = class_rank(F.col("prev_class")), class_rank(F.col("cls"))
    trend = (
        F.when(new.isNull() | (F.col("seen").isNotNull() & old.isNull()), F.lit(UNKNOWN))
        .when(F.col("seen").isNull(), F.lit("same"))
        .when(new > old, F.lit("up"))
        .when(new < old, F.lit("down"))
        .otherwise(F.lit("same"))
    )
    today = (
        companies.select(full_strip("orgnr").alias("orgnr"), "employees_class", "run_status")
        .where(F.col("orgnr") != "")
        .withColumn("cls", cls)
    )
    appended = today.select(
        "orgnr",
        at(now).alias("observed_at"),
        F.col("cls").alias("employees_class"),
        status.alias("status"),
        F.lit("postprocess").alias("source"),
    )
    trends = today.join(latest, "orgnr", "left").select(
        "orgnr", F.col("cls").alias("employees_class"), trend.alias("employees_trend"), at(now).alias("employees_trend_at")
    )
    return appended, trends


def latest_financial_snapshot(financials: DataFrame, scores: DataFrame) -> DataFrame:
    """Per company: latest year end, its revenue and score, revenue change in percent and direction."""
    end = "fiscal_year_end_date"
    latest = financials.groupBy("orgnr").agg(
        F.max_by(YEAR, end).alias(YEAR), F.max_by("revenue_sek", end).alias("revenue_sek"), F.max(end).alias(end)
    )
    previous = financials.groupBy("orgnr", (F.col(YEAR) + 1).alias(YEAR)).agg(
        F.max_by("revenue_sek", "fiscal_year_end_date").alias("prev_revenue")
    )
    totals = scores.select("orgnr", "fiscal_year_end_date", F.col("score_total").alias("financial_score_total"))
    now, then = F.col("revenue_sek").cast("double"), F.col("prev_revenue").cast("double")
    change = F.when(then != 0, (now - then) / F.abs(then) * 100.0)
    direction = F.when(F.col("pct") > 0, "up").when(F.col("pct") < 0, "down").when(F.col("pct") == 0, "same")
    return (
        latest.join(previous, ["orgnr", YEAR], "left")
        .join(totals, ["orgnr", "fiscal_year_end_date"], "left")
        .withColumn("pct", change)
        .select(
            "orgnr",
            F.col("fiscal_year_end_date").alias("financial_latest_year_end"),
            F.col("revenue_sek").alias("financial_net_revenue_latest"),
            "financial_score_total",
            F.col("pct").alias("financial_revenue_trend_pct"),
            F.coalesce(direction, F.lit(UNKNOWN)).alias("financial_revenue_trend"),
        )
    )
