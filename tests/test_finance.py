import math
import random

import pytest
from pyspark.sql import functions as F

from firmweave.operators import finance as fin
from firmweave.operators import ranking

COLS = (
    "orgnr string, fiscal_year_end_date date, fiscal_year_end_year int, revenue_sek bigint, profit_sek bigint, result_after_fin_sek bigint, "
    "assets_total_sek bigint, equity_total_sek bigint, solidity_pct double, cash_sek bigint, liabilities_short_sek bigint, liabilities_long_sek bigint"
)


def table(spark, items):
    df = spark.createDataFrame([(o, f"{y}-12-31", y, *rest) for o, y, *rest in items], COLS.replace("date date", "date string"))
    return df.withColumn("fiscal_year_end_date", F.col("fiscal_year_end_date").cast("date"))


def random_accounts(n, seed=1):
    rng = random.Random(seed)
    pick = lambda a, b: rng.choice([None, 0, rng.randrange(a, b), rng.randrange(a, b)])
    out = []
    for i in range(n):
        for year in (2020, 2021, 2022):
            # One company in three is a copy: the same figures, so the same value for a third of the rows.
            vals = (100, 10, 12, 500, 200, 40.0, 50, 25, 5) if i % 3 == 0 else (
                pick(-9, 999), pick(-99, 99), pick(-99, 99), pick(0, 999), pick(-99, 999), rng.choice([None, rng.random() * 100]), pick(0, 99), pick(-5, 99), 1
            )
            out.append((str(i), year, *vals))
    return out


def quantile(xs, p):
    place = (len(xs) - 1) * p
    lo, hi = math.floor(place), math.ceil(place)
    return xs[lo] if lo == hi else xs[lo] * (1 - (place - lo)) + xs[hi] * (place - lo)


def brute_scores(values, up):
    """Sorted-list statement of winsorised percent-below scores. values: {key: number or None}"""
    there = {k: v for k, v in values.items() if v is not None}
    xs = sorted(there.values())
    lo, hi = quantile(xs, 0.01), quantile(xs, 0.99)
    clipped = {k: min(max(v, lo), hi) for k, v in there.items()}
    share = {k: sum(w < v for w in clipped.values()) / len(clipped) * 100.0 for k, v in clipped.items()}
    return {k: s if up else 100.0 - s for k, s in share.items()}


def test_ratio_edges(spark):
    df = fin.financial_ratios(table(spark, [
        ("1", 2020, 0, 5, 3, 0, 1, None, 5, 0, 0), ("2", 2020, 100, -10, 0, 50, 60, 12.5, 5, 10, 0), ("3", 2020, None, None, None, 50, None, None, None, -1, 0),
        ("4", 2020, 10, 0, -20, 1, 1, 0.0, None, 4, 0),
    ])).orderBy("orgnr")
    got = [tuple(r) for r in df.select(*fin.MEASURES).collect()]
    assert got[0] == (None, pytest.approx(math.log1p(5)), None, None, None, pytest.approx(2 / 3))
    assert got[1] == (-0.1, pytest.approx(-math.log1p(10)), 12.5, -0.2, 0.5, 10.0)
    assert got[2] == (None,) * 6
    assert got[3] == (0.0, 0.0, 0.0, 0.0, None, 1.0)


@pytest.mark.parametrize("target", [10**6, 5])
def test_scores_equal_the_sorted_list_definition(spark, target):
    items = random_accounts(400)
    df = fin.financial_ratios(table(spark, items))
    raw = [r.asDict() for r in df.collect()]
    got = {
        (r.orgnr, r.fiscal_year_end_year, r.measure): r.score
        for r in fin.winsorized_rank_scores(df, fin.MEASURES, 0.01, target_rows=target).collect()
    }
    n = 0
    for m, up in fin.MEASURES.items():
        for year in (2020, 2021, 2022):
            want = brute_scores({r["orgnr"]: r[m] for r in raw if r["fiscal_year_end_year"] == year}, up)
            for k, s in want.items():
                assert got[k, year, m] == pytest.approx(s, abs=1e-9), (k, year, m)
            n += len(want)
    assert n == len(got)
    assert all(0 <= s <= 100 for s in got.values())


def test_limits_of_the_score(spark):
    df = table(spark, [(str(i), 2020, 100, i, None, None, None, None, None, None, 1) for i in range(10)])
    df = fin.financial_ratios(df)
    up = {r.orgnr: r.score for r in fin.rank_score_by_year(df, {"profit_margin": True}).collect()}
    down = {r.orgnr: r.score for r in fin.rank_score_by_year(df, {"profit_margin": False}).collect()}
    assert up["9"] == 90.0 and up["0"] == 0.0 and down["0"] == 100.0 and down["9"] == 10.0
    # Ranks do not change under a monotone transform.
    cubed = df.withColumn("profit_margin", F.pow("profit_margin", 3))
    assert up == {r.orgnr: r.score for r in fin.rank_score_by_year(cubed, {"profit_margin": True}).collect()}


@pytest.mark.parametrize("target", [10**6, 5])
def test_one_row_year_and_non_finite(spark, target):
    df = spark.createDataFrame([("1", 2020, 5.0), ("2", 2021, 1.0), ("3", 2021, float("inf")), ("4", 2021, float("nan")), ("5", 2021, None)], "orgnr string, fiscal_year_end_year int, m double")
    out = fin.rank_score_by_year(df, {"m": True}, keys=("orgnr", "fiscal_year_end_year"), target_rows=target)
    assert sorted((r.orgnr, r.score) for r in out.collect()) == [("1", 0.0), ("2", 0.0)]
    w = fin.winsorize_by_year(df, ["m"], target_rows=target)
    assert {r.orgnr: r.m for r in w.where("orgnr < '3'").collect()} == {"1": 5.0, "2": 1.0} and w.count() == 5


def test_split_quantiles_with_a_hot_value(spark):
    rng = random.Random(5)
    xs = [7.0] * 2000 + [rng.random() * 20 for _ in range(4000)]
    df = spark.createDataFrame([(1, "m", x) for x in xs], "y int, measure string, value double")
    grid = ranking.value_grid(df, ["y", "measure"], target_rows=20)
    assert grid.buckets == 300
    for p in (0.01, 0.25, 0.4999):
        r = ranking.quantile_pairs(df, grid, ["y", "measure"], p).first()
        whole = ranking.quantile_pairs(df, ranking.value_grid(df, ["y", "measure"]), ["y", "measure"], p).first()
        assert (r.lo, r.hi) == (whole.lo, whole.hi)  # the same bits
        assert (r.lo, r.hi) == (pytest.approx(quantile(sorted(xs), p), abs=1e-12), pytest.approx(quantile(sorted(xs), 1 - p), abs=1e-12))


def test_ordered_position(spark):
    keys = [f"{(i * 7919) % 100003:06d}" for i in range(5000)]
    for some, target in ((keys, 10**6), (keys, 50), (keys[:3], 50), ([], 50)):
        df = spark.createDataFrame([(k,) for k in some], "orgnr string")
        got = {r.orgnr: r.position for r in ranking.ordered_position(df, "orgnr", target_rows=target).collect()}
        assert got == {k: i for i, k in enumerate(sorted(some))}


def test_growth_uses_the_calendar_year_before(spark):
    df = table(spark, [("1", 2020, 10, 1, *[None] * 7), ("1", 2022, 20, 2, *[None] * 7), ("1", 2021, 15, -3, *[None] * 7), ("2", 2020, 1, 1, *[None] * 7), ("2", 2022, 1, 1, *[None] * 7)])
    early = df.where("orgnr = '1' AND fiscal_year_end_year = 2020").withColumn("fiscal_year_end_date", F.lit("2020-06-30").cast("date")).withColumn("revenue_sek", F.lit(999).cast("bigint"))
    got = {(r.orgnr, str(r.fiscal_year_end_date)): r.growth for r in fin.growth_prev_year(df.unionByName(early)).collect()}
    want = 0.5 * (math.log1p(15) - math.log1p(10)) + 0.5 * (-math.log1p(3) - math.log1p(1))
    assert got["1", "2021-12-31"] == pytest.approx(want)
    assert got["2", "2022-12-31"] is None and got["1", "2020-12-31"] is None and got["1", "2022-12-31"] is not None


@pytest.mark.parametrize("target", [10**6, 5])
def test_health_score_combines_what_is_there(spark, target):
    items = random_accounts(60, seed=9) + [("empty", 2021, *[None] * 9)]
    df = table(spark, items)
    out = fin.health_score(df, spec=fin.ScoreSpec(), now="2024-01-01", target_rows=target)
    assert out.count() == len(items)
    got = {(r.orgnr, r.fiscal_year_end_year): r for r in out.collect()}
    e = got["empty", 2021]
    assert (e.score_current, e.score_growth, e.score_total) == (0.0, None, 0.0)
    base = fin.growth_prev_year(fin.financial_ratios(df)).collect()
    year = {r.orgnr: r.asDict() for r in base if r.fiscal_year_end_year == 2021}
    scores = {m: brute_scores({k: r[m] for k, r in year.items()}, up) for m, up in {**fin.MEASURES, "growth": True}.items()}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for k in year:
        pillars = [mean([scores[m][k] for m in parts if k in scores[m]]) for parts in fin.PILLARS.values()]
        current = mean([p for p in pillars if p is not None]) or 0.0
        g = scores["growth"].get(k)
        total = current if g is None else 0.7 * current + 0.3 * g
        assert got[k, 2021].score_current == pytest.approx(current, abs=1e-9)
        assert got[k, 2021].score_total == pytest.approx(total, abs=1e-9)


def test_unknown_companies_are_not_in_the_population(spark):
    df = table(spark, [(str(i), 2020, 100, i, *[None] * 7) for i in range(4)])
    known = spark.createDataFrame([("0",), ("3",)], "orgnr string")
    got = {r.orgnr: r.score_current for r in fin.health_score(df, known).collect()}
    assert got == {"0": 0.0, "3": 50.0}


def test_stale_filter_keeps_equal_times_out(spark, rows):
    f = spark.createDataFrame([("1", "d", "2024-01-02"), ("2", "d", "2024-01-02"), ("3", "d", "2024-01-02"), ("4", "d", None)], "orgnr string, fiscal_year_end_date string, updated_at string")
    s = spark.createDataFrame([("1", "d", "2024-01-02"), ("2", "d", "2024-01-01"), ("4", "d", "2024-01-01")], "orgnr string, fiscal_year_end_date string, updated_at string")
    assert rows(fin.stale_score_filter(f, s), "orgnr") == [("2",), ("3",), ("4",)]


def test_size_class_trend(spark):
    today = [("1", "10-19 anställda"), ("2", "5–9"), ("3", "500+"), ("4", " "), ("5", "20"), ("6", "okänd"), ("7", "1-4"), (" ", "1-4")]
    c = spark.createDataFrame([(k, v, None) for k, v in today], "orgnr string, employees_class string, run_status string")
    h = spark.createDataFrame(
        [(1, "1", "2024-01-01", "1-4"), (2, "1", "2024-02-01", "5-9"), (3, "2", "2024-01-01", "10-19"), (4, "3", "2024-01-01", "500+"), (5, "7", "2024-01-01", "unknown"), (6, "7", "2024-01-01", "5-9")],
        "id int, orgnr string, observed_at string, employees_class string",
    )
    appended, trends = fin.size_class_trend(c, h, "2024-06-01")
    got = {r.orgnr: r.employees_trend for r in trends.collect()}
    # All companies, not only the first; equal times are settled by id.
    assert got == {"1": "up", "2": "down", "3": "same", "4": "unknown", "5": "same", "6": "unknown", "7": "down"}
    assert {r.orgnr: r.status for r in appended.collect()}["4"] == "unknown" and appended.count() == 7


def test_latest_snapshot(spark):
    df = table(spark, [("1", 2020, 100, *[None] * 8), ("1", 2021, 150, *[None] * 8), ("2", 2021, 5, *[None] * 8)])
    s = spark.createDataFrame([("1", "2021-12-31", 70.0)], "orgnr string, fiscal_year_end_date string, score_total double").withColumn("fiscal_year_end_date", F.col("fiscal_year_end_date").cast("date"))
    got = {r.orgnr: tuple(r)[2:] for r in fin.latest_financial_snapshot(df, s).collect()}
    assert got == {"1": (150, 70.0, 50.0, "up"), "2": (5, None, None, "unknown")}


def test_a_year_of_many_rows_is_cut_by_default(spark, rows, monkeypatch):
    """By default too, no task holds the values of a whole year that is large; results are those of the whole year."""
    df = spark.range(300).selectExpr("'m' AS measure", "cast(2000 + id % 2 AS int) AS y", "cast(id * 37 % 61 AS double) AS value", "id")
    group = ["y", "measure"]
    assert ranking.value_grid(df, group).table is None
    whole = ranking.value_grid(df, group)
    monkeypatch.setattr(ranking, "WHOLE_ROWS", 100)
    cut = ranking.value_grid(df, group)
    assert cut.table is not None
    take = lambda grid: rows(ranking.rank_below(df, grid, group, ["id"]), "id", "below_rows", "n")
    assert take(cut) == take(whole)
    assert rows(ranking.quantile_pairs(df, cut, group, 0.01), "y", "lo", "hi") == rows(ranking.quantile_pairs(df, whole, group, 0.01), "y", "lo", "hi")


def test_small_buckets_stay_few():
    """Beyond MOST_BUCKETS bounds, buckets get larger instead, up to a million rows."""
    assert ranking.buckets_for(6_000, 20) == 300 and ranking.buckets_for(500_000, 100) == 512
    assert ranking.buckets_for(1_000, 100) == 16 and ranking.buckets_for(3_000_000_000, 100) == 3_000
