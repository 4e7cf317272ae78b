"""Factors from blocks of symbols equal those of the windows on the daily grid, without its joins."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import blocks, factors, features, fundamentals
from crosspanel.plans import profiling
from crosspanel.sources.tables import Tables

DAYS = [d.date() for d in pd.bdate_range("2019-01-01", periods=620)]


def panel(spark, names=9):
    rng = np.random.default_rng(4)
    rows = []
    for s in range(names):
        px = 50.0 + s
        for i, day in enumerate(DAYS):
            # Symbols 0 to 2 trade every day, 3 rarely, 4 at one price, 5 begins late.
            if s > 2 and rng.uniform() > (0.05 if s == 3 else 0.5) or s == 5 and i < 300:
                continue
            px *= 1.0 if s == 4 else float(np.exp(rng.normal() * 0.02))
            rows.append((day, s, None if s == 6 and i % 50 == 7 else round(px, 2), 10.0))
    bars = spark.createDataFrame(rows, "date date, symbol long, close double, volume double")
    reports = pd.DataFrame([
        (s, DAYS[0] + dt.timedelta(90 * q - 400 + s + (q == 3)), *(None if rng.uniform() < 0.1 else float(v) for v in rng.normal(5, 4, 23).round(2)))
        for s in range(names - 1) for q in range(11)])
    reports.columns = ["symbol", "date", *sorted({*fundamentals.TRAILING, *fundamentals.STOCK_ITEMS, "short_term_debt"})]
    types = "symbol long, date date, " + ", ".join(f"{c} double" for c in reports.columns[2:])
    reports = spark.createDataFrame(reports.astype(object).where(reports.notna(), None).values.tolist(), types)
    kinds = ["Upgrade", "downgrade", "kept"]
    actions = spark.createDataFrame(
        [(int(rng.integers(names)), DAYS[int(rng.integers(620))] + dt.timedelta(int(rng.integers(2))), kinds[int(rng.integers(3))]) for _ in range(900)],
        "symbol long, date date, action string")
    return bars, reports, actions


def by_windows(bars, cal, market, macro, reports, actions):
    grid = ts.dense_grid(bars, cal)
    narrow = grid.select("symbol", "t", "date", "px", "close")
    parts = [
        (factors.PRICE_FACTORS[:8], factors.rsi(factors.momentum(factors.r1w(narrow)))),
        ([*factors.PRICE_FACTORS[8:], *factors.MARKET_FACTORS], factors.risk_factors(narrow.drop("close"), market)),
        (["BETA_LOW"], factors.series_sensitivity(narrow.drop("close"), macro, ["LOW"])),
        (fundamentals.FACTORS, fundamentals.daily_fundamentals(narrow.drop("px"), reports, cal)),
        ([blocks.RATINGS], factors.rating_balance(actions, cal)),
    ]
    return [(c, ts.weekly_last(df, c).toPandas()) for c, df in parts]


def test_blocks_equal_windows(spark, monkeypatch):
    bars, reports, actions = panel(spark)
    cal = ts.calendar(bars)
    price = lambda c, n: cal.select("date", (F.sin(F.col("t") / n) * 3 + F.col("t") % 7 + 20).alias(c))
    market = factors.market_series(cal, price("mkt_close", 9))
    macro = factors.series_on_calendar(cal, price("LOW", 5), ["LOW"])
    moments = factors.series_moments(macro, "LOW", (factors.HALF_YEAR,))
    cols = [*factors.PRICE_FACTORS, *factors.MARKET_FACTORS, "BETA_LOW", *fundamentals.FACTORS, blocks.RATINGS]
    monkeypatch.setattr(blocks, "CELLS", 2 * len(DAYS))  # blocks of two symbols
    one = blocks.weekly(bars, cal, cols, [market, moments], reports, actions, symbols=9)
    got = one.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for names, want in by_windows(bars, cal, market, macro, reports, actions):
        both = got[["symbol", "date", *names]].merge(want, on=["symbol", "date"], how="left", suffixes=("", "_w"))
        if names == [blocks.RATINGS]:
            both = both.fillna({f"{blocks.RATINGS}_w": 0.0})
        else:
            assert len(got) == len(want)
        for c in names:
            a, b = both[c].to_numpy(float), both[f"{c}_w"].to_numpy(float)
            assert (np.isnan(a) == np.isnan(b)).all(), c
            assert np.allclose(a, b, rtol=1e-7, atol=1e-9, equal_nan=True), c
    assert got[cols].notna().any().sum() > 45
    weeks = spark.createDataFrame([(got.date[40],), (dt.date(1990, 1, 4),)], "date date")
    some = blocks.weekly(bars, cal, ["R1W"], [], weeks=weeks).toPandas()
    assert set(some.date) == {got.date[40]} and len(some) == (got.date == got.date[40]).sum()


def test_the_matrix_joins_no_wide_tables(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    df = features.feature_matrix(t, ratings=t.ratings)[0]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and plan.count("Generate explode(sequence(t") == 0


def test_four_factors_and_matrix_build_no_daily_grid(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert profiling.four(t).count() > 0 and "grid" not in t.__dict__
    weeks = t.calendar.select(ts.week_of("date").alias("date")).limit(1)
    assert profiling.matrix(t, weeks).count() > 0 and "grid" not in t.__dict__
