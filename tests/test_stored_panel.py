"""Steps that several queries share are done once, on no more rows than are needed."""

import datetime as dt
import random

from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import factors
from crosspanel.operators import forecast as fc
from crosspanel.plans import forecast as plans
from crosspanel.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def reads_lineitem(df):
    return any("lineitem" in f for f in df.inputFiles())


def test_stored_bars_are_what_later_steps_read(spark):
    t = Tables(spark, FOLDER)
    before = {tuple(r) for r in t.grid.select("symbol", "t", "px").collect()}
    t.store_bars()
    assert not any(reads_lineitem(df) for df in (t.bars, t.calendar, t.grid))
    assert {tuple(r) for r in t.grid.select("symbol", "t", "px").collect()} == before


def test_only_bars_of_picked_names_are_looked_through(spark):
    t = Tables(spark, FOLDER)
    baskets, status = fc.evaluate_forecasts(plans.forecasts(t, ranked=False), t.bars, t.calendar, 1)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (symbol" in plan(baskets)
    assert "LeftSemi, (symbol" not in plan(status)


def test_ledger_builds_the_grid_of_picked_names_only(spark, monkeypatch):
    t = Tables(spark, FOLDER)
    seen = []
    evaluate = fc.evaluate_picks

    def spy(picks, grid, cal):
        seen.append((picks, grid))
        return evaluate(picks, grid, cal)

    monkeypatch.setattr(fc, "evaluate_picks", spy)
    plans.picks(t)
    named = t.staged("picks", None).orderBy("symbol").limit(3).localCheckpoint()
    t._staged["picks"] = named
    plans.ledger(t)
    picks, grid = seen[0]
    assert {r[0] for r in grid.select("symbol").distinct().collect()} == {r[0] for r in picks.select("symbol").distinct().collect()}


def test_last_of_weeks_equals_weekly_last_of_each_day(spark):
    rng, first = random.Random(3), dt.date(2020, 1, 1)
    days = [first + dt.timedelta(d) for d in range(90) if rng.random() < 0.6]
    bars = spark.createDataFrame(
        [(d, s, rng.choice([0.0, 1.0, 2.0, 3.0]), 1.0) for s in range(8) for d in days if rng.random() < 0.5],
        "date date, symbol long, close double, volume double")
    cal = ts.calendar(spark.createDataFrame([(d,) for d in days], "date date"))
    daily = factors.r1w(ts.dense_grid(bars, cal))
    want = set()
    for day in ("MON", "WED", "FRI"):
        rows = ts.weekly_last(daily, ["R1W"], day).filter(F.col("R1W").isNotNull())
        want |= {tuple(r) for r in rows.select("date", "symbol", "R1W").collect()}
    got = [tuple(r) for r in ts.last_of_weeks(daily, "R1W", cal, ["MON", "WED", "FRI"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
