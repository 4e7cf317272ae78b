"""Grid, windows, as-of joins and portfolio rules on small fixtures, against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import factors, joins, portfolio, sessions, target, universe
from crosspanel.sources import store


def long(spark, wide, value="close"):
    rows = [
        (d.date(), s, float(v))
        for s in wide for d, v in wide[s].items() if not np.isnan(v)
    ]
    return spark.createDataFrame(rows, f"date date, symbol string, {value} double")


@pytest.fixture(scope="module")
def closes():
    rng = np.random.default_rng(42)
    days = pd.bdate_range("2020-01-01", periods=420)
    wide = pd.DataFrame(
        100 * np.exp(np.cumsum(rng.normal(0, 0.01, (420, 4)), axis=0)), index=days, columns=list("ABCD")
    )
    wide[rng.random(wide.shape) < 0.1] = np.nan
    wide.loc[days[:30], "B"] = np.nan
    wide.loc[days[300:], "C"] = np.nan
    wide["M"] = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 420)))
    return wide


@pytest.fixture(scope="module")
def grid(spark, closes):
    bars = long(spark, closes.drop(columns="M")).withColumn("volume", F.lit(1.0))
    cal = ts.calendar(bars)
    return ts.dense_grid(bars, cal), cal


def wide_of(df, col):
    pdf = df.select("date", "symbol", col).toPandas()
    out = pdf.pivot(index="date", columns="symbol", values=col)
    out.index = pd.to_datetime(out.index)
    return out.astype(float)


def check(got, want):
    want = want.reindex(columns=got.columns)
    np.testing.assert_allclose(got.to_numpy(), want.reindex(got.index).to_numpy(), atol=1e-9, equal_nan=True)
    # Cells left out of the trimmed grid are null in the full panel too.
    assert want.notna().sum().sum() == got.notna().sum().sum()


def test_padded_return(grid, closes):
    stock = closes.drop(columns="M")
    check(wide_of(factors.r1w(grid[0]), "R1W"), stock.ffill().pct_change(5, fill_method=None))


def test_rsi(grid, closes):
    stock = closes.drop(columns="M")
    d = stock.diff()
    g, l = d.clip(lower=0), -d.clip(upper=0)
    ew = lambda x: x.ewm(alpha=1 / 14, min_periods=14).mean()
    want = 100 - 100 / (1 + ew(g) / ew(l).replace(0, np.nan))
    check(wide_of(factors.rsi(grid[0]), "RSI14"), want)


def test_risk_factors(spark, grid, closes):
    stock, mkt = closes.drop(columns="M"), closes["M"]
    market = long(spark, closes[["M"]]).select("date", F.col("close").alias("mkt_close"))
    out = factors.risk_factors(grid[0], factors.market_series(grid[1], market)).cache()
    r, m = stock.ffill().pct_change(fill_method=None), mkt.pct_change(fill_method=None)
    check(wide_of(out, "VOL6M"), r.rolling(126, min_periods=63).std() * 252**0.5)
    check(wide_of(out, "VOL12M"), r.rolling(252, min_periods=126).std() * 252**0.5)
    beta = (
        r.mul(m, axis=0).rolling(126).mean() - r.rolling(126).mean().mul(m.rolling(126).mean(), axis=0)
    ).div(m.rolling(126).var(), axis=0)
    check(wide_of(out, "BETA6M"), beta)
    res = r.sub(beta.mul(m, axis=0), fill_value=0)
    check(wide_of(out, "IVOL6M"), res.rolling(126, min_periods=63).std() * 252**0.5)


def test_factors_are_causal(spark, closes):
    """Values up to a day do not change when later days are removed."""
    def beta(wide):
        bars = long(spark, wide.drop(columns="M")).withColumn("volume", F.lit(1.0))
        cal = ts.calendar(bars)
        market = long(spark, wide[["M"]]).select("date", F.col("close").alias("mkt_close"))
        out = factors.risk_factors(ts.dense_grid(bars, cal), factors.market_series(cal, market), full=False)
        return wide_of(out, "BETA6M")

    cut = closes.iloc[:250]
    a, b = beta(closes), beta(cut)
    pd.testing.assert_frame_equal(a.loc[b.index, b.columns], b, check_names=False)


def test_weekly_last_and_forward_return(spark, grid, closes):
    stock = closes.drop(columns="M")
    bars = long(spark, stock)
    weekly = wide_of(ts.weekly_last(bars, ["close"], "WED"), "close")
    want = stock.resample("W-WED").last()
    np.testing.assert_allclose(weekly.to_numpy(), want.reindex(weekly.index)[weekly.columns].to_numpy(), equal_nan=True)
    got = target.trade_returns(bars, grid[1], "WED", lag=1, cap=None)
    ret = stock.shift(-1).resample("W-WED").last().ffill().pct_change(fill_method=None).shift(-1)
    check(wide_of(got, "ret"), ret)


def test_lag_guard():
    with pytest.raises(ValueError):
        target.check_lag(0)


def test_report_asof(spark, grid):
    day = dt.date
    reports = spark.createDataFrame(
        [("A", day(2015, 1, 1), 7.0), ("A", day(2020, 1, 1), 1.0), ("A", day(2020, 3, 1), 2.0)],
        "symbol string, date date, x double",
    )
    got = wide_of(joins.report_asof(reports, ["x"], grid[1], 90).join(grid[1], "t"), "x")["A"]
    assert got.iloc[0] == 7.0  # in force long before the first session
    assert got[pd.Timestamp("2020-03-30")] == 7.0 and got[pd.Timestamp("2020-03-31")] == 1.0
    assert got[pd.Timestamp("2020-06-01")] == 2.0  # effective on Saturday 30 May
    exact = wide_of(joins.report_asof(reports, ["x"], grid[1], 90, exact=True).join(grid[1], "t"), "x")["A"]
    assert exact.max() == 1.0  # the Saturday report is lost


def test_report_asof_is_not_broadcast(spark, grid):
    # The rows multiply after the last shuffle, so Spark takes them for few.
    reports = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0)], "symbol string, date date, x double")
    known = joins.report_asof(reports, ["x"], grid[1], 90)
    joined = grid[0].join(known, ["symbol", "t"], "left").groupBy().agg(F.count("x").alias("n"))
    assert joined.first().n > 0
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_ewm_keeps_a_value_of_long_ago(spark):
    # One loss, then gains only: the mean of losses decays but never is 0.
    pdf = pd.DataFrame({"symbol": "A", "t": range(2000), "x": [0.0] * 3 + [5.0] + [0.0] * 1996})
    got = ts.ewm_means(spark.createDataFrame(pdf), ["x"], [5]).toPandas().sort_values("t")
    want = pdf.x.ewm(alpha=1 / 5, min_periods=5).mean().to_numpy()
    assert (got.x_ew5.to_numpy(float)[4:] > 0).all()
    np.testing.assert_allclose(got.x_ew5.to_numpy(float)[4:], want[4:], rtol=1e-6)


def test_grid_partitions_follow_the_symbols(spark):
    bars = spark.createDataFrame([(dt.date(2020, 1, 2), 1, 1.0, 1.0)], "date date, symbol long, close double, volume double")
    cal = ts.calendar(bars)
    at = lambda n: ts.dense_grid(bars, cal, n).rdd.getNumPartitions()
    assert at(0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert at(60_000) == 60_000 // ts.SYMBOLS_A_TASK


def test_sessions_on_a_holiday(spark):
    days = [dt.date(2025, 11, d) for d in range(24, 29)]
    rows = [(d, s, 1.0) for d in days for s in ("US1", "US2", "US3", "UK1", "UK2", "UK3")
            if not (d.day == 27 and s.startswith("US"))]
    bars = spark.createDataFrame(rows, "date date, symbol string, close double").withColumn(
        "region", F.substring("symbol", 1, 2)
    )
    open_days = sessions.sessions(bars, bars.select("date").distinct(), "region")
    nominal = spark.createDataFrame(
        [("US", dt.date(2025, 11, 27)), ("UK", dt.date(2025, 11, 27)), ("US", dt.date(2025, 12, 4))],
        "region string, nominal date",
    )
    got = {(r.region, r.nominal.day): r.trade_date for r in sessions.region_trade_dates(nominal, open_days).collect()}
    assert got == {("US", 27): dt.date(2025, 11, 26), ("UK", 27): dt.date(2025, 11, 27), ("US", 4): dt.date(2025, 12, 4)}


def test_quintiles_and_weights(spark):
    rows = [(dt.date(2020, 1, 2), i, float(i)) for i in range(13)]
    scores = spark.createDataFrame(rows, "date date, symbol int, prediction double")
    got = portfolio.assign_quantiles(scores, max_group=13).toPandas().sort_values("symbol").quintile.tolist()
    assert got == list(np.ceil(5 * np.arange(1, 14) / 13).astype(int))
    members = spark.createDataFrame([(dt.date(2020, 1, 2), s, "LONG") for s in "ABCD"], "date date, symbol string, side string")
    adv = spark.createDataFrame(
        [(dt.date(2020, 1, 2), s, v) for s, v in zip("ABCD", (100e6, 50e6, 5e6, 2e6))], "date date, symbol string, adv double"
    )
    w = {r.symbol: r.weight for r in portfolio.basket_weights(portfolio.with_scale(members, adv, 20e6)).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["C"] / w["A"] == pytest.approx(0.25)
    none = portfolio.basket_weights(portfolio.with_scale(members, adv.withColumn("adv", F.lit(0.0)), 20e6))
    assert {r.weight for r in none.collect()} == {0.25}


def test_drawdown_after_losses(spark):
    rows = [(dt.date(2020, 1, 2) + dt.timedelta(7 * i), -0.01 if i < 50 else 0.01, 0.5) for i in range(100)]
    p = portfolio.performance(spark.createDataFrame(rows, "date date, ls_return_net double, turnover double")).first()
    assert p.max_drawdown == pytest.approx(0.99**49 - 1) and p.num_weeks == 100


def test_preferred_shares(spark):
    codes = {"ENB-PN.TO": True, "BAC-PL": True, "X-P": True, "BBD-A.TO": False, "BF-B": False, "BEP-UN.TO": False, "PPL": False}
    df = spark.createDataFrame([(c,) for c in codes], "code string").withColumn("p", universe.is_preferred(F.col("code")))
    assert {r.code: r.p for r in df.collect()} == codes


def test_membership_intervals(spark):
    d = lambda n: dt.date(2020, 1, n)
    events = spark.createDataFrame(
        [(1, d(1), "A", ""), (2, d(5), "B", "A"), (3, d(9), "A", "C"), (4, d(11), "A", ""), (5, d(12), "", "B")],
        "seq int, date date, added string, removed string",
    )
    current = spark.createDataFrame([("A", "x", "y", d(2)), ("Z", "x", "y", d(3))],
                                    "symbol string, sector string, sub_industry string, date_first_added date")
    got = {(r.symbol, r.date_added, r.date_removed) for r in universe.membership_intervals(events, current).collect()}
    assert got == {("A", d(1), d(5)), ("A", d(11), None), ("B", d(5), d(12)), ("C", None, d(9)), ("Z", d(3), None)}


def test_store_round_trips(spark, tmp_path):
    df = spark.range(20).select(
        F.col("id"), (F.col("id") % 2).cast("string").alias("signal_day"),
        F.expr("date_add(date'2020-01-02', cast(id % 4 as int) * 7)").alias("target_date"),
    )
    path = str(tmp_path / "fc")
    store.write_partitioned(df, path, ["signal_day", "target_date"])
    fresh = df.filter("id < 4").withColumn("id", F.col("id") + 100)
    store.write_partitioned(fresh, path, ["signal_day", "target_date"])
    assert spark.read.parquet(path).count() == 4  # every partition was replaced
    latest = store.read_latest(spark, path, "target_date").collect()
    assert [str(r.target_date) for r in latest] == ["2020-01-23"]
    store.write_csv_mirror(df, str(tmp_path / "csv"), [F.desc("target_date"), F.asc("id")])
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 20
    store.write_metrics_json(df.limit(2), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    folder = store.write_version(df, str(tmp_path / "v"), 3)
    assert spark.read.parquet(folder).count() == 20


def test_append_only_merge(spark):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "new", 1), (2, "b", 2), (2, "a", 1)], "k int, v string, seq int")
    got = {(r.k, r.v, r.added) for r in store.merge_append_only(old, new, ["k"], "seq").collect()}
    assert got == {(1, "old", False), (2, "a", True)}


def test_ewm_of_any_span(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=4000).cumsum()
    x[rng.random(4000) < 0.1] = np.nan
    x[700:1500] = np.nan
    pdf = pd.DataFrame({"symbol": 1, "t": np.arange(4000), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ts.ewm_means(df, ["x"], [1, 2, 30, 200, 500]).toPandas().sort_values("t")
    for n in (1, 2, 30, 200, 500):
        want = pdf.x.ewm(alpha=1 / n, min_periods=n).mean().to_numpy()
        np.testing.assert_allclose(got[f"x_ew{n}"].to_numpy(float), want, rtol=1e-9, atol=1e-9)
