"""Sliding medians, exponential means, stacking and correlations against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import ensemble, profiling, walkforward


def series(n=90, names=3, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([(s, t, rng.integers(0, 9) / 4) for s in range(names) for t in range(n)], columns=["symbol", "t", "x"])
    pdf.loc[rng.random(len(pdf)) < 0.2, "x"] = None
    return pdf


@pytest.mark.parametrize("rows,least,centered", [(7, 3, False), (42, 5, False), (21, 1, True), (1, 1, False)])
def test_sliding_medians_equal_pandas(spark, rows, least, centered):
    pdf = series()
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    got = ts.rolling_medians(df, {"m": "x"}, rows, least, centered=centered).toPandas().sort_values(["symbol", "t"])
    want = pdf.groupby("symbol").x.transform(lambda s: s.rolling(rows, min_periods=least, center=centered).median())
    assert np.allclose(got.m.to_numpy(float), want.to_numpy(float), equal_nan=True)
    one = df.filter("symbol = 0").drop("symbol")
    whole = ts.rolling_medians(one, {"m": "x", "m2": "t"}, rows, least, by=(), centered=centered).toPandas().sort_values("t")
    assert list(whole.columns) == ["t", "x", "m", "m2"]
    assert np.allclose(whole.m.to_numpy(float), want[pdf.symbol == 0].to_numpy(float), equal_nan=True)


def test_centered_windows_have_a_middle(spark):
    with pytest.raises(ValueError):
        ts.rolling_medians(spark.createDataFrame(series()), {"m": "x"}, 4, centered=True)


@pytest.mark.parametrize("span", [2, 14])
def test_exponential_means_over_many_blocks(spark, span):
    pdf = series(n=1500, names=1)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ts.ewm_means(df, ["x"], [span]).toPandas().sort_values("t")[f"x_ew{span}"].to_numpy(float)
    want = pdf.x.ewm(alpha=1 / span, min_periods=span).mean().to_numpy()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9)


def test_stack_of_eight_members_is_a_ridge(spark):
    rng = np.random.default_rng(4)
    names = [f"m{i}" for i in range(8)]
    days = [dt.date(2020, 1, 2) + dt.timedelta(7 * w) for w in range(8)]
    wide = pd.DataFrame([(d, s, *rng.normal(size=8)) for d in days for s in range(40)], columns=["date", "symbol", *names])
    wide["target"] = wide[names].to_numpy() @ rng.normal(size=8) + rng.normal(size=len(wide))
    preds = spark.createDataFrame(wide.melt(["date", "symbol"], names, "model", "prediction"))
    got = ensemble.combine_stack(preds, spark.createDataFrame(wide[["date", "symbol", "target"]]), names, min_weeks=3,
                                 alpha=2.0, max_group=40).toPandas().sort_values(["date", "symbol"])
    ranks = wide.groupby("date")[names].rank(pct=True)
    day = days[-1]
    past, now = (wide.date < day).to_numpy(), (wide.date == day).to_numpy()
    x, y = ranks[past].to_numpy(), wide.target[past].to_numpy()
    centred = x - x.mean(0)
    beta = np.linalg.solve(centred.T @ centred + 2.0 * np.eye(8), centred.T @ (y - y.mean()))
    want = (ranks[now].to_numpy() - x.mean(0)) @ beta
    assert np.allclose(got[got.date == day].prediction.to_numpy(), want, atol=1e-8)


def test_rank_ic_of_a_constant_score_is_null(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 2), s, 1.0, float(s)) for s in range(9)], "date date, symbol long, p double, y double")
    assert ensemble.rank_ic(df, "p", "y").first().ic is None


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(2)
    cols = [f"c{i}" for i in range(12)]
    pdf = pd.DataFrame(1e6 + rng.normal(size=(300, 12)).cumsum(1), columns=cols)
    pdf["date"] = [dt.date(2020, 1, 1 + i % 3) for i in range(300)]
    pdf.loc[5, "c3"] = None
    got = {(r.date, r.pair): r["corr"] for r in profiling.pair_correlations(spark.createDataFrame(pdf).repartition(4), cols, 20).collect()}
    assert len(got) == 3 * 66
    for day, g in pdf.dropna().groupby("date"):
        c = g[cols].corr()
        assert all(abs(got[day, f"{a} / {b}"] - c.loc[a, b]) < 1e-9 for i, a in enumerate(cols) for b in cols[i + 1:])
    assert profiling.pair_correlations(spark.createDataFrame(pdf), cols, 100).count() == 0


def test_purge_must_leave_weeks(spark):
    weeks = spark.createDataFrame([(dt.date(2020, 1, 2) + dt.timedelta(7 * w),) for w in range(20)], "date date")
    plain, purged = (walkforward.schedule(weeks, 8, 4, 4, purge_weeks=p).orderBy("retrain_id").collect() for p in (0, 1))
    for a, b in zip(plain, purged):
        assert (a.train_to - b.train_to).days == 7 and (a.val_to - b.val_to).days == 7
        assert (a.train_from, a.val_from, a.score_from) == (b.train_from, b.val_from, b.score_from)
    with pytest.raises(ValueError):
        walkforward.schedule(weeks, 8, 4, 4, purge_weeks=4)
