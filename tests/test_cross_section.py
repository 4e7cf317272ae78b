"""Both plans of every cross-sectional primitive agree, with hot ties and a hot date."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import xs


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    frames = []
    for date, n in (("2020-01-02", 6000), ("2020-01-09", 40), ("2020-01-16", 1)):
        v = rng.normal(size=n)
        v[rng.random(n) < 0.35] = 0.0  # a third of the rows share one value
        v[rng.random(n) < 0.05] = np.nan
        frames.append(pd.DataFrame({"date": date, "symbol": np.arange(n), "v": v, "g": np.arange(n) % 3}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("date", F.to_date("date"))
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("name", F.format_string("s%05d", "symbol"))
    return df.cache(), pdf


def both(monkeypatch, fn, cols):
    """Run with windows, then with the split plan, as sorted pandas frames."""
    out = []
    for limit in (10**9, 0):
        monkeypatch.setattr(xs, "WINDOW_LIMIT", limit)
        out.append(fn().select(*cols).toPandas().sort_values(cols[:3]).reset_index(drop=True))
    return out


def test_rank_first(monkeypatch, panel):
    df, _ = panel
    for tie in ("symbol", "name"):
        for desc in (False, True):
            a, b = both(monkeypatch, lambda: xs.rank_first(df, "v", tie, descending=desc),
                        ["date", "symbol", "pos", "n"])
            pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_rank_average_and_pct(monkeypatch, panel):
    df, pdf = panel
    a, b = both(monkeypatch, lambda: xs.pct_rank(df, "v"), ["date", "symbol", "pct"])
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    want = pdf.groupby("date")["v"].rank(pct=True).to_numpy()
    got = a.assign(d=a.date.astype(str)).sort_values(["d", "symbol"])["pct"].to_numpy(float)
    np.testing.assert_allclose(got, want)


def test_quantiles_match_numpy(monkeypatch, panel):
    df, pdf = panel
    probs = (0.0, 0.02, 0.5, 0.98, 1.0)
    cols = ["date", *[f"v_q{i}" for i in range(5)]]
    for limit in (10**9, 0):
        monkeypatch.setattr(xs, "WINDOW_LIMIT", limit)
        got = xs.quantiles(df, ["date"], ["v"], probs).select(*cols).toPandas().sort_values("date")
        want = pdf.groupby("date")["v"].quantile(list(probs)).unstack()
        np.testing.assert_allclose(got[cols[1:]].to_numpy(float), want.to_numpy(), atol=1e-12)


@pytest.mark.parametrize("op", ["winsorize", "zscore", "median", "bins", "mean"])
def test_transforms_agree(monkeypatch, panel, op):
    df, _ = panel
    fns = {
        "winsorize": lambda: xs.winsorize(df, ["v"]),
        "zscore": lambda: xs.zscore(df, ["v"]),
        "median": lambda: xs.subtract_median(df, ["v"], ["date", "g"], min_size=2),
        "bins": lambda: xs.quantile_bins(df, "v", 10).withColumn("v", F.col("bin").cast("double")),
        "mean": lambda: xs.with_stats(df, ["date", "g"], {"m": F.avg("v")}).withColumn("v", F.col("m")),
    }
    a, b = both(monkeypatch, fns[op], ["date", "symbol", "v"])
    np.testing.assert_allclose(a.v.to_numpy(float), b.v.to_numpy(float), atol=1e-9)


def test_top_and_bottom(panel):
    df, _ = panel
    got = xs.top_and_bottom(df, 3, value="v").toPandas()
    assert got.groupby(["date", "side"]).size().max() == 3
    day = got[(got.date.astype(str) == "2020-01-02") & (got.side == "LONG")].sort_values("rank")
    assert day.v.is_monotonic_decreasing


def test_plans_agree_on_text_ties_and_null_keys(spark, monkeypatch):
    names = ["ab", "az", "aé", "zz", "zé", "éa", "日本", "日", "", "shared-prefix-a", "shared-prefix-b", "shared-prefix-é"]
    rows = [(g, n, v) for g in ("2020-01-02", None) for n in names for v in (0.0,)]
    rows += [("2020-01-09", f"shared-prefix-{i:04d}", 1.0 if i % 3 else float(i)) for i in range(900)]
    rows += [(None, "nul", None), (None, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, symbol string, v double")
    df = df.select(F.to_date("g").alias("date"), "symbol", "v")
    for fn, cols in (
        (lambda: xs.rank_first(df, "v"), ["date", "symbol", "pos", "n"]),
        (lambda: xs.rank_first(df, "v", descending=True), ["date", "symbol", "pos", "n"]),
        (lambda: xs.pct_rank(df, "v"), ["date", "symbol", "pct"]),
        (lambda: xs.with_stats(df, ["date"], {"m": F.avg("v")}), ["date", "symbol", "m"]),
        (lambda: xs.with_quantiles(df, ["date"], ["v"], (0.1, 0.5)), ["date", "symbol", "v_q0", "v_q1"]),
        (lambda: xs.quantile_bins(df, "v", 5), ["date", "symbol", "bin"]),
    ):
        found = []
        for limit in (10**9, 0):
            monkeypatch.setattr(xs, "WINDOW_LIMIT", limit)
            found.append(sorted(map(tuple, fn().select(*cols).collect()), key=str))
        assert found[0] == found[1]
    monkeypatch.setattr(xs, "WINDOW_LIMIT", 0)
    order = {r.symbol: r.pos for r in xs.rank_first(df.filter("date = '2020-01-02'"), "v").collect()}
    assert sorted(order, key=order.get) == sorted(names, key=str.encode)


def test_limit_counts_rows_and_columns(spark, monkeypatch):
    df = spark.range(10).selectExpr("1 as g", "double(id) as a", "double(id) as b")
    monkeypatch.setattr(xs, "WINDOW_LIMIT", 15)
    assert xs.fits_window(df, ["g"], 10)[1] and not xs.fits_window(df, ["g"], 10, 2)[1]
