"""Technical verdicts, briefs, rank-IC, stacking and the streaming forms."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import ensemble, research, technicals
from crosspanel.streaming import events as streams

BASE = dict(n_bars=300, rsi14=50.0, z20=0.0, ret_1w_pct=0.5, trend="SIDEWAYS", pct_of_52w_range=0.5)


@pytest.mark.parametrize(
    "change, verdict",
    [
        (dict(n_bars=19), "INSUFFICIENT_DATA"),
        (dict(rsi14=70.0), "OVERBOUGHT_PULLBACK"),
        (dict(z20=2.0, trend="UP"), "OVERBOUGHT_PULLBACK"),
        (dict(rsi14=30.0, ret_1w_pct=-1.0), "OVERSOLD_BOUNCE"),
        (dict(trend="UP", ret_1w_pct=-1.0, z20=-0.5), "UPTREND_PULLBACK"),
        (dict(trend="DOWN", z20=0.5), "DOWNTREND_RALLY"),
        (dict(trend="UP", z20=1.5), "UPTREND_INTACT"),
        (dict(trend="DOWN", z20=None), "DOWNTREND_INTACT"),
        (dict(rsi14=None), "RANGEBOUND"),
    ],
)
def test_verdicts(spark, change, verdict):
    row = BASE | change
    schema = "n_bars int, rsi14 double, z20 double, ret_1w_pct double, trend string, pct_of_52w_range double"
    out = technicals.classify(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert out.verdict == verdict
    assert out.verdict_label == technicals.VERDICT_LABELS[verdict]
    if verdict != "INSUFFICIENT_DATA":
        assert out.verdict_reasons[-1] == "50% of the 52-week range"


def test_indicators_on_a_short_history(spark):
    n = 30
    close = [100.0 + i for i in range(n)]
    rows = [(dt.date(2025, 1, 1) + dt.timedelta(i), "A", c, c * 1.01, c * 0.99, 1e6) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "date date, symbol string, close double, high double, low double, volume double")
    got = technicals.indicators(bars, "2025-01-25").first()
    s = pd.Series(close)
    assert got.n_bars == n and got.sma50 is None and got.ret_3m_pct is None
    assert got.sma20 == pytest.approx(s.tail(20).mean())
    assert got.z20 == pytest.approx((s.iloc[-1] - s.tail(20).mean()) / s.tail(20).std(), abs=1e-6)
    assert got.move_since_signal_pct == pytest.approx((close[-1] / close[24] - 1) * 100, abs=1e-5)


GOOD = '{"thesis": "t", "theme": "x", "fundamental_read": "f", "technical_read": "r"}'


@pytest.mark.parametrize(
    "text, problem",
    [
        (GOOD, None),
        ("```json\n" + GOOD + "\n```", None),
        ("Sure: " + GOOD + " done", None),
        ("", "empty response"),
        ("no braces", "no JSON object found in response"),
        ("{broken}", "invalid JSON"),
        (GOOD.replace('"x"', "3"), "missing or non-string keys: theme"),
        (GOOD[:-1] + ', "catalysts": {"a": 1}}', "catalysts must be a list, got dict"),
        ("[" + GOOD + "]", "expected a JSON object, got list"),
        ("42", "expected a JSON object, got int"),
        (GOOD[:-1] + ', "catalysts": true}', "catalysts must be a list, got bool"),
        (GOOD[:-1] + ', "catalysts": 0, "headline_risks": false, "sources_used": {}}', None),
    ],
)
def test_briefs(spark, text, problem):
    out = research.parse_briefs(spark.createDataFrame([(text,)], "text string")).first()
    assert out.problem == problem
    assert (out.thesis == "t") == (problem is None)


def test_brief_list_items_become_text(spark):
    text = GOOD[:-1] + ', "catalysts": " alone ", "sources_used": [1, true, null, " x ", "", 2.5], "headline_risks": {}}'
    out = research.parse_briefs(spark.createDataFrame([(text,)], "text string")).first()
    assert (out.catalysts, out.sources_used, out.headline_risks) == (["alone"], ["1", "True", "None", "x", "2.5"], [])


def test_rank_ic(spark):
    rng = np.random.default_rng(0)
    rows = [(dt.date(2020, 1, 2) + dt.timedelta(7 * w), i, float(v)) for w in range(3) for i, v in enumerate(rng.normal(size=40 if w else 3))]
    df = spark.createDataFrame(rows, "date date, symbol int, y double").withColumn("m", -F.col("y"))
    same = {r.date: r.ic for r in ensemble.rank_ic(df, "y", "y", max_group=40).collect()}
    assert same[dt.date(2020, 1, 2)] is None and same[dt.date(2020, 1, 9)] == pytest.approx(1)
    assert ensemble.mean_rank_ic(ensemble.rank_ic(df, "m", "y", max_group=40)).first().ic == pytest.approx(-1)


def test_stack_matches_a_direct_ridge(spark):
    rng = np.random.default_rng(1)
    weeks = [dt.date(2020, 1, 2) + dt.timedelta(7 * w) for w in range(30)]
    pdf = pd.DataFrame([(d, s, *rng.normal(size=3)) for d in weeks for s in range(12)], columns=["date", "symbol", "a", "b", "target"])
    df = spark.createDataFrame(pdf)
    preds = df.unpivot(["date", "symbol"], ["a", "b"], "model", "prediction")
    got = ensemble.combine_stack(preds, df, ["a", "b"], max_group=12).toPandas().sort_values(["date", "symbol"])
    ranks = pdf.groupby("date")[["a", "b"]].rank(pct=True)
    past = pdf.date < weeks[28]
    x, y = ranks[past].to_numpy(), pdf[past].target.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    want = (ranks[pdf.date == weeks[28]].to_numpy() - x.mean(0)) @ beta
    np.testing.assert_allclose(got[got.date == weeks[28]].prediction, want, atol=1e-9)
    first = ranks[pdf.date == weeks[0]].mean(axis=1)
    np.testing.assert_allclose(got[got.date == weeks[0]].prediction, first, atol=1e-12)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(dt.datetime(2024, 1, 1, 9), "A", "upgrade", 1), (dt.datetime(2024, 1, 1, 9), "A", "upgrade", 1),
            (dt.datetime(2024, 1, 3, 9), "A", "downgrade", 2), (dt.datetime(2024, 1, 3, 10), "A", "upgrade", 3)]
    batch = spark.createDataFrame(rows, "ts timestamp, symbol string, action string, id int")
    batch.write.parquet(src)
    once = streams.dedupe(spark.readStream.schema(batch.schema).parquet(src), ["id"])
    q = once.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    kept = spark.read.parquet(out)
    assert kept.count() == 3
    got = {r.date: r.UPDOWN1W_RATINGS for r in streams.weekly_balance(kept).collect()}
    assert got[dt.date(2024, 1, 1)] == 1.0
    assert got[dt.date(2024, 1, 3)] == pytest.approx(1 / 3)
