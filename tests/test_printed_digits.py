"""Digits as printed, on values at a tie."""

from pyspark.sql import functions as F

from crosspanel.operators.technicals import reasons, tenths


def test_tenths_are_those_of_the_exact_value(spark):
    values = [0.15, 0.25, 0.35, 0.45, 2.25, 12.5, 0.05, 0.95, 1.005, 57.25, 3.0, -0.15, -0.25, 99.95, 1234.65]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(F.format_string("%.1f", tenths(F.col("x")))).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_reasons_print_ties_as_python(spark):
    row = {"n_bars": 90, "rsi14": 57.25, "z20": -0.15, "ret_1w_pct": 1.0, "pct_of_52w_range": 0.025, "verdict": "RANGEBOUND"}
    got = spark.createDataFrame([row]).select(F.array_join(reasons(), " | ")).first()[0]
    assert got.split(" | ")[1:] == ["0.1σ below SMA20", "RSI14 57.2", "2% of the 52-week range"]
