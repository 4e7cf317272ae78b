"""Prediction rank to expected weekly excess return."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators.universe import clip
from crosspanel.session import stage

WEEKS_PER_YEAR = 52


def excess_returns(weekly: DataFrame, max_group: int | None = None, bound: float = 0.5) -> DataFrame:
    """Clipped next-week change of unfilled weekly closes, less its date's mean.

    A return exists only between adjacent weeks that both have a close.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    adjacent = F.lead("date").over(w) == F.date_add("date", 7)
    fwd = F.when(adjacent, ts.ratio(F.lead("close").over(w), F.col("close")) - 1)
    df = weekly.withColumn("fwd", clip(fwd, bound)).filter("fwd is not null")
    df = xs.with_stats(df, ["date"], {"_m": F.avg("fwd")}, max_group)
    return df.select("date", "symbol", (F.col("fwd") - F.col("_m")).alias("ex_ret"))


def prediction_bins(scores: DataFrame, excess: DataFrame, n_bins: int = 20) -> DataFrame:
    """Mean prediction and mean excess return per pooled quantile bin.

    The pooled rows are one group, so their edges are aggregated and the row of edges is
    broadcast; no task sees all rows.
    """
    joined = stage(scores.join(excess, ["date", "symbol"]).dropna(subset=["prediction", "ex_ret"]))
    joined = joined.withColumn("_all", F.lit(1))
    binned = xs.pooled_bins(joined, "prediction", n_bins, ["_all"])
    return binned.groupBy("bin").agg(
        F.avg("prediction").alias("pred"), F.avg("ex_ret").alias("ex_ret"),
        F.count(F.lit(1)).alias("n"),
    )


def calibrate(bins: DataFrame, grid_points: int = 101) -> DataFrame:
    """Isotonic fit of the bin means read off on an even grid over [0, 1]."""
    spark = bins.sparkSession
    features = VectorAssembler(inputCols=["pred"], outputCol="features")
    model = IsotonicRegression(labelCol="ex_ret", isotonic=True).fit(features.transform(bins))
    step = 1.0 / (grid_points - 1)
    grid = spark.range(grid_points).select((F.col("id") * step).alias("pred"))
    fitted = model.transform(features.transform(grid))
    return fitted.select(
        F.col("pred").alias("prediction"), F.col("prediction").alias("exp_excess_ret")
    )


def expected_return(scores: DataFrame, calibration: DataFrame, grid_points: int = 101) -> DataFrame:
    """Linear interpolation on the calibration grid, clamped at its ends.

    The grid is even, so the bracketing points follow from the score: an equi-join on a
    table of ``grid_points`` rows.
    """
    last = grid_points - 1
    w = Window.orderBy("prediction")
    points = calibration.select(
        F.round(F.col("prediction") * last).cast("int").alias("cell"),
        F.col("exp_excess_ret").alias("_y0"),
        F.coalesce(F.lead("exp_excess_ret").over(w), F.col("exp_excess_ret")).alias("_y1"),
    )
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))) * last
    cell = F.least(F.floor(x), F.lit(last)).cast("int")
    out = scores.withColumn("_x", x).withColumn("cell", cell).join(F.broadcast(points), "cell")
    value = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (F.col("_x") - F.col("cell"))
    return out.withColumn("exp_excess_ret", value).drop("_x", "cell", "_y0", "_y1")


def annualize_weekly(weekly: Column) -> Column:
    return F.pow(1 + weekly, F.lit(WEEKS_PER_YEAR)) - 1
