"""Data profiling: summaries, coverage, histograms, correlations, moments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def factor_summary(weekly: DataFrame, cols: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """One row per factor: count, mean, std, min, quantiles, max."""
    long = weekly.unpivot(["date", "symbol"], list(cols), "factor", "value").dropna(subset=["value"])
    basic = long.groupBy("factor").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = xs.quantiles(long, ["factor"], ["value"], list(QUANTILES.values()), max_rows)
    return basic.join(q.withColumnsRenamed({f"value_q{i}": n for i, n in enumerate(QUANTILES)}), "factor")


def coverage_by_date(bars: DataFrame, n_symbols: Column, rows: int = 21) -> DataFrame:
    """Share of symbols with a close, and mean dollar volume with its moving average."""
    daily = bars.groupBy("date").agg(
        (F.count("close") / n_symbols * 100).alias("pct_non_null"),
        F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume"),
    )
    w = Window.orderBy("date")
    smooth = ts.rolling(F.avg, F.col("avg_dollar_volume"), rows, window=w)
    return daily.withColumn("smoothed", smooth)


def histogram(rows: DataFrame, value: str, bins: int, lower: float = 0.0, upper: float = 1.0,
              by: Sequence[str] = ("factor",), max_rows: int | None = None) -> DataFrame:
    """Equal-width counts after clipping to two quantiles; the top edge is closed."""
    clipped = xs.with_quantiles(rows.dropna(subset=[value]), by, [value], (lower, upper), max_rows)
    lo, hi = F.col(f"{value}_q0"), F.col(f"{value}_q1")
    x = F.least(F.greatest(F.col(value), lo), hi)
    cell = F.least(F.floor(F.try_divide(x - lo, hi - lo) * bins), F.lit(bins - 1))
    return clipped.withColumn("bin", F.coalesce(cell, F.lit(0))).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def dispersion(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cross-sectional mean and std per date."""
    aggs = [f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rows.groupBy("date").agg(*aggs)


def pair_correlations(rows: DataFrame, cols: Sequence[str], min_names: int) -> DataFrame:
    """Correlation of every factor pair per date over complete rows, as long rows.

    Tasks take the products of all columns of a date at once, as one matrix product, and give
    one row of moments per date and pair; Spark adds those up.  So the plan is as long for two
    factors as for a hundred.  Columns are shifted by their means first, so that no digits cancel.
    """
    cols = list(cols)
    means = rows.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))) for c in cols]).first()
    shift = np.array([float(m or 0.0) for m in means])
    sums = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def moments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            days = np.asarray(batch.column(0).cast(pa.int32()))
            x = np.stack([
                np.asarray(batch.column(i + 1).cast(pa.float64()).fill_null(np.nan)) for i in range(len(cols))
            ], 1) - shift
            whole = ~np.isnan(x).any(1)
            days, x = days[whole], x[whole]
            for day in np.unique(days).tolist():
                part = x[days == day]
                n, s, p = held.get(day, (0, 0.0, 0.0))
                held[day] = n + len(part), s + part.sum(0), p + part.T @ part
        i, j = np.triu_indices(len(cols), 1)
        for day, (n, s, p) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(i), day), pa.int32()).cast(pa.date32()), pa.array(i, pa.int64()), pa.array(j, pa.int64()),
                *[pa.array(v, pa.float64()) for v in (np.full(len(i), n), s[i], s[j], p[i, i], p[j, j], p[i, j])],
            ], names=["date", "i", "j", *sums])

    found = (
        rows.select("date", *cols).mapInArrow(moments_of, "date date, i long, j long, " + ", ".join(f"{c} double" for c in sums))
        .groupBy("date", "i", "j").agg(*[F.sum(c).alias(c) for c in sums]).filter(F.col("n") > min_names)
    )
    spread = {c: F.greatest(F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n"), F.lit(0.0)) for c in "ab"}
    both = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    corr = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(both, F.sqrt(spread["a"]) * F.sqrt(spread["b"]))))
    names = F.array(*[F.lit(c) for c in cols])
    pair = F.concat(F.get(names, F.col("i")), F.lit(" / "), F.get(names, F.col("j")))
    return found.select("date", pair.alias("pair"), corr.alias("corr"))


def latest_full_date(rows: DataFrame, cols: Sequence[str], min_names: int) -> DataFrame:
    """Latest date on which every factor has more than ``min_names`` values."""
    counts = rows.groupBy("date").agg(F.least(*[F.count(c) for c in cols]).alias("n"))
    return counts.filter(F.col("n") > min_names).agg(F.max("date").alias("date"))


def sampled_weeks(rows: DataFrame, target: int = 52) -> DataFrame:
    """About ``target`` evenly spaced dates of those present; a report's sampling."""
    days = rows.select("date").distinct()
    w = Window.orderBy("date")
    numbered = days.withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy())
    )
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target))
    return numbered.filter(F.col("_i") % step == 0).select("date")


def moments(rows: DataFrame, col: str) -> DataFrame:
    """Count, mean, std and bias-corrected skewness and excess kurtosis."""
    m = rows.agg(
        F.count(col).cast("double").alias("n"), F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"), F.skewness(col).alias("g1"), F.kurtosis(col).alias("g2"),
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return m.select("n", "mean", "std", skew.alias("skew"), kurt.alias("kurtosis"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Names in both sources, and names only in the first."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    both = left.intersect(right).withColumn("status", F.lit("both"))
    return both.unionByName(left.subtract(right).withColumn("status", F.lit("first only")))


def prediction_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("num_observations"), F.count_distinct("date").alias("num_unique_dates")
    )


def top_features(importance: DataFrame, n: int = 10, value: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(value), "feature").limit(n)
