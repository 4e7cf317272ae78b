"""Cross-sectional normalization of the weekly feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import xs
from crosspanel.operators.joins import with_default
from crosspanel.operators.universe import clip


def neutralize(
    features: DataFrame,
    profile: DataFrame,
    cols: Sequence[str],
    passthrough: Sequence[str] = (),
    lower: float = 0.02,
    upper: float = 0.98,
    cap: float = 3.0,
    max_missing: int = 10,
    max_group: int | None = None,
) -> DataFrame:
    """Winsorize, z-score, cap, subtract the industry median, drop thin rows, fill 0.

    Passthrough columns skip all but the last step, where their nulls still count.
    """
    df = with_default(features, profile, "symbol", "industry")
    df = xs.winsorize(df, cols, lower, upper, max_group=max_group)
    df = xs.zscore(df, cols, max_group=max_group)
    df = df.withColumns({c: clip(F.col(c), cap) for c in cols})
    df = xs.subtract_median(df, cols, ["date", "industry"], max_group)
    every = [*cols, *passthrough]
    return df.filter(missing_count(every) <= max_missing).na.fill(0.0, every)


def missing_count(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total


def winsorize_over_time(df: DataFrame, cols: Sequence[str], lower: float = 0.02,
                        upper: float = 0.98, max_rows: int | None = None) -> DataFrame:
    """Clip each symbol's own history to its quantiles."""
    return xs.winsorize(df, cols, lower, upper, by=("symbol",), max_group=max_rows)


def full_neutralization(df: DataFrame, profile: DataFrame, cols: Sequence[str],
                        max_rows: int | None = None, max_group: int | None = None) -> DataFrame:
    """Temporal winsorize, per-date z-score, industry median where the group has peers."""
    out = winsorize_over_time(df, cols, max_rows=max_rows)
    out = xs.zscore(out, cols, max_group=max_group)
    out = with_default(out, profile, "symbol", "industry")
    return xs.subtract_median(out, cols, ["date", "industry"], max_group, min_size=2)
