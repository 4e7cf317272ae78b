"""Assembly of the weekly feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import blocks, factors, fundamentals
from crosspanel.sources.tables import Tables

MACROS = {
    "1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM", "5-LOW": "LOW",
}
BETA_MACROS = ["URGENT", "HIGH", "MEDIUM", "LOW"]
RAW_RETURNS, RAW_CHANGES = ["URGENT", "HIGH"], ["LOW"]


def weeks_only(daily: DataFrame, weeks: DataFrame | None, signal_day: str) -> DataFrame:
    """Rows of the listed weekly bins; every row where none are listed."""
    if weeks is None:
        return daily
    listed = F.broadcast(weeks.select(F.col("date").alias("_week")))
    return daily.join(listed, ts.week_of("date", signal_day) == F.col("_week"), "left_semi")


def weekly_factors(t: Tables, cols: Sequence[str], signal_day: str, weeks: DataFrame | None = None,
                   ratings: DataFrame | None = None) -> DataFrame:
    """The listed factors sampled weekly.

    Families without a listed factor are not computed.  ``weeks`` leaves out the other weeks
    once their days have gone into the windows.
    """
    cols = [c for c in feature_columns(with_ratings=ratings is not None) if c in cols]
    series = [factors.market_series(t.calendar, t.market)] if {*cols} & {*factors.MARKET_FACTORS} else []
    if macros := [m for m in BETA_MACROS if f"BETA_{m}" in cols]:
        moments = macro_on_calendar(t)
        for m in macros:
            moments = factors.series_moments(moments, m, (factors.HALF_YEAR,))
        series.append(moments)
    return blocks.weekly(t.bars, t.calendar, cols, series, t.statements, ratings, signal_day, weeks, t.n_symbols)


def macro_on_calendar(t: Tables) -> DataFrame:
    wide = factors.macro_wide(t.macro, MACROS)
    return factors.series_on_calendar(t.calendar, wide, list(MACROS.values()))


def macro_features(t: Tables) -> tuple[DataFrame, list[str]]:
    """Date-level passthrough columns: regime flags and raw moves."""
    names = list(MACROS.values())
    df = factors.regime_flags(macro_on_calendar(t), names)
    df = factors.raw_moves(df, RAW_RETURNS, RAW_CHANGES)
    cols = [f"{s}_{k}" for s in names for k in ("HI", "TREND_UP")]
    cols += [f"{s}_R5" for s in RAW_RETURNS] + [f"{s}_D5" for s in RAW_CHANGES]
    return df, cols


def feature_columns(with_reports: bool = True, with_ratings: bool = False) -> list[str]:
    cols = [*factors.PRICE_FACTORS, *factors.MARKET_FACTORS, *[f"BETA_{m}" for m in BETA_MACROS]]
    cols += fundamentals.FACTORS if with_reports else []
    return cols + (["UPDOWN1W_RATINGS"] if with_ratings else [])


def feature_matrix(
    t: Tables, signal_day: str = "THU", whitelist: Sequence[str] | None = None,
    with_reports: bool = True, ratings: DataFrame | None = None, weeks: DataFrame | None = None,
) -> tuple[DataFrame, list[str], list[str]]:
    """(date, symbol, factors...) sampled weekly, with factor and passthrough names.

    Passthrough columns are the same for every symbol of a week; they are sampled at day
    level and broadcast, never expanded to the daily grid.  ``weeks`` keeps the listed weeks only.
    """
    cols = feature_columns(with_reports, ratings is not None)
    daily, passthrough = macro_features(t)
    if whitelist is not None:
        cols = keep_listed(cols, whitelist)
        passthrough = keep_listed(passthrough, whitelist)
    # A symbol without actions is neutral, not missing.
    weekly = weekly_factors(t, cols, signal_day, weeks, ratings)
    if passthrough:
        common = ts.weekly_last(daily, passthrough, signal_day, keys=())
        weekly = weekly.join(F.broadcast(common), "date", "left")
    return weekly, cols, passthrough


def keep_listed(names: Sequence[str], whitelist: Sequence[str]) -> list[str]:
    """Listed names in their own order; unknown list entries are ignored."""
    wanted = set(whitelist)
    return [n for n in names if n in wanted]
