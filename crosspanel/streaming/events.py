"""Structured Streaming jobs: event dedupe, the weekly balance and the outcomes of picks.

Each is a batch operator on an unbounded input; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEK_ENDS = ("WED", "THU", "FRI", "SAT", "SUN", "MON", "TUE")


def dedupe(events: DataFrame, keys: Sequence[str], late: str = "7 days", ts: str = "ts") -> DataFrame:
    """Keep the first arrival of each key; state older than the watermark is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def weekly_balance(events: DataFrame, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """(ups - downs) / all actions per symbol over 7-day windows sliding by a day."""
    direction = F.when(F.col("action") == "upgrade", 1).when(F.col("action") == "downgrade", -1).otherwise(0)
    counts = events.withWatermark(ts, late).groupBy(
        F.window(ts, "7 days", "1 day"), "symbol"
    ).agg(F.sum(direction).alias("net"), F.count(F.lit(1)).alias("total"))
    return counts.select(
        F.date_sub(F.to_date("window.end"), 1).alias("date"), "symbol",
        F.try_divide(F.col("net").cast("double"), F.col("total")).alias("UPDOWN1W_RATINGS"),
    )


def weekly_closes(bars: DataFrame, signal_day: str = "THU", late: str = "3 days") -> DataFrame:
    """(symbol, label, close, week_end): the last close of each week that ends on ``signal_day``.

    ``bars`` has symbol, ts (timestamp) and close.  A week is given out once, when the watermark
    has passed its end, so a bar up to ``late`` behind the newest one still counts.
    """
    # Windows count from 1970-01-01, a Thursday: a week that ends on a Wednesday starts there.
    start = WEEK_ENDS.index(signal_day)
    weeks = bars.withWatermark("ts", late).groupBy(
        F.window("ts", "7 days", "7 days", f"{start} days"), "symbol"
    ).agg(F.max_by("close", "ts").alias("close"))
    return weeks.select(
        "symbol", F.date_sub(F.to_date("window.end"), 1).alias("label"), "close",
        F.window_time("window").alias("week_end"),
    )


def pick_outcomes(picks: DataFrame, bars: DataFrame, signal_day: str = "THU",
                  late: str = "3 days", late_picks: str = "3 days") -> DataFrame:
    """Each pick once, with the close of its target week, or with null if none came in time.

    ``picks`` has symbol, target_ts (start of the target day), entry_close and side.  The outer
    join waits for a week until both watermarks have passed it; then its state goes.  Adds
    exit_close, realized_ret and signed_ret, as the batch evaluation does.
    """
    closes = weekly_closes(bars, signal_day, late).select(
        F.col("symbol").alias("_symbol"), "week_end", F.col("close").alias("exit_close"))
    # A week's own time is its last microsecond, which lies on the target day.  The day is a key of
    # the state: by symbol alone every close would go over all picks of its symbol.  The range lets state go.
    same_day = F.to_date("week_end") == F.to_date("target_ts")
    due = (F.col("symbol") == F.col("_symbol")) & same_day & (F.col("week_end") >= F.col("target_ts")) & (
        F.col("week_end") < F.col("target_ts") + F.expr("interval 1 day"))
    out = picks.withWatermark("target_ts", late_picks).join(closes, due, "left_outer")
    ret = F.try_divide(F.col("exit_close"), F.col("entry_close")) - 1
    return out.drop("_symbol", "week_end").withColumn("realized_ret", ret).withColumn(
        "signed_ret", F.when(F.col("side") == "LONG", F.col("realized_ret")).otherwise(-F.col("realized_ret")))
