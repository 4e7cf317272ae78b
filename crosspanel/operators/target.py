"""Forward weekly returns with execution lag, and the training target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators.universe import clip


def check_lag(lag: int, diagnostic: bool = False) -> None:
    """Lag 0 trades on the close that produced the signal; only diagnostics may use it."""
    if lag < 0 or (lag < 1 and not diagnostic):
        raise ValueError(f"execution lag must be at least 1 session, got {lag}")


def weekly_close(bars: DataFrame, cal: DataFrame, signal_day: str = "THU", lag: int | Column = 0,
                 keys: tuple[str, ...] = ()) -> DataFrame:
    """Last close per weekly bin of the panel shifted ``lag`` sessions ahead.

    A close on session t stands for session t - lag, so only the bin label moves: the
    calendar supplies the label of the earlier session and no grid is built.
    """
    steps = F.lit(lag) if isinstance(lag, int) else lag
    rows = bars.join(F.broadcast(cal.select("date", "t")), "date").withColumn("s", F.col("t") - steps)
    label = cal.select(F.col("t").alias("s"), ts.week_of("date", signal_day).alias("week"))
    rows = rows.select(*keys, "symbol", "s", "close").join(F.broadcast(label), "s")
    return rows.groupBy(*keys, "symbol", F.col("week").alias("date")).agg(
        F.max_by("close", "s").alias("close")
    )


def forward_returns(weekly: DataFrame, cal: DataFrame, signal_day: str = "THU",
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """Next week's change of the carried-forward weekly close, for every week.

    Between two observed weeks the carried close is flat: the return is 0 until the week
    before the next observation.  The panel's last week has no return.
    """
    w = Window.partitionBy(*keys, "symbol").orderBy("date")
    last = cal.agg(F.max(ts.week_of("date", signal_day))).scalar()
    nxt, after = F.lead("date").over(w), F.lead("close").over(w)
    spans = weekly.withColumns({"nxt": nxt, "after": after}).withColumn("last_week", last)
    end = F.date_sub(F.coalesce("nxt", "last_week"), 7)
    spans = spans.withColumn("end", end).filter(F.col("end") >= F.col("date"))
    cells = spans.withColumn("date", F.explode(F.sequence("date", "end", F.expr("interval 7 days"))))
    step = F.date_add("date", 7) == F.col("nxt")
    ret = F.when(step, ts.ratio(F.col("after"), F.col("close")) - 1).otherwise(F.lit(0.0))
    return cells.select(*keys, "date", "symbol", ret.alias("ret"))


def trade_returns(bars: DataFrame, cal: DataFrame, signal_day: str = "THU", lag: int = 1,
                  cap: float | None = 0.3, diagnostic: bool = False) -> DataFrame:
    """Weekly P&L returns: forward returns with lag, capped per symbol."""
    check_lag(lag, diagnostic)
    out = forward_returns(weekly_close(bars, cal, signal_day, lag), cal, signal_day)
    return out if cap is None else out.withColumn("ret", clip(F.col("ret"), cap))


def training_target(bars: DataFrame, cal: DataFrame, signal_day: str = "THU", lag: int = 1,
                    max_group: int | None = None) -> DataFrame:
    """Per-date z-score of the forward return."""
    check_lag(lag)
    out = forward_returns(weekly_close(bars, cal, signal_day, lag), cal, signal_day)
    z = xs.zscore(out.withColumnRenamed("ret", "target"), ["target"], max_group=max_group)
    return z.filter("target is not null")
