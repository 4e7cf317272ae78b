"""Quantile long/short portfolios, costs, performance and their diagnostics.

Extra ``keys`` (model, lag, signal day, cost) run many portfolios as one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators.target import forward_returns, weekly_close
from crosspanel.operators.universe import INFINITE_FLOOR, clip, lookup

WEEKS_PER_YEAR = 52


def assign_quantiles(scores: DataFrame, q: int = 5, keys: Sequence[str] = (),
                     max_group: int | None = None) -> DataFrame:
    """Quantile 1..q by position: ceil(q * position / count), ties in symbol order.

    Not ntile(), which puts the remainder rows into the first buckets instead.
    """
    ranked = xs.rank_first(
        scores, "prediction", by=[*keys, "date"], name="_pos", count="_n", max_group=max_group
    )
    bucket = F.ceil(F.col("_pos") * q / F.col("_n")).cast("int")
    return ranked.withColumn("quintile", bucket).drop("_pos", "_n")


def long_short_members(scores: DataFrame, q: int = 5, long_q: int | None = None, short_q: int = 1,
                       keys: Sequence[str] = (), max_group: int | None = None) -> DataFrame:
    bucket = F.col("quintile")
    side = F.when(bucket == (long_q or q), "LONG").when(bucket == short_q, "SHORT")
    out = assign_quantiles(scores, q, keys, max_group).withColumn("side", side)
    return out.filter("side is not null").select(*keys, "date", "symbol", "side")


def with_scale(members: DataFrame, adv: DataFrame | None, threshold: float | dict[str, float],
               profile: DataFrame | None = None) -> DataFrame:
    """``scale`` = min(1, ADV / threshold) before normalization; 1 without ADV data."""
    if adv is None:
        return members.withColumn("scale", F.lit(1.0))
    out = members.join(adv.select("date", "symbol", "adv"), ["date", "symbol"], "left")
    if isinstance(threshold, dict):
        out = out.join(profile.select("symbol", "region"), "symbol", "left")
        floor = lookup(F.col("region"), threshold, F.lit(INFINITE_FLOOR))
    else:
        floor = F.lit(float(threshold))
    scale = F.least(F.coalesce("adv", F.lit(0.0)) / floor, F.lit(1.0))
    return out.withColumn("scale", scale).select(*members.columns, "scale")


def basket_weights(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Normalized weights per (date, side); an all-zero basket is equally weighted."""
    by = [*keys, "date", "side"]
    sums = members.groupBy(*by).agg(F.sum("scale").alias("_t"), F.count(F.lit(1)).alias("_c"))
    return members.join(sums, by).withColumn(
        "weight", F.when(F.col("_t") > 0, F.col("scale") / F.col("_t")).otherwise(1.0 / F.col("_c"))
    ).drop("_t", "_c")


def mark_kept(members: DataFrame, dates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``kept``: whether the name was on the same side on the previous portfolio date.

    ``dates`` (keys, date, prev) has a row per rebalance, bounded by weeks of history.
    The look-back is a lag in the symbol's own membership rows; no self-join.
    """
    own = Window.partitionBy(*keys, "symbol", "side").orderBy("date")
    out = members.withColumn("_was", F.lag("date").over(own))
    out = out.join(F.broadcast(dates), [*keys, "date"])
    return out.withColumn("kept", F.coalesce(F.col("_was") == F.col("prev"), F.lit(False)))


def rebalance_dates(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, date) with the previous date of the same portfolio."""
    days = scores.select(*keys, "date").distinct()
    w = Window.partitionBy(*keys).orderBy("date")
    return days.withColumn("prev", F.lag("date").over(w))


def long_short(scores: DataFrame, returns: DataFrame, adv: DataFrame | None = None,
               threshold: float | dict[str, float] = 2.0e7, profile: DataFrame | None = None,
               cost_bps: float = 1.5, q: int = 5, keys: Sequence[str] = (),
               max_group: int | None = None, members: DataFrame | None = None,
               variants: dict[str, Sequence] | None = None) -> DataFrame:
    """Weekly long, short and net returns with turnover.

    ``variants`` lists the values of keys that only the returns carry (execution lags);
    membership and turnover do not depend on them and are computed once.
    Each basket's return is sum(scale * ret) / sum(scale), so weights are never formed.
    """
    dates = rebalance_dates(scores, keys)
    if members is None:
        members = long_short_members(scores, q, keys=keys, max_group=max_group)
    rows = mark_kept(with_scale(members, adv, threshold, profile), dates, keys).drop("prev", "_was")
    every = [*keys, *(variants or {})]
    for name, values in (variants or {}).items():
        each = F.explode(F.array(*map(F.lit, values)))
        rows, dates = rows.withColumn(name, each), dates.withColumn(name, each)
    on = [*[k for k in every if k in returns.columns], "date", "symbol"]
    rows = rows.join(returns.select(*on, "ret"), on, "left")
    ret = F.coalesce("ret", F.lit(0.0))
    aggs = []
    for side in ("LONG", "SHORT"):
        mine = F.col("side") == side
        aggs += [
            F.sum(F.when(mine, F.col("scale"))).alias(f"{side}_s"),
            F.sum(F.when(mine, F.col("scale") * ret)).alias(f"{side}_sr"),
            F.avg(F.when(mine, ret)).alias(f"{side}_avg"),
            F.count_if(mine).alias(f"{side}_n"),
            F.count_if(mine & F.col("kept")).alias(f"{side}_kept"),
        ]
    weekly = dates.join(rows.groupBy(*every, "date").agg(*aggs), [*every, "date"], "left")
    w = Window.partitionBy(*every).orderBy("date")

    def basket(side):
        scaled = F.col(f"{side}_sr") / F.col(f"{side}_s")
        return F.coalesce(F.when(F.col(f"{side}_s") > 0, scaled).otherwise(F.col(f"{side}_avg")), F.lit(0.0))

    def changed(side):
        n = F.coalesce(f"{side}_n", F.lit(0))
        return 1 - F.coalesce(f"{side}_kept", F.lit(0)) / F.greatest(n, F.lit(1))

    held = F.coalesce(F.col("LONG_n") + F.col("SHORT_n"), F.lit(0))
    out = weekly.withColumns({"long_return": basket("LONG"), "short_return": basket("SHORT"), "_held": held})
    turnover = F.when(
        F.coalesce(F.lag("_held").over(w), F.lit(0)) > 0, (changed("LONG") + changed("SHORT")) / 2
    ).otherwise(F.lit(1.0))
    out = out.withColumn("turnover", turnover).withColumn(
        "ls_return", F.col("long_return") - F.col("short_return")
    )
    return out.withColumn("ls_return_net", net_of_cost(F.lit(float(cost_bps)))).select(
        *every, "date", "long_return", "short_return", "ls_return", "ls_return_net", "turnover"
    )


def net_of_cost(bps):
    """Gross return less two sides of turnover at ``bps`` per side."""
    return F.col("ls_return") - F.col("turnover") * (bps / 10_000) * 2


def reprice(portfolio: DataFrame, costs_bps: Sequence[float]) -> DataFrame:
    """The same portfolio net of each cost in a short list."""
    costs = F.explode(F.array(*[F.lit(float(c)) for c in costs_bps]))
    out = portfolio.withColumn("cost_bps", costs)
    return out.withColumn("ls_return_net", net_of_cost(F.col("cost_bps")))


def drawdown(rows: DataFrame, ret: str, keys: Sequence[str] = ()) -> DataFrame:
    """Growth and its fall from the running peak; the peak starts at the first week."""
    w = Window.partitionBy(*keys).orderBy("date")
    out = rows.withColumn("growth", ts.growth(F.col(ret), w))
    return out.withColumn("drawdown", F.col("growth") / F.max("growth").over(w) - 1)


def performance(portfolio: DataFrame, keys: Sequence[str] = (), ret: str = "ls_return_net") -> DataFrame:
    """Annualized return, volatility, ratio, drawdown, turnover; one row per key."""
    has_turnover = "turnover" in portfolio.columns
    turnover = F.avg("turnover") if has_turnover else F.lit(None).cast("double")
    out = drawdown(portfolio, ret, keys).groupBy(*keys).agg(
        (F.avg(ret) * WEEKS_PER_YEAR).alias("annualized_return"),
        (F.stddev_samp(ret) * WEEKS_PER_YEAR**0.5).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        turnover.alias("avg_weekly_turnover"),
        F.count(F.lit(1)).alias("num_weeks"),
        (F.product(1 + F.col(ret)) - 1).alias("cumulative_return"),
        F.min("date").alias("date_first"),
        F.max("date").alias("date_last"),
    )
    vol = F.col("annualized_volatility")
    return out.withColumn(
        "information_ratio", F.when(vol > 0, F.col("annualized_return") / vol).otherwise(0.0)
    )


def portfolio_summary(portfolio: DataFrame) -> DataFrame:
    """Headline metrics rounded for reports."""
    p = performance(portfolio)
    places = {"annualized_return": 4, "annualized_volatility": 4, "information_ratio": 3,
              "max_drawdown": 4, "avg_weekly_turnover": 4}
    return p.withColumns({c: F.round(c, d) for c, d in places.items()})


# -- baselines ---------------------------------------------------------------------


def reversal_scores(weekly: DataFrame, profile: DataFrame | None = None, value: str = "R1W",
                    max_group: int | None = None) -> DataFrame:
    """-(R1W - sector mean): last week's loser is expected to win."""
    df = weekly.filter(F.col(value).isNotNull()).select("date", "symbol", value)
    score = F.col(value)
    if profile is not None:
        sectors = profile.select("symbol", "sector")
        df = df.join(sectors, "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
        df = xs.with_stats(df, ["date", "sector"], {"_mean": F.avg(value)}, max_group)
        score = score - F.col("_mean")
    return df.select("date", "symbol", (-score).alias("prediction"))


def filtered_reversal_scores(weekly: DataFrame, revisions: DataFrame, profile: DataFrame | None,
                             value: str = "R1W", max_group: int | None = None) -> DataFrame:
    """Reversal after dropping losers with falling and winners with rising revisions.

    The sector mean is taken over the names that remain.
    """
    df = weekly.filter(F.col(value).isNotNull()).select("date", "symbol", value)
    df = xs.quantile_bins(df, value, 10, name="decile", max_group=max_group)
    df = df.join(revisions.select("date", "symbol", "revision"), ["date", "symbol"], "left")
    bad = ((F.col("decile") == 0) & (F.col("revision") < 0)) | (
        (F.col("decile") == 9) & (F.col("revision") > 0)
    )
    return reversal_scores(df.filter(~F.coalesce(bad, F.lit(False))), profile, value, max_group)


# -- diagnostics --------------------------------------------------------------------


def alpha_decay(bars: DataFrame, cal: DataFrame, scores: DataFrame, lags: Sequence[int],
                signal_day: str = "THU", cap: float | None = 0.3, cost_bps: float = 1.5,
                max_group: int | None = None, **sizing) -> DataFrame:
    """Performance per execution lag, all lags in one job keyed by ``lag``.

    Lag 0 is allowed here only, as the upper end of the curve.
    """
    lag_list = F.array(*map(F.lit, lags))
    shifted = bars.withColumn("lag", F.explode(lag_list))
    weekly = weekly_close(shifted, cal, signal_day, F.col("lag"), keys=("lag",))
    returns = forward_returns(weekly, cal, signal_day, keys=("lag",))
    if cap is not None:
        returns = returns.withColumn("ret", clip(F.col("ret"), cap))
    p = long_short(scores, returns, cost_bps=cost_bps, max_group=max_group,
                   variants={"lag": lags}, **sizing)
    return performance(p, ["lag"])


def matched_weeks(portfolio: DataFrame, series: str = "model") -> DataFrame:
    """Rows on dates every series has; one small row per (series, date) throughout."""
    from crosspanel.operators.joins import common_keys

    dates = common_keys(portfolio, "date", series)
    return portfolio.join(F.broadcast(dates), "date", "left_semi")


def common_start(portfolio: DataFrame, series: str = "model", ret: str = "ls_return_net") -> DataFrame:
    """Growth of every series from the latest first date on."""
    firsts = portfolio.groupBy(series).agg(F.min("date").alias("first"))
    start = firsts.agg(F.max("first")).scalar()
    return drawdown(portfolio.filter(F.col("date") >= start), ret, [series])
