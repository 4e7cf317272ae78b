"""Price, market-relative, rating and macro factors as columns on the dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts

HALF_YEAR, YEAR = 126, 252
ANNUAL = 252.0 ** 0.5

MOMENTUM = {"R1M": (21, 0), "R3M1M": (63, 21), "R6M1M": (126, 21), "R12M1M": (252, 21)}
RESIDUAL_PERIODS = (5, 21, 63, 252)

PRICE_FACTORS = [
    "R1W", "RSI5D", "RSI14", "RSI30", *MOMENTUM, "VOL6M", "VOL12M", "DOWNVOL6M",
]
MARKET_FACTORS = [
    "BETA6M", "BETA12M", "IREV1W", "IREV1M", "IVOL6M", "IVOL12M", "IMOM12M1M", "IMOM3M1M",
    "IMOMVOL12M1M", "IMOMVOL3M1M", "IREVVOL1W", "IREVVOL1M",
]


# -- price only -------------------------------------------------------------------


def r1w(grid: DataFrame) -> DataFrame:
    return grid.withColumn("R1W", ts.change("px", 5))


def momentum(grid: DataFrame) -> DataFrame:
    """Return from ``lookback`` to ``skip`` rows ago, on closes that are not carried."""
    w = ts.by_symbol()
    return grid.withColumns(
        {
            name: ts.ratio(F.lag("close", skip).over(w), F.lag("close", look).over(w)) - 1
            for name, (look, skip) in MOMENTUM.items()
        }
    )


def rsi(grid: DataFrame, spans: dict[str, int] | None = None) -> DataFrame:
    """100 - 100 / (1 + gain / loss) on exponential means of daily moves.

    A move needs a close on both rows; rows without one still age the weights.
    """
    spans = spans or {"RSI5D": 5, "RSI14": 14, "RSI30": 30}
    move = F.col("close") - F.lag("close", 1).over(ts.by_symbol())
    out = grid.withColumn("_move", move)
    out = out.withColumns(
        {
            "_gain": F.greatest(F.col("_move"), F.lit(0.0)),
            "_loss": F.greatest(-F.col("_move"), F.lit(0.0)),
        }
    )
    # greatest() skips nulls, so restore them.
    out = out.withColumns(
        {c: F.when(F.col("_move").isNotNull(), F.col(c)) for c in ("_gain", "_loss")}
    )
    out = ts.ewm_means(out, ["_gain", "_loss"], list(spans.values()))
    strength = {
        name: 100 - 100 / (1 + ts.ratio(F.col(f"_gain_ew{n}"), F.col(f"_loss_ew{n}")))
        for name, n in spans.items()
    }
    used = [f"_{k}_ew{n}" for k in ("gain", "loss") for n in spans.values()]
    return out.withColumns(strength).drop("_move", "_gain", "_loss", *used)


# -- market and macro series --------------------------------------------------------


def series_on_calendar(cal: DataFrame, series: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Align date-keyed columns to the calendar and carry values forward.

    One row per day of history, so the single-partition window stays small.
    """
    w = Window.orderBy("t")
    joined = cal.select("date", "t").join(series, "date", "left")
    return joined.select(
        "date", "t", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols]
    )


def series_moments(aligned: DataFrame, col: str, windows: Sequence[int]) -> DataFrame:
    """Daily return of a series and its trailing mean and sample variance per window."""
    w = Window.orderBy("t")
    out = aligned.withColumn(f"{col}_ret", ts.change(col, 1, w))
    r = F.col(f"{col}_ret")
    return out.withColumns(
        {f"{col}_mean{n}": ts.rolling(F.avg, r, n, window=w) for n in windows}
        | {f"{col}_var{n}": ts.rolling(F.var_samp, r, n, window=w) for n in windows}
    )


def market_series(cal: DataFrame, market: DataFrame) -> DataFrame:
    aligned = series_on_calendar(cal, market, ["mkt_close"])
    out = series_moments(aligned, "mkt_close", (HALF_YEAR, YEAR))
    w = Window.orderBy("t")
    return out.withColumns(
        {f"mkt_ret{n}": ts.change("mkt_close", n, w) for n in RESIDUAL_PERIODS}
    )


def macro_wide(macro: DataFrame, names: dict[str, str]) -> DataFrame:
    """Long (date, series, value) to one row per date with the named columns."""
    return macro.groupBy("date").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(n) for s, n in names.items()]
    )


def _beta(n, sx, sxy, rows: int, y_mean: Column, y_var: Column) -> Column:
    """Population covariance over sample variance, once ``rows`` returns exist."""
    cov = sxy / rows - (sx / rows) * y_mean
    return F.when(n >= rows, ts.ratio(cov, y_var))


def risk_factors(grid: DataFrame, market: DataFrame, full: bool = True,
                 min_negative: int = HALF_YEAR // 2) -> DataFrame:
    """Volatility, beta, residual and risk-scaled factors against a market series.

    ``market`` is the output of :func:`market_series`.  Every rolling moment is a moving
    sum over 126 rows, and the 252-row ones are two of those.
    """
    h, y = HALF_YEAR, YEAR
    out = grid.join(F.broadcast(market.drop("date")), "t")
    out = out.withColumn("ret", ts.change("px", 1))
    r, m = F.col("ret"), F.col("mkt_close_ret")
    neg = F.when(r < 0, r)
    one = F.lit(1.0)
    out = ts.moving_sums(
        out,
        {
            "n": F.when(r.isNotNull(), one), "s": r, "ss": r * r, "sm": r * m,
            "dn": F.when(neg.isNotNull(), one), "ds": neg, "dss": neg * neg,
        },
        h,
    )
    out = out.withColumns({f"{c}2": ts.doubled(c, h) for c in ("n", "s", "ss", "sm")})
    c = F.col
    out = out.withColumns(
        {
            "VOL6M": F.when(
                c("n") >= h // 2, F.sqrt(ts.sample_variance(c("n"), c("s"), c("ss"))) * ANNUAL
            ),
            "VOL12M": F.when(
                c("n2") >= y // 2, F.sqrt(ts.sample_variance(c("n2"), c("s2"), c("ss2"))) * ANNUAL
            ),
            "DOWNVOL6M": F.when(
                c("dn") >= min_negative, F.sqrt(ts.sample_variance(c("dn"), c("ds"), c("dss"))) * ANNUAL
            ),
            "BETA6M": _beta(c("n"), c("s"), c("sm"), h, c(f"mkt_close_mean{h}"),
                            c(f"mkt_close_var{h}")),
            "BETA12M": _beta(c("n2"), c("s2"), c("sm2"), y, c(f"mkt_close_mean{y}"),
                             c(f"mkt_close_var{y}")),
        }
    ).drop("n", "s", "ss", "sm", "n2", "s2", "ss2", "sm2", "dn", "ds", "dss")
    if not full:
        return out
    # Before beta exists the residual is the raw return.
    sums = {}
    for k, beta in (("6", "BETA6M"), ("12", "BETA12M")):
        res = F.coalesce(r - c(beta) * m, r)
        sums |= {f"n{k}": F.when(res.isNotNull(), one), f"s{k}": res, f"ss{k}": res * res}
    out = ts.moving_sums(out, sums, h)
    out = out.withColumns({k: ts.doubled(k, h) for k in ("n12", "s12", "ss12")})
    for name, k, need in (("IVOL6M", "6", h // 2), ("IVOL12M", "12", y // 2)):
        var = ts.sample_variance(c(f"n{k}"), c(f"s{k}"), c(f"ss{k}"))
        out = out.withColumn(name, F.when(c(f"n{k}") >= need, F.sqrt(var) * ANNUAL))
    out = out.drop(*sums)
    out = out.withColumns(
        {f"res{p}": ts.change("px", p) - c("BETA6M") * c(f"mkt_ret{p}") for p in RESIDUAL_PERIODS}
    )
    lag21 = lambda col: F.lag(col, 21).over(ts.by_symbol())
    out = out.withColumns(
        {
            "IREV1W": c("res5"),
            "IREV1M": c("res21"),
            "IMOM12M1M": lag21("res252"),
            "IMOM3M1M": lag21("res63"),
        }
    )
    out = out.withColumns(
        {
            "IMOMVOL12M1M": ts.ratio(c("IMOM12M1M"), c("IVOL12M")),
            "IMOMVOL3M1M": ts.ratio(c("IMOM3M1M"), c("IVOL6M")),
            "IREVVOL1W": ts.ratio(c("IREV1W"), c("IVOL6M")),
            "IREVVOL1M": ts.ratio(c("IREV1M"), c("IVOL6M")),
        }
    )
    return out.drop(*[f"res{p}" for p in RESIDUAL_PERIODS])


def series_sensitivity(grid: DataFrame, aligned: DataFrame, names: Sequence[str],
                       rows: int = HALF_YEAR, corr: bool = False) -> DataFrame:
    """Rolling beta (or correlation) of each symbol against several date series.

    All series share one pass: one moving sum per product, one broadcast of day rows.
    """
    wide = aligned
    for s in names:
        wide = series_moments(wide, s, (rows,))
    out = grid.join(F.broadcast(wide.drop("date")), "t").withColumn("ret", ts.change("px", 1))
    r, one = F.col("ret"), F.lit(1.0)
    sums = {"n": F.when(r.isNotNull(), one), "s": r, "ss": r * r}
    sums |= {f"s_{s}": r * F.col(f"{s}_ret") for s in names}
    sums |= {f"n_{s}": F.when((r * F.col(f"{s}_ret")).isNotNull(), one) for s in names}
    out = ts.moving_sums(out, sums, rows)
    result = {}
    for s in names:
        full = F.least(F.col("n"), F.col(f"n_{s}"))
        y_mean, y_var = F.col(f"{s}_mean{rows}"), F.col(f"{s}_var{rows}")
        if corr:
            x_var = ts.sample_variance(F.col("n"), F.col("s"), F.col("ss"))
            result[f"CORR_{s}"] = _beta(
                full, F.col("s"), F.col(f"s_{s}"), rows, y_mean, F.sqrt(x_var * y_var)
            )
        else:
            result[f"BETA_{s}"] = _beta(full, F.col("s"), F.col(f"s_{s}"), rows, y_mean, y_var)
    return out.withColumns(result).drop(*sums)


def macro_zscore(aligned: DataFrame, names: Sequence[str], rows: int = HALF_YEAR) -> DataFrame:
    w = Window.orderBy("t")
    z = {}
    for s in names:
        x = F.col(s)
        mean = ts.rolling(F.avg, x, rows, rows // 2, w)
        std = ts.rolling(F.stddev_samp, x, rows, rows // 2, w)
        z[f"{s}_Z"] = ts.ratio(x - mean, std)
    return aligned.withColumns(z)


def regime_flags(aligned: DataFrame, names: Sequence[str], rows: int = HALF_YEAR,
                 threshold: float = 1.0) -> DataFrame:
    """1.0 where the z-score exceeds the threshold / the level exceeds its median, else 0.0."""
    medians = {f"_{s}_MED": s for s in names}
    out = ts.rolling_medians(macro_zscore(aligned, names, rows), medians, rows, rows // 2, by=())
    flags = {}
    for s in names:
        hi, up = F.col(f"{s}_Z") > threshold, F.col(s) > F.col(f"_{s}_MED")
        flags[f"{s}_HI"] = F.coalesce(hi, F.lit(False)).cast("double")
        flags[f"{s}_TREND_UP"] = F.coalesce(up, F.lit(False)).cast("double")
    return out.withColumns(flags).drop(*[f"{s}_Z" for s in names], *medians)


def raw_moves(aligned: DataFrame, returns: Sequence[str] = (), changes: Sequence[str] = (),
              n: int = 5) -> DataFrame:
    w = Window.orderBy("t")
    cols = {f"{s}_R{n}": ts.change(s, n, w) for s in returns}
    cols |= {f"{s}_D{n}": F.col(s) - F.lag(s, n).over(w) for s in changes}
    return aligned.withColumns(cols)


# -- rating events ---------------------------------------------------------------


def action_counts(events: DataFrame) -> DataFrame:
    """Ups less downs and all actions per symbol and day."""
    direction = F.when(F.lower("action") == "upgrade", 1).when(
        F.lower("action") == "downgrade", -1
    ).otherwise(0)
    return events.groupBy("symbol", "date").agg(
        F.sum(direction).alias("net"), F.count(F.lit(1)).alias("total")
    )


def rating_balance(events: DataFrame, days: DataFrame) -> DataFrame:
    """(ups - downs) / all actions over 7 calendar days, 0 where there were none.

    Actions are counted per (symbol, day) first; the grid then holds one row per symbol
    and calendar day from the symbol's first event on.
    """
    counts = action_counts(events)
    grid = ts.dense_grid(
        counts.select("symbol", "date", F.lit(None).cast("double").alias("close"),
                      F.lit(None).cast("double").alias("volume"), "net", "total"),
        days,
    )
    week = (
        Window.partitionBy("symbol")
        .orderBy(F.datediff("date", F.to_date(F.lit("1970-01-01"))))
        .rangeBetween(-6, 0)
    )
    return grid.select(
        "symbol",
        "date",
        "t",
        F.coalesce(
            ts.ratio(F.sum("net").over(week).cast("double"), F.sum("total").over(week)),
            F.lit(0.0),
        ).alias("UPDOWN1W_RATINGS"),
    )
