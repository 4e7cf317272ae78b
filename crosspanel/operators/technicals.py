"""Technical read per symbol: indicators, verdict, flags, alignment, compact series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts

# Thresholds of the verdict rules.
RSI_HIGH, RSI_LOW = 70.0, 30.0
Z_STRETCHED, Z_DRIFT = 2.0, 0.5
RANGE_HIGH, RANGE_LOW = 0.95, 0.05
VOLUME_SPIKE, GAP_MULTIPLE = 2.0, 1.5
WEEK, MONTH, QUARTER, YEAR = 5, 21, 63, 252

# Verdict -> label shown.
VERDICT_LABELS = {
    "OVERBOUGHT_PULLBACK": "Stretched high — reversal risk",
    "OVERSOLD_BOUNCE": "Stretched low — bounce candidate",
    "UPTREND_PULLBACK": "Dip inside an uptrend",
    "DOWNTREND_RALLY": "Bounce inside a downtrend",
    "UPTREND_INTACT": "Uptrend, no stretch",
    "DOWNTREND_INTACT": "Downtrend, no stretch",
    "RANGEBOUND": "Rangebound / no clear signal",
    "INSUFFICIENT_DATA": "Not enough price history",
}

# Verdict -> the side it agrees with.
FAVOURS = {
    "OVERSOLD_BOUNCE": "LONG", "UPTREND_PULLBACK": "LONG",
    "OVERBOUGHT_PULLBACK": "SHORT", "DOWNTREND_RALLY": "SHORT",
}


def normalize_bars(raw: DataFrame, order: str) -> DataFrame:
    """Numeric columns, one row per (symbol, day) with the latest by ``order``, close present."""
    numeric = [c for c in ("open", "high", "low", "close", "volume", "rsi") if c in raw.columns]
    typed = raw.withColumn("date", F.to_date("date")).withColumns(
        {c: F.col(c).try_cast("double") for c in numeric}
    )
    last = F.max_by(F.struct(*numeric), order).alias("_r")
    return typed.groupBy("symbol", "date").agg(last).select("symbol", "date", "_r.*").dropna(
        subset=["close"]
    )


def indicators(bars: DataFrame, as_of: str | None = None) -> DataFrame:
    """Indicator snapshot on each symbol's last bar.

    Windows run over a symbol's own bars.  All frames share one sort, the last row is kept,
    and each value is null where the history is too short.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    c, ratio = F.col, ts.ratio
    close = c("close")
    df = bars.withColumns(
        {
            "n_bars": F.row_number().over(w),
            "_newest": F.lead("date").over(w).isNull(),
            "_prev": F.lag("close").over(w),
        }
    )
    df = df.withColumns(
        {
            "_tr": F.greatest(
                c("high") - c("low"), F.abs(c("high") - c("_prev")), F.abs(c("low") - c("_prev"))
            ),
            "_lr": F.ln(ratio(close, c("_prev"))),
        }
    )
    back = lambda n: (ratio(close, F.lag("close", n).over(w)) - 1) * 100
    frame = lambda n: w.rowsBetween(-(n - 1), 0)
    gate = lambda n, x: F.when(c("n_bars") >= n, x)
    df = df.withColumns(
        {
            "sma20": ts.rolling(F.avg, close, 20, window=w),
            "sma50": ts.rolling(F.avg, close, 50, window=w),
            "sma200": ts.rolling(F.avg, close, 200, window=w),
            "_sd20": ts.rolling(F.stddev_samp, close, 20, window=w),
            "ret_1w_pct": back(WEEK),
            "ret_1m_pct": back(MONTH),
            "ret_3m_pct": back(QUARTER),
            "range_52w_high": F.max("high").over(frame(YEAR)),
            "range_52w_low": F.min("low").over(frame(YEAR)),
            "_atr": gate(15, F.avg("_tr").over(frame(14))),
            "_sdlr": gate(21, F.stddev_samp("_lr").over(frame(20))),
            "_av": gate(20, F.avg("volume").over(frame(20))),
        }
    )
    if as_of is not None:
        day = F.lit(as_of).cast("date")
        at = F.last(F.when(c("date") <= day, close), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)
        )
        df = df.withColumn("_signal", at)
    last = df.filter("_newest")
    versus = lambda ma: (ratio(close, c(ma)) - 1) * 100
    hi, lo = c("range_52w_high"), c("range_52w_low")
    out = last.withColumns(
        {
            "last_close": close,
            "z20": F.when(c("_sd20") > 0, (close - c("sma20")) / c("_sd20")),
            "px_vs_sma20_pct": versus("sma20"),
            "px_vs_sma50_pct": versus("sma50"),
            "px_vs_sma200_pct": versus("sma200"),
            "pct_of_52w_range": F.when(hi > lo, (close - lo) / (hi - lo)),
            "atr14_pct": ratio(c("_atr"), close) * 100,
            "vol_20d_ann_pct": c("_sdlr") * (YEAR**0.5 * 100),
            "volume_vs_20d_avg": ratio(c("volume"), c("_av")),
            "move_since_signal_pct": (
                (ratio(close, c("_signal")) - 1) * 100 if as_of is not None
                else F.lit(None).cast("double")
            ),
        }
    )
    numbers = [
        "last_close", "sma20", "sma50", "sma200", "z20", "px_vs_sma20_pct", "px_vs_sma50_pct",
        "px_vs_sma200_pct", "ret_1w_pct", "ret_1m_pct", "ret_3m_pct", "range_52w_low",
        "range_52w_high", "pct_of_52w_range", "atr14_pct", "vol_20d_ann_pct",
        "volume_vs_20d_avg", "move_since_signal_pct",
    ]
    rsi = F.round("rsi", 6) if "rsi" in bars.columns else F.lit(None).cast("double")
    return out.select(
        "symbol", c("date").alias("asof"), "n_bars", rsi.alias("rsi14"),
        *[F.round(n, 6).alias(n) for n in numbers],
    ).withColumn("trend", trend())


def trend() -> Column:
    c = F.col
    up = (c("sma20") > c("sma50")) & (c("last_close") > c("sma50"))
    down = (c("sma20") < c("sma50")) & (c("last_close") < c("sma50"))
    return F.when(up, "UP").when(down, "DOWN").otherwise("SIDEWAYS")


def classify(ind: DataFrame) -> DataFrame:
    """Verdict, label and reasons; the first matching rule wins, stretch before trend."""
    c = F.col
    rsi, z, week, tr = c("rsi14"), c("z20"), c("ret_1w_pct"), c("trend")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    hot = yes(rsi >= RSI_HIGH) | yes(z >= Z_STRETCHED)
    cold = yes(rsi <= RSI_LOW) | yes(z <= -Z_STRETCHED)
    rules = [
        (c("n_bars") < 20, "INSUFFICIENT_DATA"),
        (hot & yes(week > 0), "OVERBOUGHT_PULLBACK"),
        (cold & yes(week < 0), "OVERSOLD_BOUNCE"),
        ((tr == "UP") & yes(week < 0) & yes((z > -Z_STRETCHED) & (z <= -Z_DRIFT)), "UPTREND_PULLBACK"),
        ((tr == "DOWN") & yes(week > 0) & yes((z >= Z_DRIFT) & (z < Z_STRETCHED)), "DOWNTREND_RALLY"),
        (tr == "UP", "UPTREND_INTACT"),
        (tr == "DOWN", "DOWNTREND_INTACT"),
    ]
    verdict = F.lit("RANGEBOUND")
    for cond, name in reversed(rules):
        verdict = F.when(cond, name).otherwise(verdict)
    labels = [F.lit(x) for kv in VERDICT_LABELS.items() for x in kv]
    df = ind.withColumn("verdict", verdict)
    df = df.withColumn("verdict_label", F.element_at(F.create_map(*labels), F.col("verdict")))
    return df.withColumn("verdict_reasons", reasons())


def tenths(x: Column) -> Column:
    """``x`` to one digit by its exact binary value, halves to even, as Python and C print it.

    ``format_string`` rounds the shortest decimal: 0.15, in binary just below, would give 0.2.
    """
    eight, two = x * 8, x * 2
    ten = eight + two
    lost = two - (ten - eight)  # 10 x is ten + lost, exactly
    half = ten - F.floor(ten) == 0.5
    whole = F.when(half & (lost > 0), ten + 0.5).when(half & (lost < 0), ten - 0.5)
    return F.coalesce(whole, F.rint(ten)) / 10


def reasons() -> Column:
    c = F.col
    say = lambda text, *x: F.format_string(text, *map(tenths, x))
    rsi, z, week, v = c("rsi14"), c("z20"), c("ret_1w_pct"), c("verdict")
    sigma = lambda where: say(f"%.1fσ {where} SMA20", F.abs(z))
    note = F.when(z.isNull(), "distance from SMA20 unavailable").when(
        z >= 0, sigma("above")
    ).otherwise(sigma("below"))
    up_line, down_line = F.lit("SMA20 above SMA50 (uptrend)"), F.lit("SMA20 below SMA50 (downtrend)")
    lists = {
        "OVERBOUGHT_PULLBACK": [
            F.when(rsi >= RSI_HIGH, say("RSI14 %.1f ≥ 70", rsi)),
            F.when(z >= Z_STRETCHED, say("close %.1fσ above SMA20", F.abs(z))),
            say("up %.1f%% over the last week", week),
        ],
        "OVERSOLD_BOUNCE": [
            F.when(rsi <= RSI_LOW, say("RSI14 %.1f ≤ 30", rsi)),
            F.when(z <= -Z_STRETCHED, say("close %.1fσ below SMA20", F.abs(z))),
            say("down %.1f%% over the last week", F.abs(week)),
        ],
        "UPTREND_PULLBACK": [
            up_line, say("pulled back %.1f%% this week", F.abs(week)), sigma("below"),
        ],
        "DOWNTREND_RALLY": [down_line, say("rallied %.1f%% this week", week), sigma("above")],
        "UPTREND_INTACT": [up_line, note, F.lit("no stretch or pullback signal")],
        "DOWNTREND_INTACT": [down_line, note, F.lit("no stretch or bounce signal")],
        "RANGEBOUND": [
            F.lit("SMA20 and SMA50 not separated (no trend)"), note,
            F.when(rsi.isNull(), "RSI unavailable").otherwise(say("RSI14 %.1f", rsi)),
        ],
    }
    chosen = F.array(F.format_string("only %d daily bars available (need 20)", c("n_bars")))
    for name, parts in lists.items():
        place = F.when(
            c("pct_of_52w_range").isNotNull(),
            F.format_string("%.0f%% of the 52-week range", F.rint(c("pct_of_52w_range") * 100)),
        )
        chosen = F.when(v == name, F.array_compact(F.array(*parts, place))).otherwise(chosen)
    return chosen


def flags() -> Column:
    c = F.col
    pr, move, vol = c("pct_of_52w_range"), c("move_since_signal_pct"), c("vol_20d_ann_pct")
    weekly = vol / 52.0**0.5
    return F.array_compact(
        F.array(
            F.when(pr >= RANGE_HIGH, "at_52w_high").when(pr <= RANGE_LOW, "at_52w_low"),
            F.when(c("volume_vs_20d_avg") >= VOLUME_SPIKE, "volume_spike"),
            F.when((weekly > 0) & (F.abs(move) >= GAP_MULTIPLE * weekly), "gapped_since_signal"),
        )
    )


def alignment(side: Column, verdict: Column) -> Column:
    """aligned / conflict where the verdict favours a side, else neutral."""
    pairs = [F.lit(x) for kv in FAVOURS.items() for x in kv]
    good = F.try_element_at(F.create_map(*pairs), verdict)
    s = F.upper(F.coalesce(side, F.lit("")))
    return F.when(good.isNull() | ~s.isin("LONG", "SHORT"), "neutral").when(
        good == s, "aligned"
    ).otherwise("conflict")


def risk_wording(side: Column, align: Column) -> Column:
    return (
        F.when((align == "conflict") & (F.upper(side) == "LONG"), "⚠️ pullback risk")
        .when(align == "conflict", "⚠️ bounce risk")
        .when(align == "aligned", "✅ reversion in our favour")
        .otherwise("· neutral")
    )


def compact_series(bars: DataFrame, days: int = YEAR) -> DataFrame:
    """The last ``days`` bars per symbol as parallel arrays of dates, closes and RSI.

    row_number() <= days is applied before the shuffle, so arrays are at most that long.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    tail = bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= days)
    cols = ["date", "close"] + (["rsi"] if "rsi" in bars.columns else [])
    rows = F.array_sort(F.collect_list(F.struct(*cols)))
    out = tail.groupBy("symbol").agg(rows.alias("_s"))
    picks = [
        F.transform("_s", lambda s: F.date_format(s["date"], "yyyy-MM-dd")).alias("dates"),
        F.transform("_s", lambda s: F.round(s["close"], 4)).alias("close"),
    ]
    if "rsi" in cols:
        picks.append(F.transform("_s", lambda s: F.round(s["rsi"], 1)).alias("rsi"))
    return out.select("symbol", *picks)


def series_rows(series: DataFrame, cols: Sequence[str] = ("close",)) -> DataFrame:
    """Inverse of :func:`compact_series`."""
    zipped = F.explode(F.arrays_zip("dates", *cols)).alias("z")
    return series.select("symbol", zipped).select(
        "symbol", F.to_date("z.dates").alias("date"), *[F.col(f"z.{c}").alias(c) for c in cols]
    )


def technical_read(bars: DataFrame, sides: DataFrame, as_of: str | None = None) -> DataFrame:
    """Indicators, verdict, flags and alignment for (symbol, side) rows."""
    read = classify(indicators(bars, as_of)).withColumn("flags", flags())
    return sides.join(read, "symbol").withColumn(
        "alignment", alignment(F.col("side"), F.col("verdict"))
    )
