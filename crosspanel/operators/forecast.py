"""Forecast tables, named picks, their evaluation and the live track record.

Every function works on all forecasts at once: (as_of_date, target_date) are columns,
not files to loop over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators.joins import first_after, session_on_or_before
from crosspanel.operators.universe import is_preferred
from crosspanel.session import stage

LEDGER_KEY = ["signal_day", "target_date", "scope", "side", "rank"]


def forecast_table(scores: DataFrame, eligible: DataFrame, profile: DataFrame,
                   trade_dates: DataFrame, signal_day: str = "THU", retrain_weeks: int = 12,
                   max_group: int | None = None, ranked: bool = True) -> DataFrame:
    """One row per (as_of_date, symbol) with score, eligibility, dates and region rank.

    An absent eligibility cell is ineligible.  ``region_rank`` counts eligible names only; the
    sort that it takes can be left out (``ranked``) where nothing reads it.
    """
    flags = eligible.select("date", "symbol", "eligible")
    df = scores.join(flags, ["date", "symbol"], "left").join(
        profile.select("symbol", "region", "industry"), "symbol", "left"
    )
    first = scores.agg(F.min("date")).scalar()
    block = F.pmod(F.floor(F.datediff("date", first) / 7), F.lit(retrain_weeks))
    df = df.select(
        F.lit(signal_day).alias("signal_day"),
        F.lit(signal_day).alias("model_signal_day"),
        F.col("date").alias("as_of_date"),
        F.date_add("date", 7).alias("target_date"),
        F.date_sub("date", (block * 7).cast("int")).alias("bundle_retrain_date"),
        "symbol", "prediction",
        F.coalesce("eligible", F.lit(False)).alias("eligible"),
        F.coalesce("region", F.lit("?")).alias("region"),
        F.coalesce("industry", F.lit("?")).alias("industry"),
    )
    days = trade_dates.select("region", F.col("nominal").alias("target_date"), "trade_date")
    df = df.join(days, ["region", "target_date"], "left").withColumn(
        "target_trade_date", F.coalesce("trade_date", "target_date")
    ).drop("trade_date")
    if not ranked:
        return df
    with_rank = xs.rank_first(
        df.filter("eligible"), "prediction", by=["as_of_date", "region"], descending=True,
        name="region_rank", count="_n", max_group=max_group,
    ).drop("_n")
    rest = df.filter("not eligible").withColumn("region_rank", F.lit(None).cast("int"))
    return with_rank.unionByName(rest)


def target_eligibility(eligible: DataFrame, codes: DataFrame, as_of: Column) -> DataFrame:
    """Eligibility at the last bin not after ``as_of``, preferred lines excluded."""
    last = eligible.filter(F.col("date") <= as_of).agg(F.max("date")).scalar()
    df = eligible.filter(F.col("date") == last).join(codes, "symbol", "left")
    ok = F.col("eligible") & ~F.coalesce(is_preferred(F.col("code")), F.lit(False))
    return df.withColumn("eligible", ok)


def region_extremes(forecast: DataFrame, n: int) -> DataFrame:
    """Top and bottom n eligible names per region; the two sides may overlap when thin."""
    return xs.top_and_bottom(forecast.filter("eligible"), n, by=["as_of_date", "region"])


def capped_extremes(rows: DataFrame, n: int, by: Sequence[str], halve: bool = True) -> DataFrame:
    """Top and bottom k = min(n, size // 2) rows, so that the sides never overlap."""
    picked = xs.top_and_bottom(rows, n, by=by)
    sizes = rows.groupBy(*by).agg(F.count("prediction").alias("_size"))
    k = F.floor(F.col("_size") / 2) if halve else F.col("_size")
    return picked.join(sizes, list(by)).filter(F.col("rank") <= k).drop("_size")


def extract_picks(forecast: DataFrame, n: int = 10) -> DataFrame:
    """Ledger rows per region and pooled; each eligible name enters two scopes."""
    scoped = forecast.filter("eligible").withColumn(
        "scope", F.explode(F.array("region", F.lit("ALL")))
    )
    picks = capped_extremes(scoped, n, ["signal_day", "target_date", "scope"])
    return picks.select(
        "signal_day", "as_of_date", "target_date", "scope", "side", "rank", "symbol",
        "industry", "prediction", "bundle_retrain_date",
    )


def select_names(forecast: DataFrame, top_n: int, sides: Sequence[str] = ("LONG", "SHORT"),
                 regions: Sequence[str] | None = None, max_top_n: int = 20) -> DataFrame:
    """Names to research.  With one side only, the whole region may be taken."""
    if not 1 <= top_n <= max_top_n:
        raise ValueError(f"top_n must be in 1..{max_top_n}, got {top_n}")
    rows = forecast.filter("eligible")
    if regions is not None:
        rows = rows.filter(F.col("region").isin(list(regions)))
    out = capped_extremes(rows, top_n, ["as_of_date", "region"], halve=len(sides) > 1)
    return out.filter(F.col("side").isin(list(sides)))


# -- evaluation -------------------------------------------------------------------


def closes_at(grid: DataFrame, cal: DataFrame, labels: DataFrame, max_stale: int = 5) -> DataFrame:
    """(symbol, label, px): last close within ``max_stale`` panel rows up to each label.

    Labels are one row per week, bounded by history, and are broadcast.
    """
    days = session_on_or_before(labels.select("date").distinct(), cal)
    days = days.select(F.col("date").alias("label"), F.col("session").alias("date"))
    live = grid.filter(F.col("age") < max_stale).select("symbol", "date", "px")
    return live.join(F.broadcast(days), "date").drop("date")


def evaluate_picks(picks: DataFrame, grid: DataFrame, cal: DataFrame) -> DataFrame:
    """Realized close-to-close return per pick, once the panel spans both dates."""
    labels = picks.select(F.explode(F.array("as_of_date", "target_date")).alias("date"))
    px = closes_at(grid, cal, labels)
    start = px.select("symbol", F.col("label").alias("as_of_date"), F.col("px").alias("_a"))
    end = px.select("symbol", F.col("label").alias("target_date"), F.col("px").alias("_b"))
    out = picks.join(start, ["symbol", "as_of_date"], "left").join(
        end, ["symbol", "target_date"], "left"
    )
    lo, hi = cal.agg(F.min("date")).scalar(), cal.agg(F.max("date")).scalar()
    spans = (hi >= F.col("target_date")) & (lo <= F.col("as_of_date"))
    out = out.withColumn("realized_ret", F.when(spans, ts.ratio(F.col("_b"), F.col("_a")) - 1))
    r = F.col("realized_ret")
    signed = F.when(F.col("side") == "LONG", r).otherwise(-r)
    return out.withColumns(
        {
            "signed_ret": signed,
            "correct": F.when(r.isNotNull(), (signed > 0).cast("int")),
            "evaluable": r.isNotNull().cast("int"),
        }
    ).drop("_a", "_b")


def evaluate_forecasts(forecast: DataFrame, bars: DataFrame, cal: DataFrame, n: int = 10,
                       signal_day: str = "THU") -> tuple[DataFrame, DataFrame]:
    """Basket returns per (target_date, scope), and one status row per forecast.

    Plain returns need closes on both exact dates; lagged ones enter at each name's first
    close after the signal and leave at its first close after the target.  A scope needs
    2n eligible names.  Baskets hold n names a side, so they are picked first, and only the bars
    of names picked in some week are looked through.
    """
    dates = forecast.select("signal_day", "as_of_date", "target_date").distinct()
    known = lambda name: cal.select(F.col("date").alias(name), F.lit(True).alias(f"_{name}"))
    status = dates.join(F.broadcast(known("as_of_date")), "as_of_date", "left").join(
        F.broadcast(known("target_date")), "target_date", "left"
    )
    reason = F.when(F.col("_target_date").isNull(), "target close not yet in cache").when(
        F.col("_as_of_date").isNull(), "as-of close missing from cache"
    )
    status = status.withColumn("reason", reason).withColumn(
        "evaluable", F.col("reason").isNull()
    ).drop("_as_of_date", "_target_date")

    rows = forecast.join(F.broadcast(status.filter("evaluable").select("as_of_date")), "as_of_date", "left_semi")
    scoped = rows.filter("eligible").withColumn("scope", F.explode(F.array("region", F.lit("ALL"))))
    by = ["signal_day", "as_of_date", "target_date", "scope"]
    sizes = scoped.groupBy(*by).agg(F.count(F.lit(1)).alias("n_eligible"))
    picked = stage(xs.top_and_bottom(scoped, n, by=by).join(sizes, by).filter(F.col("n_eligible") >= 2 * n))
    own = bars.join(picked.select("symbol").distinct(), "symbol", "left_semi")
    baskets = with_returns(picked, own, signal_day).groupBy(*by).agg(
        F.first("n_eligible").alias("n_eligible"), *basket_metrics("ret", ""), *basket_metrics("ret_lag", "_lag")
    )
    baskets = baskets.withColumns(
        {
            f"ls_ret{s}": F.col(f"long_ret{s}") - F.col(f"short_ret{s}") for s in ("", "_lag")
        }
    )
    traded = with_returns(rows, bars, signal_day).filter("ret_lag is not null")
    used = modal(traded, ["target_date"], "entry_date").join(
        modal(traded, ["target_date"], "exit_date"), "target_date", "full_outer"
    )
    return baskets, status.join(used, "target_date", "left")


def with_returns(rows: DataFrame, bars: DataFrame, signal_day: str) -> DataFrame:
    """Adds ret from closes on both exact dates, and ret_lag from entry_date to exit_date."""
    close = lambda day, px: bars.select(
        "symbol", F.col("date").alias(day), F.col("close").alias(px)
    )
    after = first_after(bars, signal_day)
    entry = lambda day, px, on: after.select(
        "symbol", F.col("label").alias(day), F.col("entry_close").alias(px),
        F.col("entry_date").alias(on),
    )
    return (
        rows.join(close("as_of_date", "_a"), ["symbol", "as_of_date"], "left")
        .join(close("target_date", "_b"), ["symbol", "target_date"], "left")
        .join(entry("as_of_date", "_ea", "entry_date"), ["symbol", "as_of_date"], "left")
        .join(entry("target_date", "_eb", "exit_date"), ["symbol", "target_date"], "left")
        .withColumn("ret", ts.ratio(F.col("_b"), F.col("_a")) - 1)
        .withColumn("ret_lag", ts.ratio(F.col("_eb"), F.col("_ea")) - 1)
    )


def basket_metrics(ret: str, suffix: str) -> list[Column]:
    r, is_long = F.col(ret), F.col("side") == "LONG"
    hits = F.count_if((is_long & (r > 0)) | (~is_long & (r < 0)))
    return [
        F.avg(F.when(is_long, r)).alias(f"long_ret{suffix}"),
        F.avg(F.when(~is_long, r)).alias(f"short_ret{suffix}"),
        F.try_divide(hits.cast("double"), F.count(r)).alias(f"hit_rate{suffix}"),
    ]


def modal(rows: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties, from counted values."""
    counts = rows.groupBy(*by, col).count()
    return counts.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("count"), col)).alias(col))


def track_wide(baskets: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """One row per forecast with {scope}_{metric} columns."""
    metrics = ["ls_ret", "ls_ret_lag", "hit_rate"]
    aggs = [
        F.max(F.when(F.col("scope") == s, F.col(m))).alias(f"{s}_{m}".replace(" ", "_"))
        for s in scopes for m in metrics
    ]
    return baskets.groupBy("signal_day", "as_of_date", "target_date").agg(*aggs)


# -- track record -------------------------------------------------------------------


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Hit rate and mean signed return per scope over resolved picks."""
    return ledger.filter("evaluable = 1").groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("signed_ret") > 0).cast("double")).alias("hit_rate"),
        F.avg("signed_ret").alias("mean_signed_ret"),
    )


def weekly_performance(ledger: DataFrame) -> DataFrame:
    """Equal-weight basket result and single-name hits per (week, scope)."""
    is_long = F.col("side") == "LONG"
    out = ledger.filter("evaluable = 1").groupBy("signal_day", "target_date", "scope").agg(
        F.min("as_of_date").alias("as_of_date"),
        F.count_if(is_long).alias("n_long"),
        F.count_if(~is_long).alias("n_short"),
        F.avg(F.when(is_long, F.col("realized_ret"))).alias("long_ret"),
        F.avg(F.when(~is_long, F.col("realized_ret"))).alias("short_ret"),
        F.count(F.lit(1)).alias("n_picks"),
        F.count_if(F.col("signed_ret") > 0).alias("n_correct"),
        F.min("bundle_retrain_date").alias("bundle_retrain_date"),
    )
    ls = F.col("long_ret") - F.col("short_ret")
    return out.withColumns(
        {
            "ls_ret": ls,
            "ls_positive": F.when(ls.isNotNull(), (ls > 0).cast("int")),
            "single_stock_hit_rate": F.col("n_correct") / F.col("n_picks"),
        }
    )


def live_summary(weekly: DataFrame) -> DataFrame:
    """Per (signal day, scope): weeks, mean and compounded result, both hit rates."""
    return weekly.groupBy("signal_day", "scope").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.avg("ls_ret").alias("mean_ls"),
        (F.product(1 + F.coalesce("ls_ret", F.lit(0.0))) - 1).alias("cum_ls"),
        F.avg(F.coalesce(F.col("ls_positive") == 1, F.lit(False)).cast("double")).alias("portfolio_hit"),
        F.try_divide(F.sum("n_correct").cast("double"), F.sum("n_picks")).alias("single_stock_hit"),
    )


def track_summary(baskets: DataFrame) -> DataFrame:
    """Per scope: resolved forecasts, mean and compounded result on both bases."""
    return baskets.filter("ls_ret is not null").groupBy("scope").agg(
        F.count(F.lit(1)).alias("forecasts"),
        F.avg("ls_ret").alias("mean_ls"),
        (F.product(1 + F.col("ls_ret")) - 1).alias("cum_ls"),
        F.avg("ls_ret_lag").alias("mean_ls_lag"),
        (F.product(1 + F.col("ls_ret_lag")) - 1).alias("cum_ls_lag"),
        F.avg("hit_rate").alias("mean_hit_rate"),
    )


def holiday_shifts(forecast: DataFrame) -> DataFrame:
    """Regions whose trade date differs from the target date."""
    moved = F.col("target_trade_date") != F.col("target_date")
    return forecast.filter(moved).select("region", "target_date", "target_trade_date").distinct()
