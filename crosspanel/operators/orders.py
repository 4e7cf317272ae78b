"""Order sizing, liquidation rows, book totals and limit-priced reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import xs
from crosspanel.operators.joins import reconcile
from crosspanel.operators.universe import broker_contract, lookup

ORDER_COLUMNS = [
    "symbol", "broker_symbol", "exchange", "currency", "action", "shares", "price", "est_usd",
    "region", "prediction", "order_type",
]


def last_prices(bars: DataFrame) -> DataFrame:
    """Most recent close per symbol; max_by combines map-side."""
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))


def size_orders(book: DataFrame, prices: DataFrame, capital: float, n: int,
                usd_rates: dict[str, float]) -> DataFrame:
    """Equal-weight orders for the n best and n worst eligible names of one forecast.

    ``book`` is (symbol, code, region, prediction).  Notional is split over all names in
    USD and converted, so share counts fit the local price; an unlisted currency counts as
    USD.  Names without a price, or rounding to no shares, are dropped.
    """
    picked = xs.top_and_bottom(book.withColumn("_all", F.lit(1)), n, by=["_all"]).drop("_all")
    count = book.agg(2.0 * F.least(F.count(F.lit(1)), F.lit(n))).scalar()
    df = picked.join(prices, "symbol").withColumn("c", broker_contract(F.col("code")))
    rate = lookup(F.col("c.currency"), usd_rates, F.lit(1.0))
    local = F.lit(float(capital)) / count / rate
    df = df.filter(F.col("price") > 0).withColumn("shares", F.bround(local / F.col("price")).cast("bigint"))
    return df.filter("shares > 0").select(
        "symbol",
        F.col("c.symbol").alias("broker_symbol"), F.col("c.exchange").alias("exchange"),
        F.col("c.currency").alias("currency"),
        F.when(F.col("side") == "LONG", "BUY").otherwise("SELL").alias("action"),
        "shares", "price", (F.col("shares") * F.col("price") * rate).alias("est_usd"),
        "region", "prediction", F.lit("TARGET").alias("order_type"),
    )


def liquidation_rows(positions: DataFrame) -> DataFrame:
    """Closing orders, opposite in sign to each position held."""
    q = F.col("position")
    return positions.filter(q != 0).select(
        "symbol", F.col("symbol").cast("string").alias("broker_symbol"),
        F.lit("SMART").alias("exchange"), F.lit("USD").alias("currency"),
        F.when(q > 0, "SELL").otherwise("BUY").alias("action"),
        F.floor(F.abs(q)).cast("bigint").alias("shares"),
        F.col("market_price").alias("price"), F.abs("market_value").alias("est_usd"),
        F.lit("?").alias("region"), F.lit(None).cast("double").alias("prediction"),
        F.lit("LIQUIDATE").alias("order_type"),
    )


def book_totals(orders: DataFrame) -> DataFrame:
    usd = F.col("est_usd")
    new = F.col("order_type") == "TARGET"
    out = orders.agg(
        F.count_if(new).alias("new_orders"),
        F.count_if(~new).alias("liquidations"),
        F.sum(F.when(new & (F.col("action") == "BUY"), usd)).alias("long_usd"),
        F.sum(F.when(new & (F.col("action") == "SELL"), usd)).alias("short_usd"),
        F.sum(F.when(~new, usd)).alias("liquidated_usd"),
    )
    return out.withColumn("gross_usd", F.col("long_usd") + F.col("short_usd")).withColumn(
        "net_usd", F.col("long_usd") - F.col("short_usd")
    )


def reconcile_plan(target: DataFrame, held: DataFrame, prices: DataFrame, offset_bps: float,
                   passive: bool = False) -> DataFrame:
    """Share deltas with limit prices.

    Marketable limits buy above and sell below the reference; passive ones the reverse.
    A name without a reference price gets no limit.
    """
    plan = reconcile(target, held).join(prices.withColumnRenamed("price", "ref_px"), "symbol", "left")
    toward = F.when(F.col("action") == "BUY", 1.0).otherwise(-1.0) * (-1.0 if passive else 1.0)
    return plan.withColumn("limit_px", F.col("ref_px") * (1 + toward * offset_bps / 1e4))
