"""Panel inputs derived from the sample star schema.

``symbol`` is the supplier key; prices, statements, macro series, rating events and
membership intervals are aggregates of the base tables.  Every aggregate is grouped on
its full output key, so partial aggregation collapses a hot supplier or day map-side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.session import stage


def weekday_only(day: Column) -> Column:
    """True Monday to Friday."""
    return F.weekday(day) < 5


class Tables:
    """Lazy views over one folder of base tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._staged: dict[str, DataFrame] = {}

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A pipeline result that several later steps read, written once."""
        if name not in self._staged:
            self._staged[name] = stage(build())
        return self._staged[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def n_symbols(self) -> int:
        """Row count of the entity table, answered from the Parquet footers.

        (date, symbol) is unique in every panel, so this bounds the size of any
        per-date cross-section; operators choose their plan by it.
        """
        return self.read("supplier").count()

    def size_shuffles(self) -> None:
        """Start shuffles with enough partitions for the entity table; adaptive execution merges
        small ones again.  Never lowers what the session has."""
        key, conf = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", self.spark.conf
        least = int(conf.get(key, None) or conf.get("spark.sql.shuffle.partitions"))
        wanted = ts.tasks_for(self.spark, self.n_symbols)
        if wanted > least:
            conf.set(key, str(wanted))

    @cached_property
    def n_weeks(self) -> int:
        """Weeks between the first and last trading day, both included: bounds the rows of
        any symbol in a weekly panel."""
        first, last = self.trades.agg(F.min("date"), F.max("date")).first()
        return (last - first).days // 7 + 2 if first else 0

    # -- prices -------------------------------------------------------------

    @cached_property
    def trades(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        return (
            self.read("lineitem")
            .select(
                day.alias("date"),
                F.col("l_suppkey").alias("symbol"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
                F.col("l_extendedprice").alias("amount"),
                F.col("l_quantity").alias("quantity"),
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
            )
            .filter(weekday_only(F.col("date")))
        )

    @cached_property
    def bars(self) -> DataFrame:
        """(date, symbol, close, volume), one row per traded day."""
        return self.trades.groupBy("date", "symbol").agg(
            (F.sum("amount") / F.sum("quantity")).alias("close"),
            F.sum("quantity").alias("volume"),
        )

    def store_bars(self) -> None:
        """Write the bars and the calendar once, for queries whose steps read them several times;
        what is built from them afterwards reads the stored tables."""
        if "bars" not in self._staged:
            built = self.bars
            self.bars = self.staged("bars", lambda: built)
            self.calendar = self.staged("calendar", lambda: ts.calendar(self.bars))
            self.__dict__.pop("grid", None)

    @cached_property
    def ohlc(self) -> DataFrame:
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
        return self.trades.groupBy("date", "symbol").agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            (F.sum("amount") / F.sum("quantity")).alias("close"),
            F.sum("quantity").alias("volume"),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        """One row per trading day with its row number; bounded by days of history."""
        return ts.calendar(self.trades)

    @cached_property
    def grid(self) -> DataFrame:
        return ts.dense_grid(self.bars, self.calendar, self.n_symbols)

    @cached_property
    def market(self) -> DataFrame:
        """(date, mkt_close): one row per trading day."""
        return self.trades.groupBy("date").agg(
            (F.sum("amount") / F.sum("quantity")).alias("mkt_close")
        )

    # -- entities -----------------------------------------------------------

    @cached_property
    def profile(self) -> DataFrame:
        return (
            self.read("supplier")
            .join(self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("symbol"),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("sector"),
                F.col("r_name").alias("region"),
            )
        )

    @cached_property
    def membership(self) -> DataFrame:
        """Half-open membership intervals; every seventh symbol is still a member."""
        day = F.to_date("l_shipdate")
        return (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("symbol"))
            .agg(F.min(day).alias("date_added"), F.max(day).alias("last_day"))
            .select(
                "symbol",
                "date_added",
                F.when(F.col("symbol") % 7 != 0, F.col("last_day")).alias("date_removed"),
            )
        )

    # -- macro, statements, ratings -------------------------------------------

    @cached_property
    def macro(self) -> DataFrame:
        """(date, series, value): daily order totals per priority class."""
        day = F.to_date("o_orderdate")
        return (
            self.read("orders")
            .select(day.alias("date"), F.col("o_orderpriority").alias("series"), "o_totalprice")
            .filter(weekday_only(F.col("date")))
            .groupBy("date", "series")
            .agg(F.sum("o_totalprice").alias("value"))
        )

    @cached_property
    def statements(self) -> DataFrame:
        """Quarterly reports per symbol, dated at the quarter end."""
        return self.reports()

    def reports(self, total: Callable[[Column], Column] = F.sum) -> DataFrame:
        """The statements, with money added up by ``total``."""
        quarter_end = F.date_sub(
            F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 3), 1
        )
        ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        q = (
            self.read("lineitem")
            .groupBy(F.col("l_suppkey").alias("symbol"), quarter_end.alias("date"))
            .agg(
                total(ext).alias("ext"),
                total(ext * (1 - disc)).alias("rev"),
                total(ext * tax).alias("tax"),
                total(ext * disc).alias("disc"),
                F.sum("l_quantity").alias("qty"),
            )
        )
        ext, rev, tax, disc, qty = (F.col(c) for c in ("ext", "rev", "tax", "disc", "qty"))
        balance = self.read("supplier").select(F.col("s_suppkey").alias("symbol"), "s_acctbal")
        return q.join(balance, "symbol").select(
            "symbol",
            "date",
            rev.alias("revenue"),
            (0.4 * rev - tax).alias("gross_profit"),
            (0.06 * ext - disc).alias("net_income"),
            (0.2 * rev - tax).alias("ebit"),
            (0.25 * rev - tax).alias("ebitda"),
            (0.01 * rev).alias("interest_expense"),
            (0.02 * ext).alias("research_expense"),
            qty.alias("shares"),
            (rev + F.col("s_acctbal")).alias("total_equity"),
            (3 * rev).alias("total_assets"),
            (0.8 * rev).alias("total_debt"),
            (0.5 * rev + 0.1 * tax).alias("long_term_debt"),
            (0.3 * rev - 0.1 * tax).alias("short_term_debt"),
            (0.1 * ext).alias("cash"),
            (0.9 * ext).alias("current_assets"),
            (0.5 * rev + tax).alias("current_liabilities"),
            (0.05 * ext).alias("intangibles"),
            (1.2 * rev).alias("ppe"),
            (0.15 * rev - 0.5 * tax).alias("operating_cash_flow"),
            (0.1 * rev - 0.5 * tax).alias("free_cash_flow"),
            (-0.05 * ext).alias("capex"),
            (0.02 * disc).alias("stock_issued"),
            (-0.5 * tax).alias("stock_repurchased"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        """(symbol, date, action, seq): dated analyst-style actions."""
        return self.read("events").select(
            F.col("user_id").alias("symbol"),
            F.to_date("ts").alias("date"),
            F.when(F.col("event_type") == "purchase", "upgrade")
            .when(F.col("event_type") == "error", "downgrade")
            .otherwise("maintain")
            .alias("action"),
            F.col("event_id").alias("seq"),
        )
