"""Time-series primitives on the shared calendar.

A panel holds one row per (symbol, date), so a window partitioned by symbol never
exceeds the calendar length, however many raw rows a hot symbol has.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def by_symbol():
    """A symbol's rows in calendar order."""
    return Window.partitionBy("symbol").orderBy("t")


WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def calendar(rows: DataFrame) -> DataFrame:
    """Distinct dates numbered from 0, with the calendar length in ``n_days``.

    The single-partition window sees one row per day of history, nothing more.
    """
    days = rows.select("date").distinct()
    return days.select(
        "date",
        (F.row_number().over(Window.orderBy("date")) - 1).alias("t"),
        F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_days"),
    )


# Symbols whose calendar rows one task holds and sorts: a few thousand sessions of each.
SYMBOLS_A_TASK = 1000


def tasks_for(spark, symbols: int) -> int:
    """Partitions of a panel: those of the session, more where a task would hold too many symbols."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-symbols // SYMBOLS_A_TASK))


def dense_grid(bars: DataFrame, cal: DataFrame, symbols: int = 0) -> DataFrame:
    """Every calendar row of every symbol from its first bar on.

    Each bar is repeated over the calendar rows up to the symbol's next bar: ``px`` is
    the close carried forward and ``age`` the rows since that bar; ``close`` and ``volume``
    are null on the filled rows.
    One shuffle by symbol; no calendar-by-symbol join is formed.  The partition count is
    fixed: the rows multiply after this shuffle and windows follow, so merging partitions
    by their bytes here would leave too few tasks.  It grows with ``symbols``, a bound on their
    number, so that a task's rows do not.
    """
    extra = [c for c in bars.columns if c not in ("date", "symbol", "close", "volume")]
    tasks = tasks_for(bars.sparkSession, symbols)
    indexed = bars.join(F.broadcast(cal), "date").drop("date").repartition(tasks, "symbol")
    following = F.coalesce(F.lead("t").over(by_symbol()), F.col("n_days"))
    spans = indexed.withColumn("until", following - 1).withColumn("t0", F.col("t"))
    cells = spans.withColumn("t", F.explode(F.sequence("t0", "until")))
    traded = F.col("t") == F.col("t0")
    out = cells.select(
        "symbol",
        "t",
        F.col("close").alias("px"),
        F.when(traded, F.col("close")).alias("close"),
        F.when(traded, F.col("volume")).alias("volume"),
        (F.col("t") - F.col("t0")).alias("age"),
        *[F.when(traded, F.col(c)).alias(c) for c in extra],
    )
    return out.join(F.broadcast(cal.select("t", "date")), "t")


def week_of(day: Column | str, signal_day: str = "THU") -> Column:
    """Label of the weekly bin ending on ``signal_day`` that holds ``day``."""
    return F.next_day(F.date_sub(day, 1), signal_day)


def weekly_last(
    df: DataFrame, cols: Sequence[str], signal_day: str = "THU", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Last non-null value of each column in every weekly bin, labelled by bin end."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in cols]
    return (
        df.groupBy(*keys, week_of("date", signal_day).alias("week"))
        .agg(*last)
        .withColumnRenamed("week", "date")
    )


def last_of_weeks(grid: DataFrame, col: str, cal: DataFrame, signal_days: Sequence[str]) -> DataFrame:
    """(date, symbol, col): ``weekly_last`` of one column of a dense grid for several signal days,
    weeks without a value left out.  A label falls on its signal day, which tells them apart.

    The grid has a row for every session from a symbol's first bar on, so the last session of a
    bin answers for it, with the newest value if that lies in the bin.  Most sessions are the last
    of one signal day's bin, so rows are not repeated for each signal day.
    """
    last = None
    for day in signal_days:
        bins = cal.groupBy(week_of("date", day).alias("week")).agg(F.max("t").alias("t"))
        last = bins if last is None else last.unionByName(bins)
    weeks = last.groupBy("t").agg(F.collect_list("week").alias("weeks"))
    value = F.when(F.col(col).isNotNull(), F.struct(F.col(col), F.col("date").alias("on")))
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    held = grid.select("symbol", "t", F.last(value, ignorenulls=True).over(upto).alias("held"))
    rows = held.join(F.broadcast(weeks), "t").select("symbol", "held", F.explode("weeks").alias("date"))
    rows = rows.filter(F.col("held.on") > F.date_sub("date", 7))
    return rows.select("date", "symbol", F.col(f"held.{col}").alias(col))


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is 0 or null."""
    return F.try_divide(num, den)


def change(col: Column | str, n: int, window=None) -> Column:
    """Relative change over n rows of an already carried-forward column."""
    col = F.col(col) if isinstance(col, str) else col
    return ratio(col, F.lag(col, n).over(window or by_symbol())) - 1


def trailing(window_rows: int, window=None):
    return (window or by_symbol()).rowsBetween(-(window_rows - 1), 0)


def rolling(agg, col: Column, rows: int, min_count: int | None = None, window=None) -> Column:
    """Trailing aggregate over ``rows`` rows, null below ``min_count`` non-null values."""
    frame = trailing(rows, window)
    need = rows if min_count is None else min_count
    return F.when(F.count(col).over(frame) >= need, agg(col).over(frame))


def array_median(values: Column) -> Column:
    """Median of an array of non-null numbers; null when empty."""
    s, n = F.array_sort(values), F.size(values)
    mid = (F.element_at(s, F.floor((n + 1) / 2).cast("int"))
           + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2
    return F.when(n > 0, mid)


def rolling_medians(df: DataFrame, cols: dict[str, str], rows: int, min_count: int = 1,
                    by: Sequence[str] = ("symbol",), order: str = "t", centered: bool = False) -> DataFrame:
    """Adds the sliding median of each column: ``cols`` maps new names to columns.

    Spark has no median over ordered frames, and sorting each frame anew costs a row the length
    of the window.  Here the window's values stay in an ordered list from row to row, one pass
    over each group.  A group is a series on the calendar, so it is bounded.  Nulls are left out;
    a window of fewer than ``min_count`` values gives null.  ``centered`` puts the row in the
    middle of an odd number of rows, cut off at the ends.
    """
    if centered and rows % 2 == 0:
        raise ValueError("a centered window has an odd number of rows")
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in cols]])
    whole = not by  # one series: one group
    if whole:
        df, by = df.withColumn("_series", F.lit(0)), ["_series"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        if whole:
            table = table.drop_columns("_series")
        for name, col in cols.items():
            values = table.column(col).cast(pa.float64()).to_pandas()
            medians = values.rolling(rows, min_periods=min_count, center=centered).median()
            table = table.append_column(name, pa.array(medians, pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*by).applyInArrow(run, schema)


# Within a block of an exponential mean q^-r stays below EWM_GROWTH; OLD_BLOCKS blocks are
# carried in, so what is left out weighs less than 1e-450 of the newest value: less than the
# least double, so a sum is 0 only where every value was.
EWM_GROWTH = 1e150
OLD_BLOCKS = 3


def ewm_means(df: DataFrame, cols: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """Adjusted exponential means with alpha = 1/span and min_periods = span.

    Adds ``{col}_ew{span}``.  With q = 1 - 1/span, weighted sums run inside blocks of rows,
    scaled by q^-r so that they are plain running sums; the block length follows from the
    span, so any span can be held.  The sums at the ends of the blocks before are carried
    in.  A null keeps the mean of the row before, as both its sums only decay.
    """
    df = df.withColumn("_k", F.row_number().over(by_symbol()) - 1)
    order = Window.partitionBy("symbol").orderBy("_k")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out, scratch = {}, ["_k"]
    for n in spans:
        if n < 1:
            raise ValueError("span must be at least 1")
        means = {c: F.col(c) for c in cols}
        if n > 1:
            q = 1.0 - 1.0 / n
            sums = {}
            for c in cols:
                sums[f"_n_{c}_{n}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                sums[f"_d_{c}_{n}"] = F.col(c).isNotNull().cast("double")
            df = _decayed_sums(df, sums, q, max(2, int(log(EWM_GROWTH) / -log(q))))
            scratch += list(sums)
            means = {c: ratio(F.col(f"_n_{c}_{n}"), F.col(f"_d_{c}_{n}")) for c in cols}
        for c in cols:
            held = F.last(F.when(F.col(c).isNotNull(), means[c]), ignorenulls=True).over(upto)
            out[f"{c}_ew{n}"] = F.when(F.count(c).over(upto) >= n, held)
    return df.withColumns(out).drop(*scratch)


def _decayed_sums(df: DataFrame, exprs: dict[str, Column], q: float, size: int) -> DataFrame:
    """sum over rows j <= k of q^(k - j) x_j, by symbol, for each expression."""
    df = df.withColumns(exprs).withColumns(
        {"_b": F.floor(F.col("_k") / size), "_r": F.col("_k") % size}
    )
    inside = Window.partitionBy("symbol", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    grow, decay = F.pow(F.lit(q), -F.col("_r")), F.pow(F.lit(q), F.col("_r"))
    df = df.withColumns({f"_i{n}": F.sum(F.col(n) * grow).over(inside) * decay for n in exprs})
    # The sum at the end of each row's own block, then that of each of the blocks before: they
    # are complete, so they lie a whole number of block lengths back.
    at_end = F.col("_r") == size - 1
    block = Window.partitionBy("symbol", "_b")
    df = df.withColumns({f"_e{n}": F.max(F.when(at_end, F.col(f"_i{n}"))).over(block) for n in exprs})
    order = Window.partitionBy("symbol").orderBy("_b", "_k")
    total = {}
    for n in exprs:
        carried = F.lit(0.0)
        for j in range(OLD_BLOCKS, 0, -1):
            carried = carried * q**size + F.coalesce(F.lag(f"_e{n}", j * size).over(order), F.lit(0.0))
        total[n] = F.col(f"_i{n}") + F.pow(F.lit(q), F.col("_r") + 1) * carried
    return df.withColumns(total).drop("_b", "_r", *[f"_{p}{n}" for n in exprs for p in "ie"])


def growth(ret: Column, window) -> Column:
    """Running product of (1 + ret) in row order; a null return counts as flat."""
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(
        window.rowsBetween(Window.unboundedPreceding, 0)
    )


def moving_sums(df: DataFrame, exprs: dict[str, Column], rows: int) -> DataFrame:
    """Trailing sums over ``rows`` rows for many expressions at constant cost per row.

    Rows are cut into blocks of the window length.  A window is then the tail of one
    block plus the head of the next, and both are running sums; nothing is subtracted,
    so no digits cancel.  A plain sliding frame re-adds every row of every window.
    Heads and the final lag share one sort, tails need the reverse one.
    Nulls count as 0; pass an indicator expression to count values.
    """
    zero = F.lit(0.0)
    row = F.row_number().over(by_symbol()) - 1
    df = df.withColumn("_k", row).withColumns({n: F.coalesce(e, zero) for n, e in exprs.items()})
    df = df.withColumn("_blk", F.floor(F.col("_k") / rows))
    blk = Window.partitionBy("symbol", "_blk")
    upto = (Window.unboundedPreceding, 0)
    tail = blk.orderBy(F.desc("_k")).rowsBetween(*upto)
    head = blk.orderBy("_k").rowsBetween(*upto)
    order = Window.partitionBy("symbol").orderBy("_blk", "_k")
    df = df.withColumns({f"_t_{n}": F.sum(n).over(tail) for n in exprs})
    df = df.withColumns({f"_h_{n}": F.sum(n).over(head) for n in exprs})
    straddles = (F.col("_blk") > 0) & (F.col("_k") % rows < rows - 1)
    total = {
        n: F.col(f"_h_{n}")
        + F.when(straddles, F.lag(f"_t_{n}", rows - 1).over(order)).otherwise(zero)
        for n in exprs
    }
    parts = [f"_{p}_{n}" for n in exprs for p in "ht"]
    return df.withColumns(total).drop("_k", "_blk", *parts)


def doubled(name: str, rows: int) -> Column:
    """The sum over 2 * rows rows, from a ``moving_sums`` column over ``rows`` rows."""
    return F.col(name) + F.coalesce(F.lag(name, rows).over(by_symbol()), F.lit(0.0))


def sample_variance(n: Column, s1: Column, s2: Column) -> Column:
    """Sample variance from count, sum and sum of squares; null below two values."""
    return F.when(n > 1, F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))
