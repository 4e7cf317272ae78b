"""Queries for the time-series primitives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import factors
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view, week

W = "OVER (PARTITION BY symbol ORDER BY t)"


def frame(rows: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


view(
    "daily", "grid",
    f"SELECT *, px / lag(px) {W} - 1 AS ret FROM grid",
)
view(
    "r1w_weekly", "grid",
    f"""SELECT {week('date')} AS date, symbol, arg_max(r, t) AS r1w
        FROM (SELECT *, px / lag(px, 5) {W} - 1 AS r FROM grid) WHERE r IS NOT NULL
        GROUP BY 1, 2""",
)


@query(
    "d1_padded_change", "date:d symbol r5:6",
    f"SELECT date, symbol, r5 FROM (SELECT date, symbol, px / lag(px, 5) {W} - 1 AS r5 FROM grid) WHERE r5 IS NOT NULL",
    "grid",
)
def padded_change(t):
    return factors.r1w(t.grid).withColumnRenamed("R1W", "r5").filter("r5 is not null")


@query(
    "d2_unpadded_change", "date:d symbol r:6",
    f"SELECT date, symbol, r FROM (SELECT date, symbol, close / lag(close) {W} - 1 AS r FROM grid) WHERE r IS NOT NULL",
    "grid",
)
def unpadded_change(t):
    return t.grid.withColumn("r", ts.change("close", 1)).filter("r is not null")


@query(
    "d3_difference", "date:d symbol d:4",
    f"SELECT date, symbol, d FROM (SELECT date, symbol, close - lag(close, 2) {W} AS d FROM grid) WHERE d IS NOT NULL",
    "grid",
)
def difference(t):
    d = F.col("close") - F.lag("close", 2).over(ts.by_symbol())
    return t.grid.withColumn("d", d).filter("d is not null")


@query(
    "d4_shift", "date:d symbol back:4 ahead:4",
    f"""SELECT date, symbol, back, ahead FROM (SELECT date, symbol, close,
        lag(close, 3) {W} AS back, lead(close, 3) {W} AS ahead FROM grid)
        WHERE close IS NOT NULL""",
    "grid",
)
def shift(t):
    return t.grid.withColumns(
        {"back": F.lag("close", 3).over(ts.by_symbol()),
         "ahead": F.lead("close", 3).over(ts.by_symbol())}
    ).filter("close is not null")


@query(
    "d5_align_series", "date:d value:4",
    """SELECT c.date, last_value(m.value IGNORE NULLS) OVER (ORDER BY c.t
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
       FROM cal c LEFT JOIN (SELECT date, value FROM macro WHERE series = '1-URGENT') m USING (date)""",
    "cal macro",
)
def align_series(t):
    urgent = t.macro.filter(F.col("series") == "1-URGENT").select("date", "value")
    return factors.series_on_calendar(t.calendar, urgent, ["value"])


@query(
    "d6_rolling_full_window", "date:d symbol mean:4 var:1",
    f"""SELECT date, symbol, CASE WHEN n >= 21 THEN m END AS mean, CASE WHEN n >= 21 THEN v END AS var
        FROM (SELECT date, symbol, count(px) {frame(21)} AS n, avg(px) {frame(21)} AS m,
              var_samp(px) {frame(21)} AS v FROM grid) WHERE n >= 21""",
    "grid",
)
def rolling_full(t):
    x = F.col("px")
    return t.grid.select(
        "date", "symbol",
        ts.rolling(F.avg, x, 21).alias("mean"), ts.rolling(F.var_samp, x, 21).alias("var"),
    ).filter("mean is not null")


@query(
    "d7_rolling_half_window", "date:d symbol std:5",
    f"""SELECT date, symbol, s AS std FROM (SELECT date, symbol, count(ret) {frame(42)} AS n,
        stddev_samp(ret) {frame(42)} AS s FROM daily) WHERE n >= 21""",
    "daily",
)
def rolling_half(t):
    df = t.grid.withColumn("ret", ts.change("px", 1))
    std = ts.rolling(F.stddev_samp, F.col("ret"), 42, 21)
    return df.withColumn("std", std).filter("std is not null")


@query(
    "d8_rolling_median", "date:d symbol med:4",
    f"""SELECT date, symbol, m AS med FROM (SELECT date, symbol, count(close) {frame(42)} AS n,
        median(close) {frame(42)} AS m FROM grid) WHERE n >= 5""",
    "grid",
)
def rolling_median(t):
    return ts.rolling_medians(t.grid, {"med": "close"}, 42, 5).filter("med is not null")


@query(
    "d9_centered_median", "date:d n:i norm:2",
    """SELECT date, n, median(n) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS norm
       FROM (SELECT date, count(close) AS n FROM bars GROUP BY date)""",
    "bars",
)
def centered_median(t):
    counts = t.bars.groupBy("date").agg(F.count("close").alias("n"))
    return ts.rolling_medians(counts, {"norm": "n"}, 21, by=(), order="date", centered=True)


@query(
    "d10_calendar_week_sum", "date:d symbol vol7:2",
    """SELECT date, symbol, sum(volume) OVER (PARTITION BY symbol ORDER BY date
         RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS vol7 FROM bars""",
    "bars",
)
def calendar_week_sum(t):
    w = (
        Window.partitionBy("symbol")
        .orderBy(F.datediff("date", F.to_date(F.lit("1970-01-01"))))
        .rangeBetween(-6, 0)
    )
    return t.bars.withColumn("vol7", F.sum("volume").over(w))


@query(
    "d11_trailing_four_quarters", "date:d symbol ttm:2",
    """SELECT date, symbol, CASE WHEN n = 4 THEN s END AS ttm FROM (SELECT date, symbol,
         count(revenue) OVER w AS n, sum(revenue) OVER w AS s FROM statements
         WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))""",
    "statements",
)
def trailing_four(t):
    w = Window.partitionBy("symbol").orderBy("date")
    return t.statements.withColumn("ttm", ts.rolling(F.sum, F.col("revenue"), 4, window=w))


@query(
    "d12_exponential_mean", "date:d symbol ew:3",
    f"""SELECT date, symbol, n / d AS ew FROM (SELECT date, symbol, count(close) {W} AS c,
          sum(close * pow(13.0 / 14, -k)) {W} AS n,
          sum(CASE WHEN close IS NOT NULL THEN pow(13.0 / 14, -k) END) {W} AS d
        FROM (SELECT *, row_number() {W} AS k FROM grid WHERE px IS NOT NULL)) WHERE c >= 14""",
    "grid",
)
def exponential_mean(t):
    out = ts.ewm_means(t.grid, ["close"], [14]).withColumnRenamed("close_ew14", "ew")
    return out.filter("ew is not null")


@query(
    "d13_weekly_last", "date:d symbol close:4 volume:2",
    f"""SELECT {week('date')} AS date, symbol, arg_max(close, date) AS close, arg_max(volume, date) AS volume
        FROM bars GROUP BY 1, 2""",
    "bars",
)
def weekly_last(t):
    return ts.weekly_last(t.bars, ["close", "volume"])


@query(
    "d14_growth_and_drawdown", "date:d growth:8 drawdown:8",
    """SELECT date, g AS growth, g / max(g) OVER (ORDER BY date) - 1 AS drawdown FROM (
         SELECT date, product(1 + r) OVER (ORDER BY date) AS g FROM (
           SELECT date, coalesce(mkt_close / lag(mkt_close) OVER (ORDER BY date) - 1, 0) AS r FROM market))""",
    "market",
)
def growth_and_drawdown(t):
    w = Window.orderBy("date")
    r = F.coalesce(ts.change("mkt_close", 1, w), F.lit(0.0))
    out = t.market.withColumn("r", r).withColumn("growth", ts.growth(F.col("r"), w))
    return out.withColumn("drawdown", F.col("growth") / F.max("growth").over(w) - 1)


@query(
    "d15_percentile_rank", "date:d symbol pct:8",
    """SELECT date, symbol, (rank() OVER (PARTITION BY date ORDER BY volume)
         + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct
       FROM bars""",
    "bars",
)
def percentile_rank(t):
    return xs.pct_rank(t.bars, "volume", max_group=t.n_symbols)


@query(
    "d16_first_rank", "date:d symbol pos:i n:i",
    """SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY volume, symbol) AS pos,
         count(*) OVER (PARTITION BY date) AS n FROM bars""",
    "bars",
)
def first_rank(t):
    return xs.rank_first(t.bars, "volume", max_group=t.n_symbols)


@query(
    "d17_quantile_bins", "date:d symbol bin:i",
    """SELECT b.date, b.symbol, greatest(len(list_filter(e.edges, lambda x: x < b.volume)) - 1, 0) AS bin
       FROM bars b JOIN (SELECT date, list_distinct(quantile_cont(volume,
         [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM bars GROUP BY date) e
       USING (date)""",
    "bars",
)
def quantile_bins(t):
    return xs.quantile_bins(t.bars, "volume", 10, max_group=t.n_symbols)


@query(
    "d18_head_and_tail", "date:d symbol side rank:i",
    """SELECT date, symbol, 'LONG' AS side, r AS rank FROM (SELECT *, row_number() OVER (
         PARTITION BY date ORDER BY close DESC, symbol) AS r FROM bars) WHERE r <= 3
       UNION ALL
       SELECT date, symbol, 'SHORT', r FROM (SELECT *, row_number() OVER (
         PARTITION BY date ORDER BY close, symbol DESC) AS r FROM bars) WHERE r <= 3""",
    "bars",
)
def head_and_tail(t):
    return xs.top_and_bottom(t.bars, 3, value="close")


@query(
    "d19_mode", "symbol weekday:i",
    """SELECT symbol, arg_min(wd, (-n, wd)) AS weekday FROM (SELECT symbol, isodow(date) AS wd,
         count(*) AS n FROM bars GROUP BY 1, 2) GROUP BY symbol""",
    "bars",
)
def mode(t):
    # Count per value first: the most frequent value then needs one small row per value.
    counts = t.bars.groupBy("symbol", (F.weekday("date") + 1).alias("wd")).count()
    return counts.groupBy("symbol").agg(
        F.min_by("wd", F.struct(-F.col("count"), "wd")).alias("weekday")
    )


@query(
    "d20_first_and_last_row", "symbol first_close:4 last_close:4 last_date:d",
    """SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close,
         max(date) AS last_date FROM bars GROUP BY symbol""",
    "bars",
)
def first_and_last(t):
    return t.bars.groupBy("symbol").agg(
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
        F.max("date").alias("last_date"),
    )


@query(
    "d21_change_points", "date:d symbol volume:2",
    """SELECT date, symbol, volume FROM (SELECT *, lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS p
         FROM bars) WHERE volume IS DISTINCT FROM p""",
    "bars",
)
def change_points(t):
    prev = F.lag("volume").over(Window.partitionBy("symbol").orderBy("date"))
    return t.bars.withColumn("p", prev).filter(~F.col("volume").eqNullSafe(F.col("p")))
