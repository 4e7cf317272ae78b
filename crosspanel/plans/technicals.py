"""Queries for the technical read."""

from pyspark.sql import functions as F

from crosspanel.operators import technicals as tech
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view

AS_OF = "2001-10-01"


def bars_with_rsi(t):
    """OHLC bars with a bounded oscillator column standing in for a vendor's RSI."""
    return t.ohlc.withColumn("rsi", F.pmod(F.col("volume") * 7, F.lit(101.0)))


view(
    "ohlc", "trades",
    """SELECT date, symbol, arg_min(price, (l_orderkey, l_linenumber, l_partkey, price)) AS open, max(price) AS high, min(price) AS low,
         sum(amount) / sum(quantity) AS close, sum(quantity) AS volume, (sum(quantity) * 7) % 101 AS rsi FROM trades GROUP BY 1, 2""",
)


@query("k1_normalize_bars", "date:d symbol close:5 volume:2",
       """SELECT date, symbol, arg_max(close, seq) AS close, arg_max(volume, seq) AS volume FROM (
            SELECT date, symbol, price AS close, quantity AS volume, (l_orderkey, l_linenumber, l_partkey, price) AS seq FROM trades)
          GROUP BY 1, 2""", "trades")
def normalize_bars(t):
    raw = t.trades.select(
        "symbol", F.col("date").cast("string").alias("date"), F.col("price").cast("string").alias("close"),
        F.col("quantity").cast("string").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "price").alias("seq"),
    )
    return tech.normalize_bars(raw, "seq")


def fr(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(n: int) -> str:
    return f"CASE WHEN count(close) OVER {fr(n)} >= {n} THEN avg(close) OVER {fr(n)} END"


view(
    "ind", "ohlc",
    f"""SELECT *, CASE WHEN sma20 > sma50 AND last_close > sma50 THEN 'UP' WHEN sma20 < sma50 AND last_close < sma50 THEN 'DOWN' ELSE 'SIDEWAYS' END AS trend
      FROM (SELECT symbol, date AS asof, n_bars, rsi AS rsi14, round(close, 6) AS last_close, round(sma20, 6) AS sma20, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200,
        round((close - sma20) / nullif(sd20, 0), 6) AS z20, round((close / sma20 - 1) * 100, 6) AS px_vs_sma20_pct, round((close / sma50 - 1) * 100, 6) AS px_vs_sma50_pct,
        round((close / sma200 - 1) * 100, 6) AS px_vs_sma200_pct, round((close / p5 - 1) * 100, 6) AS ret_1w_pct, round((close / p21 - 1) * 100, 6) AS ret_1m_pct,
        round((close / p63 - 1) * 100, 6) AS ret_3m_pct, lo AS range_52w_low, hi AS range_52w_high,
        CASE WHEN hi > lo THEN round((close - lo) / (hi - lo), 6) END AS pct_of_52w_range, round(atr / close * 100, 6) AS atr14_pct,
        round(sdlr * sqrt(252.0) * 100, 6) AS vol_20d_ann_pct, round(volume / av, 6) AS volume_vs_20d_avg,
        round((close / signal - 1) * 100, 6) AS move_since_signal_pct
      FROM (SELECT *, row_number() OVER w AS n_bars, lead(date) OVER w AS nxt, {sma(20)} AS sma20, {sma(50)} AS sma50, {sma(200)} AS sma200,
          CASE WHEN count(close) OVER {fr(20)} >= 20 THEN stddev_samp(close) OVER {fr(20)} END AS sd20, lag(close, 5) OVER w AS p5,
          lag(close, 21) OVER w AS p21, lag(close, 63) OVER w AS p63, max(high) OVER {fr(252)} AS hi, min(low) OVER {fr(252)} AS lo,
          CASE WHEN row_number() OVER w >= 15 THEN avg(tr) OVER {fr(14)} END AS atr,
          CASE WHEN row_number() OVER w >= 21 THEN stddev_samp(lr) OVER {fr(20)} END AS sdlr,
          CASE WHEN row_number() OVER w >= 20 THEN avg(volume) OVER {fr(20)} END AS av,
          last_value(CASE WHEN date <= DATE '{AS_OF}' THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signal
        FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, ln(close / pc) AS lr FROM (
          SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM ohlc))
        WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE nxt IS NULL)""",
)
SHOWN = ("symbol asof:d n_bars:i rsi14:3 last_close:3 sma20:3 sma50:3 sma200:3 z20:4 px_vs_sma20_pct:4 px_vs_sma50_pct:4 px_vs_sma200_pct:4 "
         "ret_1w_pct:4 ret_1m_pct:4 ret_3m_pct:4 range_52w_low:3 range_52w_high:3 pct_of_52w_range:4 atr14_pct:4 vol_20d_ann_pct:4 "
         "volume_vs_20d_avg:4 move_since_signal_pct:4")


def ind(t):
    return tech.indicators(bars_with_rsi(t), AS_OF)


@query("k2_indicators", SHOWN, "SELECT * FROM ind", "ind")
def indicators(t):
    return ind(t)


@query("k3_trend", "symbol trend", "SELECT symbol, trend FROM ind", "ind")
def trend(t):
    return ind(t)


HOT = "(coalesce(rsi14 >= 70, false) OR coalesce(z20 >= 2, false))"
COLD = "(coalesce(rsi14 <= 30, false) OR coalesce(z20 <= -2, false))"
view(
    "verdicts", "ind",
    f"""SELECT *, CASE WHEN n_bars < 20 THEN 'INSUFFICIENT_DATA' WHEN {HOT} AND ret_1w_pct > 0 THEN 'OVERBOUGHT_PULLBACK'
         WHEN {COLD} AND ret_1w_pct < 0 THEN 'OVERSOLD_BOUNCE' WHEN trend = 'UP' AND ret_1w_pct < 0 AND z20 > -2 AND z20 <= -0.5 THEN 'UPTREND_PULLBACK'
         WHEN trend = 'DOWN' AND ret_1w_pct > 0 AND z20 >= 0.5 AND z20 < 2 THEN 'DOWNTREND_RALLY' WHEN trend = 'UP' THEN 'UPTREND_INTACT'
         WHEN trend = 'DOWN' THEN 'DOWNTREND_INTACT' ELSE 'RANGEBOUND' END AS verdict FROM ind""",
)
LABEL = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tech.VERDICT_LABELS.items()) + " END"
ZNOTE = "CASE WHEN z20 IS NULL THEN 'distance from SMA20 unavailable' WHEN z20 >= 0 THEN printf('%.1fσ above SMA20', abs(z20)) ELSE printf('%.1fσ below SMA20', abs(z20)) END"
REASONS = f"""CASE verdict WHEN 'INSUFFICIENT_DATA' THEN printf('only %d daily bars available (need 20)', n_bars)
  WHEN 'OVERBOUGHT_PULLBACK' THEN concat_ws(' | ', CASE WHEN rsi14 >= 70 THEN printf('RSI14 %.1f ≥ 70', rsi14) END,
    CASE WHEN z20 >= 2 THEN printf('close %.1fσ above SMA20', abs(z20)) END, printf('up %.1f%% over the last week', ret_1w_pct), PLACE)
  WHEN 'OVERSOLD_BOUNCE' THEN concat_ws(' | ', CASE WHEN rsi14 <= 30 THEN printf('RSI14 %.1f ≤ 30', rsi14) END,
    CASE WHEN z20 <= -2 THEN printf('close %.1fσ below SMA20', abs(z20)) END, printf('down %.1f%% over the last week', abs(ret_1w_pct)), PLACE)
  WHEN 'UPTREND_PULLBACK' THEN concat_ws(' | ', 'SMA20 above SMA50 (uptrend)', printf('pulled back %.1f%% this week', abs(ret_1w_pct)), printf('%.1fσ below SMA20', abs(z20)), PLACE)
  WHEN 'DOWNTREND_RALLY' THEN concat_ws(' | ', 'SMA20 below SMA50 (downtrend)', printf('rallied %.1f%% this week', ret_1w_pct), printf('%.1fσ above SMA20', z20), PLACE)
  WHEN 'UPTREND_INTACT' THEN concat_ws(' | ', 'SMA20 above SMA50 (uptrend)', {ZNOTE}, 'no stretch or pullback signal', PLACE)
  WHEN 'DOWNTREND_INTACT' THEN concat_ws(' | ', 'SMA20 below SMA50 (downtrend)', {ZNOTE}, 'no stretch or bounce signal', PLACE)
  ELSE concat_ws(' | ', 'SMA20 and SMA50 not separated (no trend)', {ZNOTE}, CASE WHEN rsi14 IS NULL THEN 'RSI unavailable' ELSE printf('RSI14 %.1f', rsi14) END, PLACE) END
  """.replace("PLACE", "CASE WHEN pct_of_52w_range IS NOT NULL THEN printf('%.0f%% of the 52-week range', pct_of_52w_range * 100) END")


@query("k4_classify", "symbol verdict verdict_label reasons",
       f"SELECT symbol, verdict, {LABEL} AS verdict_label, {REASONS} AS reasons FROM verdicts", "verdicts")
def classify(t):
    return tech.classify(ind(t)).withColumn("reasons", F.array_join("verdict_reasons", " | "))


FLAG_SQL = """concat_ws(',', CASE WHEN pct_of_52w_range >= 0.95 THEN 'at_52w_high' WHEN pct_of_52w_range <= 0.05 THEN 'at_52w_low' END,
   CASE WHEN volume_vs_20d_avg >= 2 THEN 'volume_spike' END,
   CASE WHEN vol_20d_ann_pct > 0 AND abs(move_since_signal_pct) >= 1.5 * vol_20d_ann_pct / sqrt(52.0) THEN 'gapped_since_signal' END)"""


@query("k5_flags", "symbol flags", f"SELECT symbol, {FLAG_SQL} AS flags FROM ind", "ind")
def flags(t):
    return ind(t).withColumn("flags", F.array_join(tech.flags(), ","))


def sides(t):
    """Both sides of every symbol."""
    return t.read("supplier").select(
        F.col("s_suppkey").alias("symbol"), F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("side")
    )


view(
    "aligned", "verdicts",
    """SELECT v.*, side, CASE WHEN verdict IN ('OVERSOLD_BOUNCE', 'UPTREND_PULLBACK') THEN CASE side WHEN 'LONG' THEN 'aligned' ELSE 'conflict' END
         WHEN verdict IN ('OVERBOUGHT_PULLBACK', 'DOWNTREND_RALLY') THEN CASE side WHEN 'LONG' THEN 'conflict' ELSE 'aligned' END
         ELSE 'neutral' END AS alignment FROM verdicts v CROSS JOIN (VALUES ('LONG'), ('SHORT')) s(side)""",
)


def read(t):
    return tech.technical_read(bars_with_rsi(t), sides(t), AS_OF)


@query("k6_alignment", "symbol side verdict alignment", "SELECT * FROM aligned", "aligned")
def alignment(t):
    return read(t)


@query("k7_compact_series", "symbol n:i first_day last_day total:0",
       """SELECT symbol, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day, sum(round(close, 4)) AS total
          FROM (SELECT * FROM ohlc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252) GROUP BY symbol""", "ohlc")
def compact_series(t):
    s = tech.compact_series(bars_with_rsi(t))
    total = F.aggregate("close", F.lit(0.0), lambda a, x: a + x)
    return s.select(
        "symbol", F.size("dates").alias("n"), F.element_at("dates", 1).alias("first_day"),
        F.element_at("dates", -1).alias("last_day"), total.alias("total"),
    )


@query("k7_series_to_rows", "symbol date:d rsi:1",
       """SELECT symbol, date, rsi FROM ohlc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252""", "ohlc")
def series_to_rows(t):
    return tech.series_rows(tech.compact_series(bars_with_rsi(t)), ["close", "rsi"])


@query("k8_risk_wording", "symbol side wording",
       """SELECT symbol, side, CASE WHEN alignment = 'conflict' AND side = 'LONG' THEN '⚠️ pullback risk' WHEN alignment = 'conflict' THEN '⚠️ bounce risk'
            WHEN alignment = 'aligned' THEN '✅ reversion in our favour' ELSE '· neutral' END AS wording FROM aligned""", "aligned")
def risk_wording(t):
    return read(t).withColumn("wording", tech.risk_wording(F.col("side"), F.col("alignment")))


@query("l8_largest_moves", "symbol move:3 hidden:i",
       """SELECT symbol, move_since_signal_pct AS move, greatest((SELECT count(*) FROM ind WHERE move_since_signal_pct IS NOT NULL) - 15, 0) AS hidden
          FROM ind WHERE move_since_signal_pct IS NOT NULL ORDER BY abs(move_since_signal_pct) DESC, symbol LIMIT 15""", "ind")
def largest_moves(t):
    from crosspanel.operators.research import largest_moves as largest

    return largest(ind(t)).withColumnRenamed("move_since_signal_pct", "move")


@query("l9_screening_order", "symbol side alignment position:i",
       """SELECT symbol, side, alignment, row_number() OVER (PARTITION BY region ORDER BY CASE alignment WHEN 'conflict' THEN 0
            WHEN 'aligned' THEN 1 ELSE 2 END, side, symbol) AS position FROM aligned JOIN profile USING (symbol)""", "aligned profile")
def screening(t):
    from crosspanel.functions import xs
    from crosspanel.operators.research import screening_order

    df = read(t).join(t.profile.select("symbol", "region"), "symbol")
    key = screening_order(F.col("alignment")) * 10 + (F.col("side") == "SHORT").cast("int")
    return xs.rank_first(
        df.withColumn("key", key), "key", by=["region"], name="position", max_group=2 * t.n_symbols
    )
