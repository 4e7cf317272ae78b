"""Queries for forecasts, picks, track record and orders."""

import uuid

from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import forecast as fc
from crosspanel.operators import orders, sessions
from crosspanel.plans import factors as factor_plans
from crosspanel.plans import portfolio as portfolio_plans
from crosspanel.plans import universe as universe_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view, week
from crosspanel.session import stage, stage_dir
from crosspanel.sources import store
from crosspanel.streaming.events import pick_outcomes

N = 4
SCOPES = ["ALL", "AFRICA", "AMERICA", "ASIA", "EUROPE"]


def trade_dates(t):
    days = factor_plans.region_sessions(t)
    return sessions.region_trade_dates(factor_plans.nominal_weeks(t), days)


def forecasts(t, ranked=True):
    """Every weekly forecast of the sample panel, stored as a run would store it.

    Scores are within-date rank shares.
    """
    t.store_bars()

    def build():
        panel = universe_plans.weekly_panel(t)
        return fc.forecast_table(
            portfolio_plans.staged_ranks(t, panel), universe_plans.eligible(t, panel), t.profile, trade_dates(t),
            max_group=t.n_symbols, ranked=ranked,
        )

    return t.staged("forecasts" if ranked else "unranked forecasts", build)


view(
    "trade_dates", "region_days cal",
    f"""SELECT nominal, region, CASE WHEN l.last IS NULL OR l.last < nominal THEN nominal ELSE coalesce(session, nominal) END
          AS trade_date FROM ({factor_plans.RESOLVED}) LEFT JOIN (SELECT region, max(date) AS last FROM region_days GROUP BY 1) l USING (region)""",
)
view(
    "fc", "pct_scores eligible profile trade_dates",
    """SELECT 'THU' AS signal_day, s.date AS as_of_date, s.date + 7 AS target_date,
         s.date - CAST(7 * (((s.date - (SELECT min(date) FROM pct_scores)) // 7) % 12) AS INTEGER) AS bundle_retrain_date,
         s.symbol, s.prediction, coalesce(e.eligible, false) AS eligible, p.region, p.industry,
         coalesce(d.trade_date, s.date + 7) AS target_trade_date,
         CASE WHEN coalesce(e.eligible, false) THEN row_number() OVER (PARTITION BY s.date, p.region, coalesce(e.eligible, false)
           ORDER BY s.prediction DESC, s.symbol) END AS region_rank
       FROM pct_scores s LEFT JOIN eligible e USING (date, symbol) LEFT JOIN profile p ON p.symbol = s.symbol
       LEFT JOIN trade_dates d ON d.region = p.region AND d.nominal = s.date + 7""",
)
FORECAST = ("signal_day as_of_date:d target_date:d bundle_retrain_date:d symbol prediction:7 eligible:i region industry "
            "target_trade_date:d region_rank:0")


@query("j1_forecast_table", FORECAST, "SELECT * FROM fc", "fc")
def forecast_table(t):
    return forecasts(t)


@query(
    "a10_forecast_sink_and_reader", FORECAST,
    "SELECT * FROM fc WHERE target_date = (SELECT max(target_date) FROM fc)", "fc",
)
def sink_and_reader(t):
    import uuid

    path = f"{stage_dir(t.spark)}/forecasts-{uuid.uuid4().hex}"
    store.write_partitioned(forecasts(t), path, ["signal_day", "target_date"])
    return store.read_latest(t.spark, path, "target_date")


@query(
    "j2_target_eligibility", "date:d symbol eligible:i",
    f"""SELECT e.date, e.symbol, e.eligible AND NOT regexp_matches(c.code, '(?i)-P[A-Z]?(\\.[A-Z]+)?$') AS eligible
        FROM eligible e JOIN ({universe_plans.SYMBOL_SQL}) c ON c.s_suppkey = e.symbol
        WHERE e.date = (SELECT max(date) FROM eligible WHERE date <= DATE '2001-06-20')""",
    "eligible",
)
def target_eligibility(t):
    codes = universe_plans.listing_codes(t).withColumnRenamed("s_suppkey", "symbol")
    return fc.target_eligibility(universe_plans.eligible(t), codes, F.lit("2001-06-20").cast("date"))


@query(
    "j3_region_extremes", "as_of_date:d region symbol side rank:i",
    """SELECT as_of_date, region, symbol, 'LONG' AS side, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, region
         ORDER BY prediction DESC, symbol) AS r FROM fc WHERE eligible) WHERE r <= 4
       UNION ALL SELECT as_of_date, region, symbol, 'SHORT', r FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, region
         ORDER BY prediction, symbol DESC) AS r FROM fc WHERE eligible) WHERE r <= 4""",
    "fc",
)
def region_extremes(t):
    return fc.region_extremes(forecasts(t), N)


view(
    "picks", "fc",
    """SELECT signal_day, as_of_date, target_date, scope, side, rank, symbol, industry, prediction, bundle_retrain_date FROM (
         SELECT *, 'LONG' AS side, row_number() OVER (PARTITION BY target_date, scope ORDER BY prediction DESC, symbol) AS rank,
           count(*) OVER (PARTITION BY target_date, scope) AS size FROM (
             SELECT *, region AS scope FROM fc WHERE eligible UNION ALL SELECT *, 'ALL' FROM fc WHERE eligible)
         UNION ALL
         SELECT *, 'SHORT', row_number() OVER (PARTITION BY target_date, scope ORDER BY prediction, symbol DESC),
           count(*) OVER (PARTITION BY target_date, scope) FROM (
             SELECT *, region AS scope FROM fc WHERE eligible UNION ALL SELECT *, 'ALL' FROM fc WHERE eligible))
       WHERE rank <= 4 AND rank <= size // 2""",
)


def picks(t):
    return t.staged("picks", lambda: fc.extract_picks(forecasts(t, ranked=False), N))


@query(
    "j4_extract_picks", "signal_day as_of_date:d target_date:d scope side rank:i symbol industry prediction:7 bundle_retrain_date:d",
    "SELECT * FROM picks", "picks",
)
def extract_picks(t):
    return picks(t)


@query(
    "j5_select_names", "as_of_date:d region symbol side rank:i",
    """SELECT as_of_date, region, symbol, 'SHORT' AS side, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY as_of_date, region
         ORDER BY prediction, symbol DESC) AS r FROM fc WHERE eligible AND region IN ('ASIA', 'EUROPE')) WHERE r <= 20""",
    "fc",
)
def select_names(t):
    return fc.select_names(forecasts(t), 20, sides=["SHORT"], regions=["ASIA", "EUROPE"])


view(
    "ledger", "picks grid cal",
    """SELECT *, CASE side WHEN 'LONG' THEN realized_ret ELSE -realized_ret END AS signed_ret,
         CASE WHEN realized_ret IS NOT NULL THEN CAST(CASE side WHEN 'LONG' THEN realized_ret ELSE -realized_ret END > 0 AS INTEGER) END AS correct,
         CAST(realized_ret IS NOT NULL AS INTEGER) AS evaluable FROM (
       SELECT p.*, CASE WHEN (SELECT max(date) FROM cal) >= p.target_date AND (SELECT min(date) FROM cal) <= p.as_of_date
         THEN b.px5 / a.px5 - 1 END AS realized_ret FROM picks p
       ASOF LEFT JOIN (SELECT symbol AS s1, date AS d1, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS px5 FROM grid) a ON a.s1 = p.symbol AND p.as_of_date >= a.d1
       ASOF LEFT JOIN (SELECT symbol AS s2, date AS d2, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t
         ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS px5 FROM grid) b ON b.s2 = p.symbol AND p.target_date >= b.d2)""",
)


def ledger(t):
    def build():
        named = picks(t)
        # Only the names picked in some week need their closes on the calendar.
        held = t.bars.join(named.select("symbol").distinct(), "symbol", "left_semi")
        return fc.evaluate_picks(named, ts.dense_grid(held, t.calendar, t.n_symbols), t.calendar)

    return t.staged("ledger", build)


LEDGER = "target_date:d scope side rank:i symbol realized_ret:6 signed_ret:6 correct:0 evaluable:i"


@query("j6_evaluate_picks", LEDGER, "SELECT * FROM ledger", "ledger")
def evaluate_picks(t):
    return ledger(t)


view(
    "fret", "fc bars cal",
    """SELECT f.*, b2.close / b1.close - 1 AS ret, (SELECT arg_min(x.close, x.date) FROM bars x WHERE x.symbol = f.symbol AND x.date > f.target_date)
           / (SELECT arg_min(x.close, x.date) FROM bars x WHERE x.symbol = f.symbol AND x.date > f.as_of_date) - 1 AS ret_lag,
         (SELECT min(x.date) FROM bars x WHERE x.symbol = f.symbol AND x.date > f.as_of_date) AS entry_date,
         (SELECT min(x.date) FROM bars x WHERE x.symbol = f.symbol AND x.date > f.target_date) AS exit_date
       FROM fc f LEFT JOIN bars b1 ON b1.symbol = f.symbol AND b1.date = f.as_of_date
       LEFT JOIN bars b2 ON b2.symbol = f.symbol AND b2.date = f.target_date
       WHERE f.as_of_date IN (SELECT date FROM cal) AND f.target_date IN (SELECT date FROM cal)""",
)
view(
    "baskets", "fret",
    """SELECT target_date, as_of_date, 'THU' AS signal_day, scope, size AS n_eligible, avg(ret) FILTER (WHERE side = 'L') AS long_ret,
         avg(ret) FILTER (WHERE side = 'S') AS short_ret, avg(ret) FILTER (WHERE side = 'L') - avg(ret) FILTER (WHERE side = 'S') AS ls_ret,
         count(*) FILTER (WHERE (side = 'L' AND ret > 0) OR (side = 'S' AND ret < 0)) / nullif(count(ret), 0) AS hit_rate,
         avg(ret_lag) FILTER (WHERE side = 'L') - avg(ret_lag) FILTER (WHERE side = 'S') AS ls_ret_lag,
         count(*) FILTER (WHERE (side = 'L' AND ret_lag > 0) OR (side = 'S' AND ret_lag < 0)) / nullif(count(ret_lag), 0) AS hit_rate_lag
       FROM (SELECT *, row_number() OVER (PARTITION BY target_date, scope ORDER BY prediction DESC, symbol) AS top,
           row_number() OVER (PARTITION BY target_date, scope ORDER BY prediction, symbol DESC) AS bottom,
           count(*) OVER (PARTITION BY target_date, scope) AS size
         FROM (SELECT *, region AS scope FROM fret WHERE eligible UNION ALL SELECT *, 'ALL' FROM fret WHERE eligible))
       CROSS JOIN (VALUES ('L'), ('S')) v(side)
       WHERE size >= 8 AND ((side = 'L' AND top <= 4) OR (side = 'S' AND bottom <= 4)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY target_date, as_of_date, scope, size"),
)


def evaluated(t):
    return fc.evaluate_forecasts(forecasts(t, ranked=False), t.bars, t.calendar, N)


@query(
    "j7_evaluate_forecast", "target_date:d scope n_eligible:i long_ret:5 short_ret:5 ls_ret:5 hit_rate:6 ls_ret_lag:5 hit_rate_lag:6",
    "SELECT * FROM baskets", "baskets",
)
def evaluate_forecast(t):
    return evaluated(t)[0]


@query(
    "j7_forecast_status", "target_date:d as_of_date:d evaluable:i reason entry_date:d exit_date:d",
    """SELECT f.target_date, f.as_of_date, reason IS NULL AS evaluable, reason, e.entry_date, x.exit_date FROM (
         SELECT DISTINCT target_date, as_of_date, CASE WHEN target_date NOT IN (SELECT date FROM cal) THEN 'target close not yet in cache'
           WHEN as_of_date NOT IN (SELECT date FROM cal) THEN 'as-of close missing from cache' END AS reason FROM fc) f
       LEFT JOIN (SELECT target_date, arg_min(entry_date, (-n, entry_date)) AS entry_date FROM (
         SELECT target_date, entry_date, count(*) AS n FROM fret WHERE ret_lag IS NOT NULL GROUP BY 1, 2) GROUP BY 1) e USING (target_date)
       LEFT JOIN (SELECT target_date, arg_min(exit_date, (-n, exit_date)) AS exit_date FROM (
         SELECT target_date, exit_date, count(*) AS n FROM fret WHERE ret_lag IS NOT NULL GROUP BY 1, 2) GROUP BY 1) x USING (target_date)""",
    "fret cal fc",
)
def forecast_status(t):
    return evaluated(t)[1]


@query(
    "j8_track_record", "target_date:d as_of_date:d " + " ".join(f"{s}_ls_ret:5 {s}_ls_ret_lag:5 {s}_hit_rate:6" for s in SCOPES),
    "SELECT target_date, as_of_date, " + ", ".join(
        f"max({m}) FILTER (WHERE scope = '{s}') AS {s}_{m}" for s in SCOPES for m in ("ls_ret", "ls_ret_lag", "hit_rate")
    ) + " FROM baskets GROUP BY 1, 2",
    "baskets",
)
def track_record(t):
    return fc.track_wide(evaluated(t)[0], SCOPES).orderBy("target_date")


@query("j9_rebuild_ledger", LEDGER, "SELECT * FROM ledger", "ledger")
def rebuild_ledger(t):
    fresh = ledger(t).withColumn("logged_at", F.lit(2))
    # The stored version of the first half predates its resolution.
    unresolved = {c: F.lit(None).cast("double") for c in ("realized_ret", "signed_ret")}
    unresolved |= {"correct": F.lit(None).cast("int"), "evaluable": F.lit(0), "logged_at": F.lit(1)}
    stored = fresh.filter("target_date < '1998-06-01'").withColumns(unresolved)
    return store.upsert(stored, fresh, fc.LEDGER_KEY, "logged_at")


@query(
    "j10_ledger_summary", "scope n:i hit_rate:6 mean_signed_ret:6",
    """SELECT scope, count(*) AS n, avg(CAST(signed_ret > 0 AS INTEGER)) AS hit_rate, avg(signed_ret) AS mean_signed_ret
       FROM ledger WHERE evaluable = 1 GROUP BY scope""",
    "ledger",
)
def ledger_summary(t):
    return fc.ledger_summary(ledger(t))


view(
    "weekly_perf", "ledger",
    """SELECT *, long_ret - short_ret AS ls_ret, CAST(long_ret - short_ret > 0 AS INTEGER) AS ls_positive, n_correct / n_picks AS single_stock_hit_rate FROM (
         SELECT signal_day, target_date, scope, min(as_of_date) AS as_of_date, count(*) FILTER (WHERE side = 'LONG') AS n_long,
           count(*) FILTER (WHERE side = 'SHORT') AS n_short, avg(realized_ret) FILTER (WHERE side = 'LONG') AS long_ret,
           avg(realized_ret) FILTER (WHERE side = 'SHORT') AS short_ret, count(*) AS n_picks, count(*) FILTER (WHERE signed_ret > 0) AS n_correct,
           min(bundle_retrain_date) AS bundle_retrain_date FROM ledger WHERE evaluable = 1 GROUP BY 1, 2, 3)""",
)


@query(
    "j11_weekly_performance",
    "signal_day target_date:d scope as_of_date:d n_long:i n_short:i long_ret:6 short_ret:6 ls_ret:6 ls_positive:0 n_picks:i n_correct:i single_stock_hit_rate:6 bundle_retrain_date:d",
    "SELECT * FROM weekly_perf", "weekly_perf",
)
def weekly_performance(t):
    return fc.weekly_performance(ledger(t))


def compared_growth(df, compounded: str, suffix: str):
    """Sign and logarithm of 1 + a compounded return, which spans too many powers of ten here
    to be compared digit by digit."""
    growth = 1 + F.col(compounded)
    return df.withColumns({f"growth_sign{suffix}": F.sign(growth), f"log_growth{suffix}": F.ln(F.abs(growth))})


@query(
    "j12_live_summary", "signal_day scope weeks:i mean_ls:6 growth_sign:i log_growth:6 portfolio_hit:6 single_stock_hit:6",
    """SELECT signal_day, scope, count(*) AS weeks, avg(ls_ret) AS mean_ls, sign(product(1 + coalesce(ls_ret, 0))) AS growth_sign,
         ln(abs(product(1 + coalesce(ls_ret, 0)))) AS log_growth, avg(CAST(coalesce(ls_positive = 1, false) AS INTEGER)) AS portfolio_hit,
         sum(n_correct) / sum(n_picks) AS single_stock_hit FROM weekly_perf GROUP BY 1, 2""",
    "weekly_perf",
)
def live_summary(t):
    return compared_growth(fc.live_summary(fc.weekly_performance(ledger(t))), "cum_ls", "")


@query(
    "j13_track_summary", "scope forecasts:i mean_ls:5 growth_sign:i log_growth:6 mean_ls_lag:5 growth_sign_lag:i log_growth_lag:6 mean_hit_rate:6",
    """SELECT scope, count(*) AS forecasts, avg(ls_ret) AS mean_ls, sign(product(1 + ls_ret)) AS growth_sign, ln(abs(product(1 + ls_ret))) AS log_growth,
         avg(ls_ret_lag) AS mean_ls_lag, sign(product(1 + ls_ret_lag)) AS growth_sign_lag, ln(abs(product(1 + ls_ret_lag))) AS log_growth_lag, avg(hit_rate) AS mean_hit_rate
       FROM baskets WHERE ls_ret IS NOT NULL GROUP BY 1""",
    "baskets",
)
def track_summary(t):
    out = fc.track_summary(evaluated(t)[0])
    return compared_growth(compared_growth(out, "cum_ls", ""), "cum_ls_lag", "_lag")


@query(
    "j14_holiday_shifts", "region target_date:d target_trade_date:d",
    "SELECT DISTINCT region, target_date, target_trade_date FROM fc WHERE target_trade_date <> target_date", "fc",
)
def holiday_shifts(t):
    return fc.holiday_shifts(forecasts(t))


# -- orders -----------------------------------------------------------------------

CAPITAL, RATES = 1_000_000.0, {"CAD": 0.73, "USD": 1.0, "GBP": 1.0}
view(
    "orders_sized", "fc bars",
    f"""WITH book AS (SELECT symbol, region, prediction, CASE region WHEN 'ASIA' THEN symbol || '.TO' WHEN 'EUROPE' THEN symbol || '.L'
           ELSE CAST(symbol AS VARCHAR) END AS code FROM fc WHERE eligible AND region IN ('ASIA', 'EUROPE', 'AMERICA')
             AND target_date = (SELECT max(target_date) FROM fc)),
         sel AS (SELECT *, 'BUY' AS action FROM (SELECT *, row_number() OVER (ORDER BY prediction DESC, symbol) AS r FROM book) WHERE r <= 10
           UNION ALL SELECT *, 'SELL' FROM (SELECT *, row_number() OVER (ORDER BY prediction, symbol DESC) AS r FROM book) WHERE r <= 10),
         px AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol),
         sized AS (SELECT s.*, price, CASE WHEN code LIKE '%.TO' THEN 0.73 ELSE 1.0 END AS rate FROM sel s JOIN px USING (symbol)),
         shares AS (SELECT *, round_even({CAPITAL} / (SELECT 2.0 * least(count(*), 10) FROM book) / rate / price, 0) AS shares FROM sized)
       SELECT symbol, CASE WHEN code LIKE '%.TO' OR code LIKE '%.L' THEN regexp_replace(code, '\\.(TO|L)$', '') ELSE code END AS broker_symbol,
         CASE WHEN code LIKE '%.TO' THEN 'TSE' WHEN code LIKE '%.L' THEN 'LSE' ELSE 'SMART' END AS exchange,
         CASE WHEN code LIKE '%.TO' THEN 'CAD' WHEN code LIKE '%.L' THEN 'GBP' ELSE 'USD' END AS currency, action, shares, price,
         shares * price * rate AS est_usd, region, prediction, 'TARGET' AS order_type FROM shares WHERE shares > 0""",
)


def sized(t):
    df = forecasts(t)
    last = df.agg(F.max("target_date")).scalar()
    sym = F.col("symbol").cast("string")
    code = F.when(F.col("region") == "ASIA", F.concat(sym, F.lit(".TO"))).when(
        F.col("region") == "EUROPE", F.concat(sym, F.lit(".L"))
    ).otherwise(sym)
    book = df.filter(
        F.col("eligible") & F.col("region").isin("ASIA", "EUROPE", "AMERICA") & (F.col("target_date") == last)
    ).select("symbol", code.alias("code"), "region", "prediction")
    return orders.size_orders(book, orders.last_prices(t.bars), CAPITAL, 10, RATES)


@query(
    "j15_size_orders", "symbol broker_symbol exchange currency action shares:i price:4 est_usd:2 region prediction:6 order_type",
    "SELECT * FROM orders_sized", "orders_sized",
)
def size_orders(t):
    return sized(t)


def positions(t):
    """Positions implied by the last quarter's net volume."""
    recent = t.bars.filter("date >= '2001-09-01'").groupBy("symbol").agg(
        F.sum("volume").alias("v"), F.max_by("close", "date").alias("market_price")
    )
    position = F.when(F.col("symbol") % 2 == 0, F.col("v")).otherwise(-F.col("v"))
    return recent.select(
        "symbol", position.alias("position"), "market_price",
        (position * F.col("market_price")).alias("market_value"),
    )


@query(
    "j16_book_totals", "new_orders:i liquidations:i long_usd:1 short_usd:1 liquidated_usd:1 gross_usd:1 net_usd:1",
    """WITH pos AS (SELECT symbol, sum(volume) AS v, arg_max(close, date) AS price FROM bars WHERE date >= '2001-09-01' GROUP BY 1),
       every_order AS (SELECT action, est_usd, order_type FROM orders_sized UNION ALL
         SELECT CASE WHEN symbol % 2 = 0 THEN 'SELL' ELSE 'BUY' END, v * price, 'LIQUIDATE' FROM pos WHERE v <> 0)
       SELECT *, long_usd + short_usd AS gross_usd, long_usd - short_usd AS net_usd FROM (
         SELECT count(*) FILTER (WHERE order_type = 'TARGET') AS new_orders, count(*) FILTER (WHERE order_type <> 'TARGET') AS liquidations,
           sum(est_usd) FILTER (WHERE order_type = 'TARGET' AND action = 'BUY') AS long_usd,
           sum(est_usd) FILTER (WHERE order_type = 'TARGET' AND action = 'SELL') AS short_usd,
           sum(est_usd) FILTER (WHERE order_type <> 'TARGET') AS liquidated_usd FROM every_order)""",
    "orders_sized bars",
)
def book_totals(t):
    every = sized(t).select(orders.ORDER_COLUMNS).unionByName(orders.liquidation_rows(positions(t)))
    return orders.book_totals(every)


@query(
    "j17_reconcile_plan", "symbol action qty:i ref_px:4 limit_px:4",
    """WITH target AS (SELECT symbol, CASE action WHEN 'BUY' THEN shares ELSE -shares END AS s FROM orders_sized),
       held AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 1 ELSE -1 END * sum(volume) AS s FROM bars
                WHERE date >= '2001-09-01' GROUP BY symbol),
       d AS (SELECT symbol, round_even(coalesce(t.s, 0) - coalesce(h.s, 0), 0) AS delta FROM target t FULL JOIN held h USING (symbol))
       SELECT d.symbol, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS action, abs(delta) AS qty, price AS ref_px,
         price * (1 + CASE WHEN delta > 0 THEN 1 ELSE -1 END * 25.0 / 1e4) AS limit_px
       FROM d LEFT JOIN (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol) USING (symbol) WHERE abs(delta) >= 1""",
    "orders_sized bars",
)
def reconcile_plan(t):
    signed = F.when(F.col("action") == "BUY", F.col("shares")).otherwise(-F.col("shares"))
    target = sized(t).select("symbol", signed.cast("double").alias("shares"))
    held = positions(t).select("symbol", F.col("position").alias("shares"))
    return orders.reconcile_plan(target, held, orders.last_prices(t.bars), 25.0)


@query(
    "j6_outcomes_as_stream", "symbol:i target_date:d entry_close:4 exit_close:4 signed_ret:6",
    f"""WITH w AS (SELECT symbol, {week('date')} AS label, arg_max(close, date) AS close FROM bars GROUP BY 1, 2),
       pick AS (SELECT symbol, label + 7 AS target, close AS entry_close FROM w
                WHERE label + 7 <= (SELECT max(date) FROM bars) - 28)
       SELECT pick.symbol, target AS target_date, entry_close, w.close AS exit_close,
              CASE WHEN pick.symbol % 2 = 0 THEN 1 ELSE -1 END * (w.close / nullif(entry_close, 0) - 1) AS signed_ret
       FROM pick LEFT JOIN w ON w.symbol = pick.symbol AND w.label = target""",
    "bars",
)
def outcomes_as_stream(t):
    """Weekly picks and bars read as streams to their end; only weeks behind both watermarks count."""
    t.store_bars()
    bars = t.bars.select("symbol", F.col("date").cast("timestamp").alias("ts"), "close")
    picks = ts.weekly_last(t.bars, ["close"]).select(
        "symbol", F.date_add("date", 7).cast("timestamp").alias("target_ts"), F.col("close").alias("entry_close"),
        F.when(F.col("symbol") % 2 == 0, "LONG").otherwise("SHORT").alias("side"))
    inputs = [stage(df) for df in (picks, bars)]
    live = [t.spark.readStream.schema(df.schema).parquet(df.staged_path) for df in inputs]
    out = pick_outcomes(*live)
    folder = f"{stage_dir(t.spark)}/outcomes-{uuid.uuid4().hex}"
    run = out.writeStream.format("parquet").option("path", f"{folder}/rows").option(
        "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    last = t.bars.agg(F.max("date")).scalar()
    rows = t.spark.read.schema(out.schema).parquet(f"{folder}/rows")
    return rows.withColumn("target_date", F.to_date("target_ts")).filter(F.col("target_date") <= F.date_sub(F.lit(last), 28))
