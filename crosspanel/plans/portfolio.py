"""Queries for baselines, portfolios, performance and calibration."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import calibration, factors, portfolio, target
from crosspanel.plans import factors as factor_plans
from crosspanel.plans import timeseries  # noqa: F401  defines shared views
from crosspanel.plans import universe as universe_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view, week
from crosspanel.session import stage

ADV_THRESHOLD = 60_000.0
THRESHOLD_BY_REGION = {"AMERICA": 58_000.0, "EUROPE": 60_000.0, "ASIA": 62_000.0, "AFRICA": 55_000.0}

METRICS = ("annualized_return:5 annualized_volatility:5 information_ratio:4 max_drawdown:5 "
           "avg_weekly_turnover:6 num_weeks:i")
WEEKLY = "long_return:7 short_return:7 ls_return:7 ls_return_net:7 turnover:7"


# -- shared inputs -----------------------------------------------------------------


def weekly_r1w(t, signal_day="THU"):
    return ts.weekly_last(factors.r1w(t.grid), ["R1W"], signal_day)


def scores(t, weekly=None):
    return portfolio.reversal_scores(weekly_r1w(t) if weekly is None else weekly, t.profile, max_group=t.n_symbols)


def staged_scores(t):
    """Scores as a stored table: portfolios read them for members and for dates."""
    return t.staged("scores", lambda: scores(t))


def returns(t, lag=1):
    return target.trade_returns(t.bars, t.calendar, lag=lag)


view(
    "scores", "r1w_weekly profile",
    """SELECT date, symbol, -(r1w - avg(r1w) OVER (PARTITION BY date, sector)) AS prediction
       FROM r1w_weekly JOIN profile USING (symbol)""",
)
view("rets", "fwd", "SELECT date, symbol, greatest(-0.3, least(0.3, ret)) AS ret FROM fwd")


def quintile_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT *, CAST(ceil(5 * pos / n) AS INTEGER) AS quintile FROM (SELECT {k}date, symbol, prediction,
          row_number() OVER (PARTITION BY {k}date ORDER BY prediction, symbol) AS pos,
          CAST(count(*) OVER (PARTITION BY {k}date) AS DOUBLE) AS n FROM {source} WHERE prediction IS NOT NULL)"""


view("quint", "scores", quintile_sql("scores"))


def portfolio_sql(quint: str, rets: str, scale: str = "1.0", joins: str = "", keys: str = "",
                  cost: float = 1.5, source: str = "scores") -> str:
    """Long/short portfolio by self-joining each week's members to the previous week's."""
    k = f"{keys}, " if keys else ""
    on = lambda a, b: " AND ".join([f"{a}.{c} = {b}.{c}" for c in keys.split(", ") if c] + ["true"])
    mk = f"m.{keys}, " if keys else ""
    return f"""WITH dates AS (SELECT {k}date, lag(date) OVER (PARTITION BY {k}1 ORDER BY date) AS prev
        FROM (SELECT DISTINCT {k}date FROM {source})),
      mem AS (SELECT {k}date, symbol, CASE quintile WHEN 5 THEN 'L' WHEN 1 THEN 'S' END AS side FROM ({quint})
        WHERE quintile IN (1, 5)),
      scaled AS (SELECT m.*, {scale} AS scale, coalesce(r.ret, 0) AS ret,
          EXISTS (SELECT 1 FROM mem p WHERE {on('p', 'm')} AND p.symbol = m.symbol AND p.side = m.side AND p.date = d.prev) AS kept
        FROM mem m JOIN dates d ON {on('d', 'm')} AND d.date = m.date
        LEFT JOIN {rets} r ON r.date = m.date AND r.symbol = m.symbol {joins}),
      tot AS (SELECT *, sum(scale) OVER (PARTITION BY {k}date, side) AS total, count(*) OVER (PARTITION BY {k}date, side) AS c FROM scaled),
      weighted AS (SELECT *, CASE WHEN total > 0 THEN scale / total ELSE 1.0 / c END AS weight FROM tot),
      agg AS (SELECT {mk}m.date, sum(ret * weight) FILTER (WHERE side = 'L') AS lr, sum(ret * weight) FILTER (WHERE side = 'S') AS sr,
          1 - (count(*) FILTER (WHERE side = 'L' AND kept)) / greatest(count(*) FILTER (WHERE side = 'L'), 1) AS lt,
          1 - (count(*) FILTER (WHERE side = 'S' AND kept)) / greatest(count(*) FILTER (WHERE side = 'S'), 1) AS st,
          count(*) AS held FROM weighted m GROUP BY {mk}m.date),
      wk AS (SELECT d.*, coalesce(lr, 0) AS long_return, coalesce(sr, 0) AS short_return,
          CASE WHEN lag(coalesce(held, 0)) OVER (PARTITION BY {', '.join('d.' + c for c in keys.split(', ') if c) + ', ' if keys else ''}1 ORDER BY d.date) > 0
            THEN (coalesce(lt, 1) + coalesce(st, 1)) / 2 ELSE 1.0 END AS turnover
        FROM dates d LEFT JOIN agg a ON {on('a', 'd')} AND a.date = d.date)
      SELECT {k}date, long_return, short_return, long_return - short_return AS ls_return,
        long_return - short_return - turnover * {cost} / 10000 * 2 AS ls_return_net, turnover FROM wk"""


def metrics_sql(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}avg(ls_return_net) * 52 AS annualized_return, stddev_samp(ls_return_net) * sqrt(52.0) AS annualized_volatility,
        CASE WHEN stddev_samp(ls_return_net) > 0 THEN avg(ls_return_net) * 52 / (stddev_samp(ls_return_net) * sqrt(52.0)) ELSE 0 END AS information_ratio,
        min(g / peak - 1) AS max_drawdown, avg(turnover) AS avg_weekly_turnover, count(*) AS num_weeks,
        product(1 + ls_return_net) - 1 AS cumulative_return, min(date) AS date_first, max(date) AS date_last
      FROM (SELECT *, max(g) OVER (PARTITION BY {k}1 ORDER BY date) AS peak FROM (
        SELECT *, product(1 + ls_return_net) OVER (PARTITION BY {k}1 ORDER BY date) AS g FROM {source})){group}"""


view("port", "quint rets scores", portfolio_sql("SELECT * FROM quint", "rets"))


def weekly_portfolio(t):
    return portfolio.long_short(staged_scores(t), returns(t), max_group=t.n_symbols)


# -- queries -----------------------------------------------------------------------


@query("i1_assign_quintiles", "date:d symbol quintile:i", "SELECT * FROM quint", "quint")
def quintiles(t):
    return portfolio.assign_quantiles(scores(t), max_group=t.n_symbols)


@query(
    "i2_basket_weights", "date:d symbol side weight:8",
    f"""SELECT date, symbol, side, CASE WHEN sum(s) OVER w > 0 THEN s / sum(s) OVER w ELSE 1.0 / count(*) OVER w END AS weight
        FROM (SELECT q.date, q.symbol, CASE quintile WHEN 5 THEN 'LONG' ELSE 'SHORT' END AS side,
          least(coalesce(l.adv, 0) / {universe_plans.case('p.region', THRESHOLD_BY_REGION, '1e300')}, 1.0) AS s
          FROM quint q LEFT JOIN weekly_levels l USING (date, symbol) LEFT JOIN profile p USING (symbol) WHERE quintile IN (1, 5))
        WINDOW w AS (PARTITION BY date, side)""",
    "quint weekly_levels profile",
)
def basket_weights(t):
    members = portfolio.long_short_members(scores(t), max_group=t.n_symbols)
    scaled = portfolio.with_scale(members, universe_plans.weekly_levels(t), THRESHOLD_BY_REGION, t.profile)
    return portfolio.basket_weights(scaled)


@query("i3_long_short_portfolio", f"date:d {WEEKLY}", "SELECT * FROM port", "port")
def long_short_portfolio(t):
    return weekly_portfolio(t)


SCALED = dict(
    scale=f"least(coalesce(l.adv, 0) / {ADV_THRESHOLD}, 1.0)",
    joins="LEFT JOIN weekly_levels l ON l.date = m.date AND l.symbol = m.symbol",
)


@query(
    "i3_adv_scaled_portfolio", f"date:d {WEEKLY}",
    portfolio_sql("SELECT * FROM quint", "rets", **SCALED), "quint rets scores weekly_levels",
)
def adv_scaled_portfolio(t):
    return portfolio.long_short(
        staged_scores(t), returns(t), universe_plans.weekly_levels(t), ADV_THRESHOLD, max_group=t.n_symbols
    )


view(
    "masked", "scores eligible",
    """SELECT s.date, s.symbol, CASE WHEN e.eligible THEN s.prediction END AS prediction
       FROM scores s LEFT JOIN eligible e USING (date, symbol)""",
)


@query(
    "i3_eligible_portfolio", f"date:d {WEEKLY}",
    portfolio_sql(quintile_sql("masked"), "rets", source="masked"), "masked rets",
)
def eligible_portfolio(t):
    from crosspanel.operators.universe import mask_scores

    masked = stage(mask_scores(scores(t), universe_plans.eligible(t)))
    return portfolio.long_short(masked, returns(t), max_group=t.n_symbols)


@query("i4_turnover", "date:d turnover:8", "SELECT date, turnover FROM port", "port")
def turnover(t):
    return weekly_portfolio(t)


@query("i5_performance_metrics", METRICS, metrics_sql("port"), "port")
def performance_metrics(t):
    return portfolio.performance(weekly_portfolio(t))


@query("i6_reversal_baseline", "date:d symbol prediction:6", "SELECT * FROM scores", "scores")
def reversal_baseline(t):
    return scores(t)


@query(
    "i7_filtered_baseline", "date:d symbol prediction:6",
    """WITH e AS (SELECT date, list_distinct(quantile_cont(r1w, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges
         FROM r1w_weekly GROUP BY date),
       d AS (SELECT r.*, greatest(len(list_filter(e.edges, lambda x: x < r.r1w)) - 1, 0) AS decile FROM r1w_weekly r JOIN e USING (date)),
       kept AS (SELECT d.* FROM d LEFT JOIN revisions v USING (date, symbol)
         WHERE NOT coalesce((decile = 0 AND revision < 0) OR (decile = 9 AND revision > 0), false))
       SELECT date, symbol, -(r1w - avg(r1w) OVER (PARTITION BY date, sector)) AS prediction FROM kept JOIN profile USING (symbol)""",
    "r1w_weekly revisions profile",
)
def filtered_baseline(t):
    return portfolio.filtered_reversal_scores(weekly_r1w(t), factor_plans.revisions(t), t.profile, max_group=t.n_symbols)


MODELS = ["reversal", "trend", "cheap"]


def model_scores(t):
    """Three simple score sets in long form, from one pass over the grid."""
    df = factors.r1w(t.grid).withColumns(
        {"reversal": -F.col("R1W"), "trend": ts.change("px", 20), "cheap": -F.col("px")}
    )
    weekly = ts.weekly_last(df, MODELS)
    long = weekly.unpivot(["date", "symbol"], MODELS, "model", "prediction")
    return stage(long.filter("prediction is not null"))


view(
    "models", "grid",
    f"""SELECT date, symbol, model, prediction FROM (UNPIVOT (
          {factor_plans.weekly_sql(MODELS, "(SELECT *, -(px / lag(px, 5) OVER w - 1) AS reversal, px / lag(px, 20) OVER w - 1 AS trend, -px AS cheap FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY t))")}
        ) ON reversal, trend, cheap INTO NAME model VALUE prediction)""",
)
view("mquint", "models", quintile_sql("models", "model"))
view("mport", "mquint models rets", portfolio_sql("SELECT * FROM mquint", "rets", keys="model", source="models"))


def model_portfolios(t):
    return portfolio.long_short(model_scores(t), returns(t), keys=["model"], max_group=t.n_symbols)


@query("i8_per_model_portfolios", f"model date:d {WEEKLY}", "SELECT * FROM mport", "mport")
def per_model_portfolios(t):
    return model_portfolios(t)


@query("i8_per_model_metrics", f"model {METRICS}", metrics_sql("mport", "model"), "mport")
def per_model_metrics(t):
    return portfolio.performance(model_portfolios(t), ["model"])


COSTS = [0.0, 1.5, 5.0, 10.0, 20.0]


@query(
    "i9_cost_sweep", f"cost_bps:1 {METRICS}",
    metrics_sql(
        "(SELECT date, turnover, cost_bps, ls_return - turnover * cost_bps / 10000 * 2 AS ls_return_net FROM port "
        "CROSS JOIN (VALUES (0.0), (1.5), (5.0), (10.0), (20.0)) v(cost_bps))", "cost_bps"
    ),
    "port",
)
def cost_sweep(t):
    return portfolio.performance(portfolio.reprice(weekly_portfolio(t), COSTS), ["cost_bps"])


@query(
    "i10_matched_period_stats", f"model {METRICS} log_growth:6",
    "SELECT *, CASE WHEN cumulative_return > -1 THEN ln(1 + cumulative_return) END AS log_growth FROM (" + metrics_sql(
        "(SELECT * FROM mport WHERE date IN (SELECT date FROM mport GROUP BY date HAVING count(DISTINCT model) = 3))", "model"
    ) + ")",
    "mport",
)
def matched_period(t):
    out = portfolio.performance(portfolio.matched_weeks(model_portfolios(t)), ["model"])
    # The compounded return spans many powers of ten; its logarithm is what digits can compare.
    return out.withColumn("log_growth", F.log1p("cumulative_return"))


@query(
    "i11_common_start_growth", "model date:d log_growth:6 drawdown:6",
    """SELECT model, date, ln(g) AS log_growth, g / max(g) OVER (PARTITION BY model ORDER BY date) - 1 AS drawdown FROM (
         SELECT model, date, product(1 + ls_return_net) OVER (PARTITION BY model ORDER BY date) AS g FROM mport
         WHERE date >= (SELECT max(f) FROM (SELECT min(date) AS f FROM mport GROUP BY model)))""",
    "mport",
)
def common_start(t):
    return portfolio.common_start(model_portfolios(t)).withColumn("log_growth", F.ln("growth"))


LAGS = [0, 1, 2, 3, 4]
for _lag in LAGS:
    view(
        f"rets{_lag}", "grid",
        f"SELECT date, symbol, greatest(-0.3, least(0.3, ret)) AS ret FROM ({factor_plans.forward_sql(_lag)})",
    )
    view(f"port{_lag}", f"quint scores rets{_lag}", portfolio_sql("SELECT * FROM quint", f"rets{_lag}"))


@query(
    "i12_alpha_decay", f"lag:i {METRICS}",
    metrics_sql("(" + " UNION ALL ".join(f"SELECT *, {x} AS lag FROM port{x}" for x in LAGS) + ")", "lag"),
    " ".join(f"port{x}" for x in LAGS),
)
def alpha_decay(t):
    return portfolio.alpha_decay(t.bars, t.calendar, staged_scores(t), LAGS, max_group=t.n_symbols)


DAYS = ["MON", "TUE", "WED", "THU", "FRI"]
for _d in DAYS:
    view(
        f"sc_{_d}", "grid profile",
        f"""SELECT date, symbol, -(r - avg(r) OVER (PARTITION BY date, sector)) AS prediction FROM (
              SELECT {week('date', _d)} AS date, symbol, arg_max(r, t) AS r FROM (SELECT *, px / lag(px, 5) OVER (
                PARTITION BY symbol ORDER BY t) - 1 AS r FROM grid) WHERE r IS NOT NULL GROUP BY 1, 2) JOIN profile USING (symbol)""",
    )
    view(
        f"rt_{_d}", "grid",
        f"SELECT date, symbol, greatest(-0.3, least(0.3, ret)) AS ret FROM ({factor_plans.forward_sql(1, _d)})",
    )
    view(f"pt_{_d}", f"sc_{_d} rt_{_d}", portfolio_sql(quintile_sql(f"sc_{_d}"), f"rt_{_d}", source=f"sc_{_d}"))


@query(
    "i13_weekday_effect", f"signal_day {METRICS}",
    metrics_sql("(" + " UNION ALL ".join(f"SELECT *, '{d}' AS signal_day FROM pt_{d}" for d in DAYS) + ")", "signal_day"),
    " ".join(f"pt_{d}" for d in DAYS),
)
def weekday_effect(t):
    # A label falls on its signal day, so the portfolios have no date in common and are built as one.
    t.store_bars()
    weekly = ts.last_of_weeks(factors.r1w(t.grid), "R1W", t.calendar, DAYS)
    s = portfolio.reversal_scores(weekly, t.profile, max_group=t.n_symbols)
    s = stage(s.withColumn("signal_day", F.upper(F.date_format("date", "EEE"))))
    r = reduce(DataFrame.unionByName, [target.trade_returns(t.bars, t.calendar, day) for day in DAYS])
    p = portfolio.long_short(s, r, keys=["signal_day"], max_group=t.n_symbols)
    return portfolio.performance(p, ["signal_day"])


@query(
    "i14_portfolio_summary",
    "num_weeks:i date_first:d date_last:d annualized_return:3 annualized_volatility:3 information_ratio:2 max_drawdown:3 avg_weekly_turnover:3",
    f"""SELECT num_weeks, date_first, date_last, round(annualized_return, 4) AS annualized_return, round(annualized_volatility, 4) AS annualized_volatility,
          round(information_ratio, 3) AS information_ratio, round(max_drawdown, 4) AS max_drawdown, round(avg_weekly_turnover, 4) AS avg_weekly_turnover
        FROM ({metrics_sql('port')})""",
    "port",
)
def summary(t):
    return portfolio.portfolio_summary(weekly_portfolio(t))


# -- calibration ---------------------------------------------------------------------


def rank_scores(t, weekly=None):
    ranked = xs.pct_rank(scores(t, weekly), "prediction", name="pct", max_group=t.n_symbols)
    return ranked.select("date", "symbol", F.col("pct").alias("prediction"))


def staged_ranks(t, weekly=None):
    return t.staged("ranks", lambda: rank_scores(t, weekly))


def calibration_bins(t):
    weekly = ts.weekly_last(t.bars, ["close"])
    excess = calibration.excess_returns(weekly, t.n_symbols)
    return calibration.prediction_bins(staged_ranks(t), excess)


view(
    "pct_scores", "scores",
    """SELECT date, symbol, (rank() OVER (PARTITION BY date ORDER BY prediction) + (count(*) OVER (PARTITION BY date, prediction) - 1) / 2.0)
         / count(*) OVER (PARTITION BY date) AS prediction FROM scores""",
)
view(
    "excess", "bars",
    f"""SELECT date, symbol, fwd - avg(fwd) OVER (PARTITION BY date) AS ex_ret FROM (
          SELECT date, symbol, greatest(-0.5, least(0.5, CASE WHEN nd = date + 7 THEN nc / close - 1 END)) AS fwd, nd FROM (
            SELECT *, lead(date) OVER s AS nd, lead(close) OVER s AS nc FROM (
              SELECT {week('date')} AS date, symbol, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)
            WINDOW s AS (PARTITION BY symbol ORDER BY date)) WHERE nd = date + 7)""",
)
EDGES = "[" + ", ".join(str(i / 20) for i in range(21)) + "]"
view(
    "calib_bins", "pct_scores excess",
    f"""SELECT bin, avg(prediction) AS pred, avg(ex_ret) AS ex_ret, count(*) AS n FROM (
          SELECT j.*, greatest(len(list_filter(e.edges, lambda x: x < j.prediction)) - 1, 0) AS bin
          FROM (SELECT * FROM pct_scores JOIN excess USING (date, symbol)) j
          CROSS JOIN (SELECT list_distinct(quantile_cont(prediction, {EDGES})) AS edges FROM pct_scores JOIN excess USING (date, symbol)) e)
        GROUP BY bin""",
)
view(
    "calib", "calib_bins",
    """SELECT g.i / 100.0 AS prediction, CASE WHEN lo.pred IS NULL THEN hi.y WHEN hi.pred IS NULL THEN lo.y
         WHEN hi.pred = lo.pred THEN lo.y ELSE lo.y + (hi.y - lo.y) * (g.i / 100.0 - lo.pred) / (hi.pred - lo.pred) END AS exp_excess_ret
       FROM range(101) g(i)
       ASOF LEFT JOIN (SELECT i1.pred, max(m) AS y FROM calib_bins i1 JOIN (
           SELECT i.bin AS ib, j.bin AS jb, min((SELECT avg(x.ex_ret) FROM calib_bins x WHERE x.bin BETWEEN j.bin AND k.bin)) AS m
           FROM calib_bins i JOIN calib_bins j ON j.bin <= i.bin JOIN calib_bins k ON k.bin >= i.bin GROUP BY 1, 2) mm
           ON mm.ib = i1.bin GROUP BY i1.pred) lo ON g.i / 100.0 >= lo.pred
       ASOF LEFT JOIN (SELECT i1.pred, max(m) AS y FROM calib_bins i1 JOIN (
           SELECT i.bin AS ib, j.bin AS jb, min((SELECT avg(x.ex_ret) FROM calib_bins x WHERE x.bin BETWEEN j.bin AND k.bin)) AS m
           FROM calib_bins i JOIN calib_bins j ON j.bin <= i.bin JOIN calib_bins k ON k.bin >= i.bin GROUP BY 1, 2) mm
           ON mm.ib = i1.bin GROUP BY i1.pred) hi ON g.i / 100.0 < hi.pred""",
)


@query("i15_calibration_bins", "bin:i pred:6 ex_ret:7 n:i", "SELECT * FROM calib_bins", "calib_bins")
def bins(t):
    return calibration_bins(t)


@query("i15_calibration_grid", "prediction:4 exp_excess_ret:6", "SELECT * FROM calib", "calib")
def grid(t):
    return calibration.calibrate(calibration_bins(t))


@query(
    "i16_expected_return", "date:d symbol exp_excess_ret:6 annual:4",
    """SELECT s.date, s.symbol, e AS exp_excess_ret, pow(1 + e, 52) - 1 AS annual FROM (
         SELECT p.date, p.symbol, a.exp_excess_ret + coalesce(b.exp_excess_ret - a.exp_excess_ret, 0) * (p.prediction * 100 - floor(p.prediction * 100)) AS e
         FROM pct_scores p JOIN calib a ON CAST(round(a.prediction * 100) AS INTEGER) = CAST(floor(p.prediction * 100) AS INTEGER)
         LEFT JOIN calib b ON CAST(round(b.prediction * 100) AS INTEGER) = CAST(floor(p.prediction * 100) AS INTEGER) + 1) s""",
    "pct_scores calib",
)
def expected(t):
    table = calibration.calibrate(calibration_bins(t))
    out = calibration.expected_return(staged_ranks(t), table)
    return out.withColumn("annual", calibration.annualize_weekly(F.col("exp_excess_ret")))
