"""Queries for the factor library, neutralization, target and sessions."""

from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import factors, features, fundamentals, neutralize, sessions, target
from crosspanel.plans import universe as universe_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view, week

W = "OVER (PARTITION BY symbol ORDER BY t)"


def f(rows: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def weekly_sql(cols, source: str, day: str = "THU", where: str = "px IS NOT NULL") -> str:
    """Weekly last non-null value of each column of a daily view."""
    picks = ", ".join(f'arg_max("{c}", t) FILTER (WHERE "{c}" IS NOT NULL) AS "{c}"' for c in cols)
    return f"SELECT {week('date', day)} AS date, symbol, {picks} FROM {source} WHERE {where} GROUP BY 1, 2"


def spec(cols, digits: int = 6) -> str:
    return "date:d symbol " + " ".join(f"{c}:{digits}" for c in cols)


# -- price factors ---------------------------------------------------------------

view("e1", "grid", f"SELECT *, px / lag(px, 5) {W} - 1 AS R1W FROM grid")


@query("e1_one_week_return", spec(["R1W"]), weekly_sql(["R1W"], "e1"), "e1")
def one_week_return(t):
    return ts.weekly_last(factors.r1w(t.grid), ["R1W"])


def rsi_sql() -> str:
    """The exponential mean written as one scaled running sum over the whole history."""
    moves = f"SELECT *, close - lag(close) {W} AS move, row_number() {W} AS k FROM grid"
    gains = (
        f"SELECT *, CASE WHEN move > 0 THEN move WHEN move <= 0 THEN 0 END AS g,"
        f" CASE WHEN move < 0 THEN -move WHEN move >= 0 THEN 0 END AS l, count(move) {W} AS c FROM ({moves})"
    )
    parts = []
    for name, n in (("RSI5D", 5), ("RSI14", 14), ("RSI30", 30)):
        q = f"pow({n - 1}.0 / {n}, -k)"
        ratio = f"sum(g * {q}) {W} / nullif(sum(l * {q}) {W}, 0)"
        parts.append(f"CASE WHEN c >= {n} THEN 100 - 100 / (1 + {ratio}) END AS {name}")
    return f"SELECT *, {', '.join(parts)} FROM ({gains})"


view("e2", "grid", rsi_sql())
RSI = ["RSI5D", "RSI14", "RSI30"]


@query("e2_relative_strength", spec(RSI), weekly_sql(RSI, "e2"), "e2")
def relative_strength(t):
    return ts.weekly_last(factors.rsi(t.grid), RSI)


MOM = list(factors.MOMENTUM)
view(
    "e3", "grid",
    "SELECT *, " + ", ".join(
        f"{'close' if skip == 0 else f'lag(close, {skip}) {W}'} / nullif(lag(close, {look}) {W}, 0) - 1 AS {n}"
        for n, (look, skip) in factors.MOMENTUM.items()
    ) + " FROM grid",
)


@query("e3_momentum", spec(MOM), weekly_sql(MOM, "e3"), "e3")
def momentum(t):
    return ts.weekly_last(factors.momentum(t.grid), MOM)


view(
    "e4", "grid",
    f"""SELECT *, CASE WHEN n6 >= 63 THEN s6 END * sqrt(252.0) AS VOL6M,
          CASE WHEN n12 >= 126 THEN s12 END * sqrt(252.0) AS VOL12M,
          CASE WHEN nd >= 63 THEN sd END * sqrt(252.0) AS DOWNVOL6M FROM (
        SELECT *, count(ret) {f(126)} AS n6, stddev_samp(ret) {f(126)} AS s6, count(ret) {f(252)} AS n12,
          stddev_samp(ret) {f(252)} AS s12, count(neg) {f(126)} AS nd, stddev_samp(neg) {f(126)} AS sd FROM (
        SELECT *, CASE WHEN ret < 0 THEN ret END AS neg FROM (
        SELECT *, px / lag(px) {W} - 1 AS ret FROM grid)))""",
)


def market(t):
    return factors.market_series(t.calendar, t.market)


@query("e4_volatility", spec(["VOL6M", "VOL12M"]), weekly_sql(["VOL6M", "VOL12M"], "e4"), "e4")
def volatility(t):
    return ts.weekly_last(factors.risk_factors(t.grid, market(t), full=False), ["VOL6M", "VOL12M"])


# The sample panel rarely has 63 falling days in 126, so this query asks for 10.
view(
    "e5", "grid",
    f"""SELECT *, CASE WHEN nd >= 10 THEN sd END * sqrt(252.0) AS DOWNVOL6M FROM (
        SELECT *, count(neg) {f(126)} AS nd, stddev_samp(neg) {f(126)} AS sd FROM (
        SELECT *, CASE WHEN ret < 0 THEN ret END AS neg FROM (
        SELECT *, px / lag(px) {W} - 1 AS ret FROM grid)))""",
)


view(
    "e5_default", "e5",
    "SELECT * EXCLUDE (DOWNVOL6M), CASE WHEN nd >= 63 THEN sd END * sqrt(252.0) AS DOWNVOL6M FROM e5",
)


@query("e5_downside_volatility_default", spec(["DOWNVOL6M"]), weekly_sql(["DOWNVOL6M"], "e5_default"), "e5_default")
def downside_default(t):
    return ts.weekly_last(factors.risk_factors(t.grid, market(t), full=False), ["DOWNVOL6M"])


@query("e5_downside_volatility", spec(["DOWNVOL6M"]), weekly_sql(["DOWNVOL6M"], "e5"), "e5")
def downside(t):
    df = factors.risk_factors(t.grid, market(t), full=False, min_negative=10)
    return ts.weekly_last(df, ["DOWNVOL6M"])


view(
    "mk", "cal market",
    """SELECT *, mkt / lag(mkt) OVER (ORDER BY t) - 1 AS mret, mkt / lag(mkt, 5) OVER (ORDER BY t) - 1 AS mret5,
         mkt / lag(mkt, 21) OVER (ORDER BY t) - 1 AS mret21, mkt / lag(mkt, 63) OVER (ORDER BY t) - 1 AS mret63,
         mkt / lag(mkt, 252) OVER (ORDER BY t) - 1 AS mret252
       FROM (SELECT date, t, mkt_close AS mkt FROM cal JOIN market USING (date))""",
)


def beta_sql(n: int, x: str = "ret", y: str = "mret") -> str:
    cov = f"(avg({x} * {y}) {f(n)} - avg({x}) {f(n)} * avg({y}) {f(n)})"
    full = f"count({x}) {f(n)} = {n} AND count({y}) {f(n)} = {n}"
    return f"CASE WHEN {full} THEN {cov} / nullif(var_samp({y}) {f(n)}, 0) END"


view(
    "beta", "grid mk",
    f"""SELECT *, {beta_sql(126)} AS BETA6M, {beta_sql(252)} AS BETA12M FROM (
        SELECT g.*, px / lag(px) OVER (PARTITION BY symbol ORDER BY g.t) - 1 AS ret, m.mret, m.mret5, m.mret21,
          m.mret63, m.mret252 FROM grid g JOIN mk m ON m.t = g.t)""",
)
view(
    "risk", "beta",
    f"""SELECT *, lag(res252, 21) {W} AS IMOM12M1M, lag(res63, 21) {W} AS IMOM3M1M,
          lag(res252, 21) {W} / nullif(IVOL12M, 0) AS IMOMVOL12M1M, lag(res63, 21) {W} / nullif(IVOL6M, 0) AS IMOMVOL3M1M,
          IREV1W / nullif(IVOL6M, 0) AS IREVVOL1W, IREV1M / nullif(IVOL6M, 0) AS IREVVOL1M FROM (
        SELECT *, CASE WHEN count(e6) {f(126)} >= 63 THEN stddev_samp(e6) {f(126)} END * sqrt(252.0) AS IVOL6M,
          CASE WHEN count(e12) {f(252)} >= 126 THEN stddev_samp(e12) {f(252)} END * sqrt(252.0) AS IVOL12M,
          px / lag(px, 5) {W} - 1 - BETA6M * mret5 AS IREV1W, px / lag(px, 21) {W} - 1 - BETA6M * mret21 AS IREV1M,
          px / lag(px, 63) {W} - 1 - BETA6M * mret63 AS res63, px / lag(px, 252) {W} - 1 - BETA6M * mret252 AS res252
        FROM (SELECT *, coalesce(ret - BETA6M * mret, ret) AS e6, coalesce(ret - BETA12M * mret, ret) AS e12 FROM beta))""",
)


def risk_query(name: str, cols: list[str], digits: int = 5):
    @query(name, spec(cols, digits), weekly_sql(cols, "risk"), "risk")
    def build(t):
        return ts.weekly_last(factors.risk_factors(t.grid, market(t)), cols)

    return build


risk_query("e6_market_beta", ["BETA6M", "BETA12M"])
risk_query("e7_residual_reversal", ["IREV1W", "IREV1M"])
risk_query("e9_idiosyncratic_volatility", ["IVOL6M", "IVOL12M"])
risk_query("e10_residual_momentum", ["IMOM12M1M", "IMOM3M1M"])
risk_query("e11_risk_scaled", ["IMOMVOL12M1M", "IMOMVOL3M1M", "IREVVOL1W", "IREVVOL1M"])


@query(
    "e8_residual_reversal_without_alignment", "date:d symbol irev:5",
    weekly_sql(["irev"], f"(SELECT *, px / lag(px, 5) {W} - 1 - BETA6M * mret5 AS irev FROM beta)"), "beta",
)
def irev_plain(t):
    df = factors.risk_factors(t.grid, market(t), full=False)
    df = df.withColumn("irev", ts.change("px", 5) - F.col("BETA6M") * F.col("mkt_ret5"))
    return ts.weekly_last(df, ["irev"])


@query(
    "e7_reversal_without_market", "date:d symbol IREV1W:6 IREV1M:6",
    weekly_sql(["IREV1W", "IREV1M"], f"(SELECT *, px / lag(px, 5) {W} - 1 AS IREV1W, close / nullif(lag(close, 21) {W}, 0) - 1 AS IREV1M FROM grid)"),
    "grid",
)
def reversal_without_market(t):
    df = factors.momentum(factors.r1w(t.grid))
    df = df.withColumnsRenamed({"R1W": "IREV1W", "R1M": "IREV1M"})
    return ts.weekly_last(df, ["IREV1W", "IREV1M"])


# -- fundamentals -----------------------------------------------------------------

TTM = ", ".join(
    f"CASE WHEN count({a}) OVER q = 4 THEN sum({a}) OVER q END AS {b}" for a, b in fundamentals.TRAILING.items()
)
view(
    "reports", "statements",
    f"""SELECT *, ni_ttm / nullif(shares, 0) AS eps_ttm, total_equity / nullif(shares, 0) AS bvps,
          ni_ttm / nullif(total_equity, 0) AS ROE, gp_ttm / nullif(total_assets, 0) AS GPOA,
          nullif(total_debt, 0) / nullif(total_equity, 0) AS DE, (total_debt - cash) / nullif(total_equity, 0) AS NDE,
          ebit_ttm / nullif(int_ttm, 0) AS EBIT_COVER,
          revenue / nullif(lag(revenue, 4) OVER s, 0) - 1 AS SALES_GROWTH_YOY,
          ((current_assets - cash) - lag(current_assets - cash) OVER s
            - ((current_liabilities - short_term_debt) - lag(current_liabilities - short_term_debt) OVER s))
            / nullif(total_assets, 0) AS ACCRUALS
        FROM (SELECT *, {TTM} FROM statements
              WINDOW q AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
        WINDOW s AS (PARTITION BY symbol ORDER BY date)""",
)
CARRIED = [*fundamentals.TRAILING.values(), *fundamentals.STOCK_ITEMS, *fundamentals.REPORT_RATIOS]
view(
    "known", "grid reports",
    "SELECT symbol, t, date, close, px, "
    + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in CARRIED)
    + " FROM (SELECT g.symbol, g.t, g.date, g.close, g.px, "
    + ", ".join(f"CASE WHEN g.t = r.first_t THEN r.{c} END AS {c}" for c in CARRIED)
    + """ FROM grid g LEFT JOIN (SELECT rp.*, (SELECT min(c.t) FROM cal c WHERE c.date >= rp.date + 90) AS first_t
           FROM reports rp) r ON r.symbol = g.symbol AND r.first_t = g.t)
        WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
view(
    "fund", "known",
    """SELECT *, close / nullif(eps_ttm, 0) AS PE, close / nullif(bvps, 0) AS PB, ln(mktcap) AS SIZE,
         sales_ttm / mktcap AS PSALES, sales_ttm / ev AS EVSALES, ebit_ttm / ev AS EVEBIT, ebitda_ttm / ev AS EVEBITDA,
         (coalesce(total_equity, 0) - coalesce(intangibles, 0)) / mktcap AS PTB, ni_ttm / nullif(total_assets, 0) AS ROA,
         gp_ttm / nullif(sales_ttm, 0) AS GROSSMARGIN, ni_ttm / invested AS ROIC, op / nullif(total_assets, 0) AS OPRDA,
         op / invested AS OPRDIC, ebit_ttm / nullif(fixed, 0) AS GBROC, total_debt / nullif(ebitda_ttm, 0) AS DEBITDA,
         long_term_debt / nullif(total_equity, 0) AS LTDE, long_term_debt / nullif(ebitda_ttm, 0) AS LTDEBITDA,
         (coalesce(total_debt, 0) - coalesce(cash, 0)) / nullif(ebitda_ttm, 0) AS NDEBITDA,
         (coalesce(issued_ttm, 0) + coalesce(bought_ttm, 0)) / mktcap AS STKP, ocf_ttm / mktcap AS POCF,
         fcf_ttm / mktcap AS PFCF, ocf_ttm / ev AS EVOCF, fcf_ttm / ev AS EVFCF, fcf_ttm / invested AS FCFROIC,
         capex_ttm / nullif(ppe, 0) AS CAPEXPPE
       FROM (SELECT *, nullif(coalesce(mktcap, 0) + coalesce(total_debt, 0) - coalesce(cash, 0), 0) AS ev,
           nullif(coalesce(total_equity, 0) + coalesce(long_term_debt, 0), 0) AS invested,
           coalesce(ebitda_ttm, 0) + coalesce(rd_ttm, 0) AS op,
           coalesce(ppe, 0) + coalesce(current_assets, 0) - coalesce(current_liabilities, 0) AS fixed
         FROM (SELECT *, CASE WHEN close * shares > 0 THEN close * shares END AS mktcap FROM known))""",
)


def fundamental_query(name: str, cols: list[str], digits: int = 6):
    @query(name, spec(cols, digits), weekly_sql(cols, "fund"), "fund")
    def build(t):
        daily = fundamentals.daily_fundamentals(t.grid, t.statements, t.calendar)
        return ts.weekly_last(daily, cols)

    return build


fundamental_query("e12_price_multiples", ["PE", "PB"], 5)
fundamental_query("e13_returns_on_capital", ["ROE", "GPOA"])
fundamental_query("e14_leverage", ["DE", "NDE"])
fundamental_query("e15_interest_cover", ["EBIT_COVER"])
fundamental_query("e16_sales_growth", ["SALES_GROWTH_YOY"])
fundamental_query("e17_accruals", ["ACCRUALS"])
fundamental_query("e18_size", ["SIZE"])
fundamental_query("e19_enterprise_value", ["ev"], 0)
fundamental_query("e20_value_ratios", ["PSALES", "EVSALES", "EVEBIT", "EVEBITDA", "PTB"])
fundamental_query("e21_profitability", ["ROA", "GROSSMARGIN", "ROIC", "OPRDA", "OPRDIC", "GBROC"])
fundamental_query("e22_debt_ratios", ["DEBITDA", "LTDE", "LTDEBITDA", "NDEBITDA"])
fundamental_query("e23_net_issuance", ["STKP"])
fundamental_query("e24_cash_flow_ratios", fundamentals.OPTIONAL_FACTORS)

FOUR = ["PE", "PB", "ROE", "GPOA"]


@query(
    "e25_four_ratio_path", spec(FOUR, 5),
    weekly_sql(
        FOUR,
        """(SELECT symbol, t, date, px, close / nullif(net_income / nullif(shares, 0), 0) AS PE,
              close / nullif(total_equity / nullif(shares, 0), 0) AS PB,
              net_income / nullif(total_equity, 0) AS ROE, gross_profit / nullif(total_assets, 0) AS GPOA
            FROM grid g ASOF LEFT JOIN (SELECT symbol AS s, date + 90 AS eff, net_income, gross_profit, total_equity,
              total_assets, shares FROM statements) r ON r.s = g.symbol AND g.date >= r.eff)""",
    ),
    "grid statements",
)
def four_ratio_path(t):
    return ts.weekly_last(fundamentals.four_ratios(t.grid, t.statements, t.calendar), FOUR)


@query(
    "e26_rating_balance", "date:d symbol UPDOWN1W_RATINGS:6",
    """WITH days AS (SELECT DISTINCT date FROM ratings WHERE isodow(date) <= 5),
       counts AS (SELECT symbol, date, sum(CASE action WHEN 'upgrade' THEN 1 WHEN 'downgrade' THEN -1 ELSE 0 END) AS net,
           count(*) AS total FROM ratings GROUP BY 1, 2)
       SELECT date, symbol, coalesce(sum(net) OVER w / nullif(sum(total) OVER w, 0), 0) AS UPDOWN1W_RATINGS
       FROM (SELECT d.date, s.symbol, s.first, coalesce(c.net, 0) AS net, coalesce(c.total, 0) AS total
             FROM days d CROSS JOIN (SELECT symbol, min(date) AS first FROM ratings WHERE isodow(date) <= 5 GROUP BY 1) s
             LEFT JOIN counts c ON c.date = d.date AND c.symbol = s.symbol)
       WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)
       QUALIFY date >= first""",
    "ratings",
)
def rating_balance(t):
    # Weekend events are off this calendar and are dropped, as events between sessions are.
    weekdays = t.ratings.filter(F.weekday("date") < 5)
    return factors.rating_balance(t.ratings, ts.calendar(weekdays))


def marks(t):
    """Dated up and down marks per symbol, from return flags."""
    mark = F.when(F.col("l_returnflag") == "A", "upgrade").when(
        F.col("l_returnflag") == "R", "downgrade"
    ).otherwise("maintain")
    return t.read("lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), mark.alias("action")
    )


def revisions(t):
    """Weekly balance of up and down marks per symbol."""
    weekly = ts.weekly_last(factors.rating_balance(marks(t), t.calendar), ["UPDOWN1W_RATINGS"])
    return weekly.withColumnRenamed("UPDOWN1W_RATINGS", "revision")


view(
    "revisions", "cal symbols",
    f"""SELECT {week('date')} AS date, symbol, arg_max(rev, date) AS revision FROM (
          SELECT c.date, s.symbol, coalesce(sum(k.net) OVER w / nullif(sum(k.total) OVER w, 0), 0) AS rev
          FROM cal c CROSS JOIN symbols s LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol,
            sum(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END) AS net, count(*) AS total FROM lineitem GROUP BY 1, 2) k
            ON k.date = c.date AND k.symbol = s.symbol
          WINDOW w AS (PARTITION BY s.symbol ORDER BY c.date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW))
        GROUP BY 1, 2""",
)


# -- macro ------------------------------------------------------------------------

MACRO_NAMES = list(features.MACROS.values())
view(
    "mac", "cal macro",
    "SELECT c.date, c.t, "
    + ", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in MACRO_NAMES)
    + " FROM cal c LEFT JOIN (SELECT date, "
    + ", ".join(f"max(value) FILTER (WHERE series = '{s}') AS {n}" for s, n in features.MACROS.items())
    + " FROM macro GROUP BY date) m USING (date)"
    + " WINDOW w AS (ORDER BY c.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
HALF = "OVER (ORDER BY t ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)"
Z = {
    n: f"CASE WHEN count({n}) {HALF} >= 63 THEN ({n} - avg({n}) {HALF}) / nullif(stddev_samp({n}) {HALF}, 0) END"
    for n in MACRO_NAMES
}


@query(
    "e27_macro_moves", "date:d " + " ".join(f"{n}_R5:6 {n}_D5:2" for n in MACRO_NAMES),
    "SELECT date, " + ", ".join(
        f"{n} / nullif(lag({n}, 5) OVER (ORDER BY t), 0) - 1 AS {n}_R5, {n} - lag({n}, 5) OVER (ORDER BY t) AS {n}_D5"
        for n in MACRO_NAMES
    ) + " FROM mac",
    "mac",
)
def macro_moves(t):
    return factors.raw_moves(features.macro_on_calendar(t), MACRO_NAMES, MACRO_NAMES)


@query(
    "e28_macro_zscore", "date:d " + " ".join(f"{n}_Z:6" for n in MACRO_NAMES),
    "SELECT date, " + ", ".join(f"{z} AS {n}_Z" for n, z in Z.items()) + " FROM mac",
    "mac",
)
def macro_zscore(t):
    return factors.macro_zscore(features.macro_on_calendar(t), MACRO_NAMES)


FLAGS = [f"{n}_{k}" for n in MACRO_NAMES for k in ("HI", "TREND_UP")]
view(
    "flags", "mac",
    "SELECT date, t, " + ", ".join(
        f"CASE WHEN {Z[n]} > 1 THEN 1.0 ELSE 0.0 END AS {n}_HI, CASE WHEN count({n}) {HALF} >= 63"
        f" AND {n} > median({n}) {HALF} THEN 1.0 ELSE 0.0 END AS {n}_TREND_UP"
        for n in MACRO_NAMES
    ) + " FROM mac",
)


@query("e29_regime_flags", "date:d " + " ".join(f"{c}:1" for c in FLAGS), "SELECT * FROM flags", "flags")
def regime_flags(t):
    return factors.regime_flags(features.macro_on_calendar(t), MACRO_NAMES)


BETAS = [f"BETA_{n}" for n in MACRO_NAMES]
view(
    "macbeta", "grid mac",
    "SELECT *, " + ", ".join(f"{beta_sql(126, 'ret', f'r_{n}')} AS BETA_{n}" for n in MACRO_NAMES) + ", "
    + ", ".join(
        f"""CASE WHEN count(ret) {f(126)} = 126 AND count(r_{n}) {f(126)} = 126 THEN
            (avg(ret * r_{n}) {f(126)} - avg(ret) {f(126)} * avg(r_{n}) {f(126)})
            / nullif(sqrt(var_samp(ret) {f(126)} * var_samp(r_{n}) {f(126)}), 0) END AS CORR_{n}"""
        for n in MACRO_NAMES
    )
    + f""" FROM (SELECT g.*, px / lag(px) OVER (PARTITION BY symbol ORDER BY g.t) - 1 AS ret, """
    + ", ".join(f"r_{n}" for n in MACRO_NAMES)
    + " FROM grid g JOIN (SELECT t, "
    + ", ".join(f"{n} / nullif(lag({n}) OVER (ORDER BY t), 0) - 1 AS r_{n}" for n in MACRO_NAMES)
    + " FROM mac) m ON m.t = g.t)",
)


@query("e30_macro_beta", spec(BETAS, 5), weekly_sql(BETAS, "macbeta"), "macbeta")
def macro_beta(t):
    df = factors.series_sensitivity(t.grid, features.macro_on_calendar(t), MACRO_NAMES)
    return ts.weekly_last(df, BETAS)


CORRS = [f"CORR_{n}" for n in MACRO_NAMES]


@query("e31_macro_correlation", spec(CORRS), weekly_sql(CORRS, "macbeta"), "macbeta")
def macro_corr(t):
    df = factors.series_sensitivity(t.grid, features.macro_on_calendar(t), MACRO_NAMES, corr=True)
    return ts.weekly_last(df, CORRS)


@query(
    "e32_broadcast_moves", "date:d symbol URGENT_R5:6 LOW_D5:2",
    """SELECT b.date, b.symbol, URGENT_R5, LOW_D5 FROM bars b JOIN (SELECT date,
         URGENT / nullif(lag(URGENT, 5) OVER (ORDER BY t), 0) - 1 AS URGENT_R5,
         LOW - lag(LOW, 5) OVER (ORDER BY t) AS LOW_D5 FROM mac) USING (date)""",
    "bars mac",
)
def broadcast_moves(t):
    moves = factors.raw_moves(features.macro_on_calendar(t), ["URGENT"], ["LOW"])
    return t.bars.join(F.broadcast(moves), "date")


PASS = [*FLAGS, "URGENT_R5", "HIGH_R5", "LOW_D5"]
view("w_e2", "e2", weekly_sql(RSI, "e2"))
view("w_e1", "e1", weekly_sql(["R1W"], "e1"))
view("w_e3", "e3", weekly_sql(MOM, "e3"))
view("w_e4", "e4", weekly_sql(["VOL6M", "VOL12M", "DOWNVOL6M"], "e4"))
view("w_risk", "risk", weekly_sql(factors.MARKET_FACTORS, "risk"))
view("w_mac", "macbeta", weekly_sql(BETAS, "macbeta"))
view("w_fund", "fund", weekly_sql(fundamentals.FACTORS, "fund"))
view(
    "w_pass", "flags mac",
    f"SELECT {week('date')} AS date, " + ", ".join(
        f"arg_max({c}, t) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in PASS
    ) + """ FROM flags JOIN (SELECT t, URGENT / nullif(lag(URGENT, 5) OVER (ORDER BY t), 0) - 1 AS URGENT_R5,
             HIGH / nullif(lag(HIGH, 5) OVER (ORDER BY t), 0) - 1 AS HIGH_R5,
             LOW - lag(LOW, 5) OVER (ORDER BY t) AS LOW_D5 FROM mac) USING (t) GROUP BY 1""",
)
view(
    "matrix", "w_e1 w_e2 w_e3 w_e4 w_risk w_mac w_fund w_pass revisions",
    """SELECT *, revision AS UPDOWN1W_RATINGS FROM w_e1 JOIN w_e2 USING (date, symbol) JOIN w_e3 USING (date, symbol) JOIN w_e4 USING (date, symbol)
       JOIN w_risk USING (date, symbol) JOIN w_mac USING (date, symbol) JOIN w_fund USING (date, symbol)
       JOIN w_pass USING (date) JOIN revisions USING (date, symbol)""",
)
MATRIX = features.feature_columns(with_ratings=True)


@query("e33_feature_matrix", spec([*MATRIX, *PASS], 4), "SELECT * FROM matrix", "matrix")
def feature_matrix(t):
    return features.feature_matrix(t, ratings=marks(t))[0]


WHITELIST = ["R1W", "RSI14", "R1M", "VOL6M", "BETA6M", "NOT_A_FACTOR"]


@query(
    "b13_feature_whitelist", spec(WHITELIST[:-1], 5),
    "SELECT date, symbol, " + ", ".join(WHITELIST[:-1]) + " FROM w_e1 JOIN w_e2 USING (date, symbol) JOIN w_e3 USING (date, symbol) JOIN w_e4 USING (date, symbol) JOIN w_risk USING (date, symbol)",
    "w_e1 w_e2 w_e3 w_e4 w_risk",
)
def whitelist(t):
    return features.feature_matrix(t, whitelist=WHITELIST, with_reports=False)[0]


# -- normalization ---------------------------------------------------------------

SMALL = ["R1W", "VOL6M", "BETA6M", "IREV1W", "ROE", "SIZE", "PE", "EBIT_COVER"]
SMALL_PASS = ["URGENT_HI", "URGENT_R5"]


def small_matrix(t):
    """Eight factors and two passthrough columns: the input of the normalization queries."""
    weekly = features.weekly_factors(t, SMALL, "THU")
    daily, _ = features.macro_features(t)
    common = ts.weekly_last(daily, SMALL_PASS, keys=())
    return weekly.join(F.broadcast(common), "date", "left")


view(
    "small", "w_e1 w_e4 w_risk w_fund w_pass",
    "SELECT date, symbol, " + ", ".join(SMALL + SMALL_PASS)
    + """ FROM w_e1 JOIN w_e4 USING (date, symbol) JOIN w_risk USING (date, symbol)
         JOIN w_fund USING (date, symbol) JOIN w_pass USING (date)""",
)


def neutral_sql(cols) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.02) AS {c}_lo, quantile_cont({c}, 0.98) AS {c}_hi" for c in cols)
    wins = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END AS {c}" for c in cols)
    z = ", ".join(f"({c} - avg({c}) OVER d) / nullif(stddev_samp({c}) OVER d, 0) AS {c}" for c in cols)
    cap = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, -3), 3) END AS {c}" for c in cols)
    med = ", ".join(f"{c} - median({c}) OVER (PARTITION BY date, industry) AS {c}" for c in cols)
    keep = ", ".join(SMALL_PASS)
    return f"""WITH q AS (SELECT date, {q} FROM small GROUP BY date),
      w AS (SELECT date, symbol, {keep}, {wins} FROM small JOIN q USING (date)),
      z AS (SELECT date, symbol, {keep}, {z} FROM w WINDOW d AS (PARTITION BY date)),
      c AS (SELECT date, symbol, {keep}, coalesce(industry, 'Unknown') AS industry, {cap} FROM z LEFT JOIN profile USING (symbol)),
      m AS (SELECT date, symbol, {keep}, {med} FROM c)"""


MISSING = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in SMALL + SMALL_PASS)


@query(
    "f1_neutralize", spec(SMALL + SMALL_PASS, 5),
    neutral_sql(SMALL) + " SELECT date, symbol, "
    + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in SMALL + SMALL_PASS) + f" FROM m WHERE {MISSING} <= 3",
    "small profile",
)
def neutralized(t):
    return neutralize.neutralize(
        small_matrix(t), t.profile, SMALL, SMALL_PASS, max_missing=3, max_group=t.n_symbols
    )


@query(
    "f2_winsorize_over_time", "date:d symbol r:6",
    """SELECT date, symbol, least(greatest(R1W, lo), hi) AS r FROM w_e1 JOIN (SELECT symbol,
         quantile_cont(R1W, 0.02) AS lo, quantile_cont(R1W, 0.98) AS hi FROM w_e1 GROUP BY symbol) USING (symbol)
       WHERE R1W IS NOT NULL""",
    "w_e1",
)
def winsorize_over_time(t):
    weekly = ts.weekly_last(factors.r1w(t.grid), ["R1W"]).withColumnRenamed("R1W", "r")
    return neutralize.winsorize_over_time(weekly, ["r"], max_rows=t.n_weeks).filter("r is not null")


@query(
    "f3_zscore", "date:d symbol z:6",
    """SELECT date, symbol, (R1W - avg(R1W) OVER d) / nullif(stddev_samp(R1W) OVER d, 0) AS z FROM w_e1
       WINDOW d AS (PARTITION BY date)""",
    "w_e1",
)
def zscore(t):
    weekly = ts.weekly_last(factors.r1w(t.grid), ["R1W"]).withColumnRenamed("R1W", "z")
    return xs.zscore(weekly, ["z"], max_group=t.n_symbols)


def iterate_sql(n: int) -> str:
    sql = "SELECT date, symbol, R1W AS z FROM w_e1"
    for _ in range(n):
        sql = f"SELECT date, symbol, (z - avg(z) OVER d) / nullif(stddev_samp(z) OVER d, 0) AS z FROM ({sql}) WINDOW d AS (PARTITION BY date)"
    return sql


@query("f4_iterated_zscore", "date:d symbol z:6", iterate_sql(10), "w_e1")
def iterated_zscore(t):
    # Ten rounds in the SQL; z-scoring is idempotent, so one round is the same result.
    return zscore(t)


@query(
    "f5_industry_neutral", "date:d symbol r:6",
    """SELECT date, symbol, CASE WHEN count(*) OVER g > 1 THEN R1W - median(R1W) OVER g ELSE R1W END AS r
       FROM w_e1 JOIN profile USING (symbol) WINDOW g AS (PARTITION BY date, industry)""",
    "w_e1 profile",
)
def industry_neutral(t):
    weekly = ts.weekly_last(factors.r1w(t.grid), ["R1W"]).withColumnRenamed("R1W", "r")
    df = weekly.join(t.profile.select("symbol", "industry"), "symbol")
    return xs.subtract_median(df, ["r"], ["date", "industry"], t.n_symbols, min_size=2)


@query(
    "f6_full_neutralization", "date:d symbol r:5",
    """WITH w AS (SELECT date, symbol, least(greatest(R1W, lo), hi) AS r FROM w_e1 JOIN (SELECT symbol,
         quantile_cont(R1W, 0.02) AS lo, quantile_cont(R1W, 0.98) AS hi FROM w_e1 GROUP BY symbol) USING (symbol)
         WHERE R1W IS NOT NULL),
       z AS (SELECT date, symbol, (r - avg(r) OVER d) / nullif(stddev_samp(r) OVER d, 0) AS r FROM w WINDOW d AS (PARTITION BY date))
       SELECT date, symbol, CASE WHEN count(*) OVER g > 1 THEN r - median(r) OVER g ELSE r END AS r
       FROM z JOIN profile USING (symbol) WINDOW g AS (PARTITION BY date, industry)""",
    "w_e1 profile",
)
def full_neutralization(t):
    weekly = ts.weekly_last(factors.r1w(t.grid), ["R1W"]).withColumnRenamed("R1W", "r")
    weekly = weekly.filter("r is not null")
    return neutralize.full_neutralization(weekly, t.profile, ["r"], t.n_weeks, t.n_symbols)


# -- target and returns -------------------------------------------------------------


def weekly_close_sql(lag: int, day: str = "THU") -> str:
    """Weekly last close of the dense panel shifted ahead by ``lag`` rows, carried forward."""
    return f"""SELECT date, symbol, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM (
        SELECT {week('date', day)} AS date, symbol, arg_max(sc, t) FILTER (WHERE sc IS NOT NULL) AS c FROM (
        SELECT date, t, symbol, lead(close, {lag}) {W} AS sc FROM grid) GROUP BY 1, 2)"""


def forward_sql(lag: int, day: str = "THU") -> str:
    return f"""SELECT date, symbol, ret FROM (SELECT date, symbol,
          lead(c) OVER (PARTITION BY symbol ORDER BY date) / c - 1 AS ret FROM ({weekly_close_sql(lag, day)}))
        WHERE ret IS NOT NULL"""


view("fwd", "grid", forward_sql(1))


@query(
    "g1_training_target", "date:d symbol target:6",
    """SELECT * FROM (SELECT date, symbol, (ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0) AS target FROM fwd
       WINDOW d AS (PARTITION BY date)) WHERE target IS NOT NULL""",
    "fwd",
)
def training_target(t):
    return target.training_target(t.bars, t.calendar, max_group=t.n_symbols)


@query(
    "g2_trade_returns", "date:d symbol ret:8",
    "SELECT date, symbol, greatest(-0.3, least(0.3, ret)) AS ret FROM fwd", "fwd",
)
def trade_returns(t):
    return target.trade_returns(t.bars, t.calendar)


@query(
    "g3_lag_zero_returns", "date:d symbol ret:8",
    f"SELECT date, symbol, greatest(-0.3, least(0.3, ret)) AS ret FROM ({forward_sql(0)})", "grid",
)
def lag_zero_returns(t):
    return target.trade_returns(t.bars, t.calendar, lag=0, diagnostic=True)


@query("g4_weekly_adv", "date:d symbol adv:2", "SELECT date, symbol, adv FROM weekly_levels", "weekly_levels")
def weekly_adv(t):
    return universe_plans.weekly_levels(t)


view(
    "region_days", "bars profile cal",
    """SELECT * FROM (SELECT date, region, n, median(n) OVER (PARTITION BY region ORDER BY date
         ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS norm FROM (
         SELECT c.date, r.region, coalesce(k.n, 0) AS n FROM cal c CROSS JOIN (SELECT DISTINCT region FROM profile) r
         LEFT JOIN (SELECT date, region, count(close) AS n FROM bars JOIN profile USING (symbol) GROUP BY 1, 2) k
         ON k.date = c.date AND k.region = r.region))
       WHERE n >= 0.6 * norm AND n > 0""",
)


@query(
    "g5_sessions", "date:d n:i norm:2",
    """SELECT * FROM (SELECT date, n, median(n) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS norm
         FROM (SELECT date, count(close) AS n FROM bars GROUP BY date)) WHERE n >= 0.8 * norm AND n > 0""",
    "bars",
)
def observed_sessions(t):
    return sessions.sessions(t.bars, t.calendar, min_frac=0.8)


@query(
    "g5_sessions_default", "date:d n:i norm:2",
    """SELECT * FROM (SELECT date, n, median(n) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS norm
         FROM (SELECT date, count(close) AS n FROM bars GROUP BY date)) WHERE n >= 0.2 * norm AND n > 0""",
    "bars",
)
def observed_sessions_default(t):
    return sessions.sessions(t.bars, t.calendar)


@query(
    "g6_sessions_by_region_default", "date:d region n:i norm:2",
    """SELECT * FROM (SELECT date, region, n, median(n) OVER (PARTITION BY region ORDER BY date
         ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS norm FROM (
         SELECT c.date, r.region, coalesce(k.n, 0) AS n FROM cal c CROSS JOIN (SELECT DISTINCT region FROM profile) r
         LEFT JOIN (SELECT date, region, count(close) AS n FROM bars JOIN profile USING (symbol) GROUP BY 1, 2) k
         ON k.date = c.date AND k.region = r.region))
       WHERE n >= 0.2 * norm AND n > 0""",
    "bars profile cal",
)
def sessions_by_region_default(t):
    by_region = t.bars.join(t.profile.select("symbol", "region"), "symbol")
    return sessions.sessions(by_region, t.calendar, "region")


def region_sessions(t):
    by_region = t.bars.join(t.profile.select("symbol", "region"), "symbol")
    return sessions.sessions(by_region, t.calendar, "region", min_frac=0.6)


@query("g6_sessions_by_region", "date:d region n:i norm:2", "SELECT * FROM region_days", "region_days")
def sessions_by_region(t):
    return region_sessions(t)


def nominal_weeks(t):
    weeks = t.calendar.select(ts.week_of("date").alias("nominal")).distinct()
    regions = F.explode(F.array(*[F.lit(r) for r in ("AMERICA", "EUROPE", "ASIA", "NOWHERE")]))
    return weeks.withColumn("region", regions)


RESOLVED = f"""SELECT nominal, region, (SELECT arg_min(d.date, CASE WHEN d.date <= nominal THEN nominal - d.date
           ELSE 10 + (d.date - nominal) END) FROM region_days d WHERE d.region = nm.region
           AND d.date BETWEEN nominal - 3 AND nominal + 3) AS session
         FROM (SELECT DISTINCT {week('date')} AS nominal, region FROM cal
               CROSS JOIN (VALUES ('AMERICA'), ('EUROPE'), ('ASIA'), ('NOWHERE')) v(region)) nm"""


@query("g7_resolve_session", "nominal:d region session:d", RESOLVED, "region_days cal")
def resolve(t):
    return sessions.resolve_session(nominal_weeks(t), region_sessions(t), "region")


@query(
    "g8_region_trade_dates", "nominal:d region trade_date:d",
    f"""SELECT nominal, region, CASE WHEN l.last IS NULL OR l.last < nominal THEN nominal ELSE coalesce(session, nominal) END
          AS trade_date FROM ({RESOLVED}) LEFT JOIN (SELECT region, max(date) AS last FROM region_days GROUP BY 1) l USING (region)""",
    "region_days cal",
)
def trade_dates(t):
    return sessions.region_trade_dates(nominal_weeks(t), region_sessions(t))
