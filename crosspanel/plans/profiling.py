"""Queries for profiling and diagnostics."""

from itertools import combinations

from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import factors, features
from crosspanel.operators import profiling as p
from crosspanel.operators import target as tg
from crosspanel.plans import factors as factor_plans
from crosspanel.plans import portfolio as portfolio_plans
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view
from crosspanel.session import stage

COLS = ["R1W", "R1M", "R3M1M", "VOL6M"]


def four(t):
    """Four price factors, weekly, stored once for the multi-pass reports."""
    return t.staged("four", lambda: features.weekly_factors(t, COLS, "THU"))


view(
    "four", "w_e1 w_e3 w_e4",
    "SELECT date, symbol, R1W, R1M, R3M1M, VOL6M FROM w_e1 JOIN w_e3 USING (date, symbol) JOIN w_e4 USING (date, symbol)",
)
view(
    "four_long", "four",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT date, symbol, '{c}' AS factor, {c} AS value FROM four" for c in COLS) + ") WHERE value IS NOT NULL",
)


@query(
    "m1_factor_summary", "factor count:i mean:5 std:5 min:5 p5:5 p25:5 median:5 p75:5 p95:5 max:4",
    """SELECT factor, count(*) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.05) AS p5,
         quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95,
         max(value) AS max FROM four_long GROUP BY factor""",
    "four_long",
)
def factor_summary(t):
    return p.factor_summary(four(t), COLS, t.n_symbols * t.n_weeks)


@query(
    "m2_coverage_by_date", "date:d pct_non_null:5 avg_dollar_volume:2 smoothed:2",
    """SELECT date, pct AS pct_non_null, dv AS avg_dollar_volume, CASE WHEN count(dv) OVER w >= 21 THEN avg(dv) OVER w END AS smoothed FROM (
         SELECT date, count(close) * 100.0 / (SELECT count(DISTINCT symbol) FROM bars) AS pct, avg(close * volume) AS dv FROM bars GROUP BY date)
       WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
    "bars",
)
def coverage(t):
    n = t.trades.select("symbol").distinct().agg(F.count(F.lit(1))).scalar()
    return p.coverage_by_date(t.bars, n)


@query(
    "m3_histogram", "factor bin:i n:i",
    """SELECT factor, coalesce(least(floor((least(greatest(value, lo), hi) - lo) / nullif(hi - lo, 0) * 80), 79), 0) AS bin, count(*) AS n
       FROM four_long JOIN (SELECT factor, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM four_long GROUP BY 1) USING (factor)
       GROUP BY 1, 2""",
    "four_long",
)
def histogram(t):
    long = four(t).unpivot(["date", "symbol"], COLS, "factor", "value")
    return p.histogram(long, "value", 80, 0.01, 0.99, max_rows=t.n_symbols * t.n_weeks)


@query(
    "m4_dispersion_over_time", "date:d " + " ".join(f"{c}_mean:5 {c}_std:5" for c in COLS),
    "SELECT date, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in COLS) + " FROM four GROUP BY date",
    "four",
)
def dispersion(t):
    return p.dispersion(four(t), COLS)


def corr_sql(where: str, least: int = 4) -> str:
    parts = [
        f"SELECT date, '{a} / {b}' AS pair, corr({a}, {b}) AS corr FROM full_rows GROUP BY date HAVING count(*) > {least}"
        for a, b in combinations(COLS, 2)
    ]
    full = " AND ".join(f"{c} IS NOT NULL" for c in COLS)
    return f"WITH full_rows AS (SELECT * FROM four WHERE {full} AND {where}) " + " UNION ALL ".join(parts)


@query(
    "m5_factor_correlation", "date:d pair corr:6",
    corr_sql("date = (SELECT max(date) FROM (SELECT date FROM four GROUP BY date HAVING " + " AND ".join(f"count({c}) > 8" for c in COLS) + "))"),
    "four",
)
def factor_correlation(t):
    df = four(t)
    day = p.latest_full_date(df, COLS, 8).scalar()
    return p.pair_correlations(df.filter(F.col("date") == day), COLS, 4)


@query(
    "m6_correlation_over_time", "date:d pair corr:6",
    corr_sql("date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM four)) WHERE i % greatest(1, n // 52) = 0)"),
    "four",
)
def correlation_over_time(t):
    df = four(t)
    weeks = F.broadcast(p.sampled_weeks(df))
    return p.pair_correlations(df.join(weeks, "date", "left_semi"), COLS, 4)


# Every factor that the sample panel has for over 50 names in some week, at the thresholds that
# the reports use by default.  It trades on about a fifth of its days, so plain momentum has 36
# names at most, and no window of 126 days has 63 falling ones.
SPARSE = ("R1M", "R3M1M", "R6M1M", "R12M1M", "DOWNVOL6M", "UPDOWN1W_RATINGS")
ALL = [c for c in factor_plans.MATRIX if c not in SPARSE]


def all_corr_sql(where: str, least: int) -> str:
    full = " AND ".join(f"{c} IS NOT NULL" for c in ALL)
    long = " UNION ALL ".join(f"SELECT date, symbol, {i} AS i, '{c}' AS factor, {c} AS v FROM full_rows" for i, c in enumerate(ALL))
    return f"""WITH full_rows AS MATERIALIZED (SELECT * FROM matrix WHERE {full} AND {where}), long AS ({long})
        SELECT a.date, a.factor || ' / ' || b.factor AS pair, corr(a.v, b.v) AS corr FROM long a JOIN long b USING (date, symbol)
        WHERE a.i < b.i GROUP BY 1, 2 HAVING count(*) > {least}"""


def matrix(t, weeks):
    """The feature matrix of the listed weeks, stored."""
    t.store_bars()
    return stage(features.feature_matrix(t, ratings=factor_plans.marks(t), weeks=weeks)[0])


def latest_full_week(t, build, cols, min_names, at_once=52):
    """Rows of the latest week in which every column has more than ``min_names`` values; none without one.

    Weeks are built from the newest on, ``at_once`` first and twice as many each time after that,
    until some hold a full one: older weeks can't change which is the latest.
    """
    t.store_bars()
    weeks = t.calendar.select(ts.week_of("date").alias("date")).distinct().orderBy(F.desc("date")).collect()
    begin = 0
    while True:
        rows = build(t.spark.createDataFrame(weeks[begin:begin + at_once], "date date"))
        day = p.latest_full_date(rows, cols, min_names).first().date
        begin, at_once = begin + at_once, 2 * at_once
        if day is not None or begin >= len(weeks):
            return rows.filter(F.col("date") == F.lit(day).cast("date"))


@query(
    "m5_all_factor_correlation", "date:d pair corr:5",
    all_corr_sql("date = (SELECT max(date) FROM (SELECT date FROM matrix GROUP BY date HAVING "
                 + " AND ".join(f"count({c}) > 50" for c in ALL) + "))", 1),
    "matrix",
)
def all_factor_correlation(t):
    return p.pair_correlations(latest_full_week(t, lambda weeks: matrix(t, weeks), ALL, 50), ALL, 1)


@query(
    "m6_all_correlation_over_time", "date:d pair corr:5",
    all_corr_sql("date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n "
                 "FROM (SELECT DISTINCT date FROM matrix)) WHERE i % greatest(1, n // 52) = 0)", 30),
    "matrix",
)
def all_correlation_over_time(t):
    t.store_bars()
    # The matrix has a row in every week of the calendar, so the sampled weeks are known before it is built.
    weeks = p.sampled_weeks(t.calendar.select(ts.week_of("date").alias("date")))
    df = t.staged("sampled matrix", lambda: features.feature_matrix(t, ratings=factor_plans.marks(t), weeks=weeks)[0])
    return p.pair_correlations(df, ALL, 30)


def target(t):
    return tg.training_target(t.bars, t.calendar, max_group=t.n_symbols)


view(
    "target", "fwd",
    """SELECT * FROM (SELECT date, symbol, (ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0) AS target FROM fwd
       WINDOW d AS (PARTITION BY date)) WHERE target IS NOT NULL""",
)


@query(
    "m7_target_moments", "n:i mean:6 std:6 skew:5 kurtosis:4",
    "SELECT count(target) AS n, avg(target) AS mean, stddev_samp(target) AS std, skewness(target) AS skew, kurtosis(target) AS kurtosis FROM target",
    "target",
)
def target_moments(t):
    return p.moments(target(t), "target")


@query(
    "m8_weekly_dispersion", "date:d std:6",
    "SELECT date, stddev_samp(ret) AS std FROM fwd GROUP BY date", "fwd",
)
def weekly_dispersion(t):
    r = tg.forward_returns(tg.weekly_close(t.bars, t.calendar, lag=1), t.calendar)
    return r.groupBy("date").agg(F.stddev_samp("ret").alias("std"))


@query(
    "m9_source_overlap", "symbol status",
    """SELECT DISTINCT l_suppkey AS symbol, CASE WHEN l_suppkey IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'both' ELSE 'first only' END AS status
       FROM lineitem""",
)
def source_overlap(t):
    a = t.read("lineitem").select(F.col("l_suppkey").alias("symbol"))
    b = t.read("events").filter("event_type = 'error'").select(F.col("user_id").alias("symbol"))
    return p.overlap(a, b, "symbol")


@query("m10_sector_counts", "sector n:i", "SELECT sector, count(*) AS n FROM profile GROUP BY 1", "profile")
def sector_counts(t):
    return t.profile.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


@query(
    "m11_prediction_summary", "num_observations:i num_unique_dates:i",
    "SELECT count(*) AS num_observations, count(DISTINCT date) AS num_unique_dates FROM scores", "scores",
)
def prediction_summary(t):
    return p.prediction_summary(portfolio_plans.scores(t))


@query(
    "m12_top_features", "feature importance:6",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, target)) AS importance FROM four JOIN target USING (date, symbol)" for c in COLS)
    + ") ORDER BY importance DESC, feature LIMIT 3",
    "four target",
)
def top_features(t):
    joined = four(t).join(target(t), ["date", "symbol"])
    wide = joined.agg(*[F.abs(F.corr(c, "target")).alias(c) for c in COLS]).withColumn("k", F.lit(1))
    return p.top_features(wide.unpivot(["k"], COLS, "feature", "importance"), 3)
