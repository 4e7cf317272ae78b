"""Queries for universe filters, membership and eligibility."""

from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.operators import factors
from crosspanel.operators import universe as u
from crosspanel.plans.registry import query
from crosspanel.plans.sql import view, week

# The sample panel trades on a fifth of its days, so the volume window is longer here.
ADV_ROWS, ADV_MIN = 378, 40

# Regions play the part of listing regions; AMERICA is the point-in-time one.
PRICE_FLOOR = {"AMERICA": 500.0, "EUROPE": 800.0, "ASIA": 100.0}
ADV_FLOOR = {"AMERICA": 52_000.0, "EUROPE": 55_000.0, "ASIA": 58_000.0, "AFRICA": 50_000.0}
PIT_REGION = "AMERICA"


def case(col: str, table: dict[str, float], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {default} END"


view(
    "adv_daily", "grid",
    """SELECT *, CASE WHEN n >= 40 THEN m END AS adv FROM (
         SELECT *, count(close) OVER w AS n, avg(close * volume) OVER w AS m FROM grid
         WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 377 PRECEDING AND CURRENT ROW))""",
)
view(
    "weekly_levels", "adv_daily",
    f"""SELECT {week('date')} AS date, symbol,
          arg_max(close, t) FILTER (WHERE close IS NOT NULL) AS close,
          arg_max(adv, t) FILTER (WHERE adv IS NOT NULL) AS adv
        FROM adv_daily WHERE px IS NOT NULL GROUP BY 1, 2""",
)
view(
    "eligible", "weekly_levels profile membership",
    f"""SELECT w.date, w.symbol, w.close, w.adv, p.region,
          coalesce(w.close >= {case('p.region', PRICE_FLOOR, '0.0')}, false)
          AND coalesce(w.adv >= {case('p.region', ADV_FLOOR, '1e300')}, false)
          AND (p.region IS DISTINCT FROM '{PIT_REGION}' OR EXISTS (
            SELECT 1 FROM membership m WHERE m.symbol = w.symbol AND w.date >= m.date_added
              AND (m.date_removed IS NULL OR w.date < m.date_removed))) AS eligible
        FROM weekly_levels w LEFT JOIN profile p USING (symbol)""",
)


def weekly_levels(t):
    """Weekly close and six-month average dollar volume."""
    return ts.weekly_last(u.dollar_volume_average(t.grid, ADV_ROWS, ADV_MIN), ["close", "adv"])


def weekly_panel(t):
    """Last week's return next to ``weekly_levels``, from one pass over the grid, stored."""
    return t.staged("weekly panel", lambda: ts.weekly_last(
        u.dollar_volume_average(factors.r1w(t.grid), ADV_ROWS, ADV_MIN), ["R1W", "close", "adv"]))


def eligible(t, levels=None):
    return u.eligibility(weekly_levels(t) if levels is None else levels, t.profile, t.membership, PRICE_FLOOR, ADV_FLOOR, PIT_REGION)


@query(
    "b1_sector_filter", "symbol sector",
    "SELECT symbol, sector FROM profile WHERE sector IS NULL OR sector NOT IN ('ASIA', 'AFRICA')",
    "profile",
)
def sector_filter(t):
    return u.exclude_sectors(t.profile, ["ASIA", "AFRICA"])


@query(
    "b2_adv_filter", "date:d symbol liquid:i",
    f"""SELECT date, symbol, coalesce(adv >= {case('region', ADV_FLOOR, '1e300')}, false) AS liquid
        FROM adv_daily LEFT JOIN profile USING (symbol) WHERE px IS NOT NULL""",
    "adv_daily profile",
)
def adv_filter(t):
    return u.adv_mask(t.grid, t.profile, ADV_FLOOR, ADV_ROWS, ADV_MIN)


@query(
    "b2_adv_filter_defaults", "date:d symbol liquid:i",
    f"""SELECT date, symbol, coalesce(CASE WHEN n >= 63 THEN m END >= {case('region', ADV_FLOOR, '1e300')}, false) AS liquid
        FROM (SELECT *, count(close) OVER w AS n, avg(close * volume) OVER w AS m FROM grid
              WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
        LEFT JOIN profile USING (symbol) WHERE px IS NOT NULL""",
    "grid profile",
)
def adv_filter_defaults(t):
    return u.adv_mask(t.grid, t.profile, ADV_FLOOR)


@query(
    "b3_keep_by_last_row", "symbol",
    """SELECT symbol FROM adv_daily WHERE adv >= 60000 AND date = (SELECT max(date) FROM cal)""",
    "adv_daily cal",
)
def keep_by_last_row(t):
    return u.keep_by_last_row(u.adv_mask(t.grid, t.profile, 60_000.0, ADV_ROWS, ADV_MIN), "liquid")


@query(
    "b4_members_on_date", "symbol region",
    """SELECT symbol, region FROM membership JOIN profile USING (symbol)
       WHERE region IN ('AMERICA', 'EUROPE', 'ASIA') AND (date_added IS NULL OR date_added <= '2001-10-30')
         AND (date_removed IS NULL OR date_removed > '2001-10-30')""",
    "membership profile",
)
def members_on_date(t):
    m = t.membership.join(t.profile, "symbol")
    return u.members_on(m, F.lit("2001-10-30").cast("date"), ["AMERICA", "EUROPE", "ASIA"])


@query(
    "b5_members_in_window", "symbol region",
    """SELECT symbol, region FROM membership JOIN profile USING (symbol)
       WHERE region IN ('EUROPE', 'ASIA') OR ((date_removed IS NULL OR date_removed >= '2001-10-25')
         AND (date_added IS NULL OR date_added <= '2001-12-31'))""",
    "membership profile",
)
def members_in_window(t):
    m = t.membership.join(t.profile, "symbol")
    day = lambda s: F.lit(s).cast("date")
    return u.members_during(m, day("2001-10-25"), day("2001-12-31"), ["EUROPE", "ASIA"])


@query(
    "b6_eligibility_mask", "date:d symbol eligible:i",
    "SELECT date, symbol, eligible FROM eligible",
    "eligible",
)
def eligibility_mask(t):
    return eligible(t)


@query(
    "b7_mask_predictions", "date:d symbol prediction:4",
    f"""SELECT s.date, s.symbol, CASE WHEN e.eligible THEN s.prediction END AS prediction
        FROM (SELECT {week('date')} AS date, symbol, arg_max(close, date) AS prediction FROM bars GROUP BY 1, 2) s
        LEFT JOIN eligible e USING (date, symbol)""",
    "bars eligible",
)
def mask_predictions(t):
    scores = ts.weekly_last(t.bars, ["close"]).withColumnRenamed("close", "prediction")
    return u.mask_scores(scores, eligible(t))


SYMBOL_SQL = """SELECT s_suppkey, 'X' || s_suppkey || CASE s_suppkey % 7 WHEN 0 THEN '-PA' WHEN 1 THEN '-P'
         WHEN 2 THEN '-pb.to' WHEN 3 THEN '-A.TO' WHEN 4 THEN '-UN.TO' WHEN 5 THEN '.L' ELSE '' END AS code
       FROM supplier"""


def listing_codes(t):
    """Exchange-style codes derived from the supplier key."""
    key = F.col("s_suppkey")
    endings = ["-PA", "-P", "-pb.to", "-A.TO", "-UN.TO", ".L"]
    suffix = F.lit("")
    for i, e in reversed(list(enumerate(endings))):
        suffix = F.when(key % 7 == i, F.lit(e)).otherwise(suffix)
    return t.read("supplier").select(
        "s_suppkey", F.concat(F.lit("X"), key.cast("string"), suffix).alias("code")
    )


@query(
    "b8_preferred_share_filter", "code preferred:i",
    f"SELECT code, regexp_matches(trim(code), '(?i)-P[A-Z]?(\\.[A-Z]+)?$') AS preferred FROM ({SYMBOL_SQL})",
)
def preferred_filter(t):
    return listing_codes(t).withColumn("preferred", u.is_preferred(F.col("code")))


@query(
    "b9_region_of_symbol", "symbol region",
    """SELECT symbol, CASE min(p) WHEN 1 THEN 'US' WHEN 2 THEN 'UK' ELSE 'CA' END AS region FROM (
         SELECT l_suppkey AS symbol, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS p
         FROM lineitem) GROUP BY symbol""",
)
def region_of_symbol(t):
    flag = F.col("l_returnflag")
    listings = t.read("lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.when(flag == "R", "US").when(flag == "A", "UK").otherwise("CA").alias("region"),
    )
    return u.region_of(listings)


@query(
    "b10_membership_intervals", "symbol date_added:d date_removed:d sector",
    """WITH log AS (
         SELECT user_id AS symbol, CAST(ts AS DATE) AS d, event_id AS seq, event_type = 'purchase' AS is_add
         FROM events WHERE event_type IN ('purchase', 'error')),
       numbered AS (SELECT *, coalesce(sum(CASE WHEN is_add THEN 0 ELSE 1 END) OVER (PARTITION BY symbol
           ORDER BY d, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stint FROM log),
       spans AS (SELECT symbol, max(CASE WHEN is_add THEN d END) AS date_added,
           max(CASE WHEN NOT is_add THEN d END) AS date_removed FROM numbered GROUP BY symbol, stint),
       cur AS (SELECT c_custkey AS symbol, c_mktsegment AS sector FROM customer),
       every_span AS (SELECT * FROM spans UNION ALL SELECT symbol, DATE '2023-12-01', NULL FROM cur
           WHERE symbol NOT IN (SELECT symbol FROM spans))
       SELECT s.symbol, date_added, date_removed, c.sector FROM every_span s LEFT JOIN cur c USING (symbol)""",
)
def membership_intervals(t):
    e = t.read("events").filter(F.col("event_type").isin("purchase", "error"))
    user = F.col("user_id").cast("string")
    added = F.when(F.col("event_type") == "purchase", user).otherwise("")
    removed = F.when(F.col("event_type") == "error", user).otherwise("")
    log = e.select(
        F.col("event_id").alias("seq"), F.to_date("ts").alias("date"),
        added.alias("added"), removed.alias("removed"),
    )
    current = t.read("customer").select(
        F.col("c_custkey").cast("string").alias("symbol"), F.col("c_mktsegment").alias("sector"),
        F.lit(None).cast("string").alias("sub_industry"),
        F.lit("2023-12-01").cast("date").alias("date_first_added"),
    )
    out = u.membership_intervals(log, current)
    return out.withColumn("symbol", F.col("symbol").cast("bigint"))


@query(
    "b11_screener_snapshot", "symbol sector region exchange date_added:d",
    """SELECT s_suppkey AS symbol, r_name AS sector, 'UK' AS region, 'LSE' AS exchange, CAST(NULL AS DATE) AS date_added
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
       WHERE n_nationkey % 5 = 1""",
)
def screener_snapshot(t):
    mark = F.when(F.col("n_nationkey") % 5 == 1, "GB").otherwise("XX")
    listings = (
        t.read("supplier")
        .join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"), mark.alias("country"))
    )
    return u.screener_snapshot(listings, "GB", "UK", "LSE")


THIN_SQL = """WITH counts AS (SELECT symbol, count(*) AS rows, min(date) AS first_date, max(date) AS last_date
         FROM bars GROUP BY symbol),
       cut AS (SELECT median(rows) AS m FROM counts),
       renames AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey AS old_symbol, o_orderkey AS k,
           o_orderkey AS new_symbol FROM orders WHERE o_orderstatus = 'P'),
       latest AS (SELECT old_symbol, arg_max(new_symbol, (date, k)) AS new_symbol FROM renames GROUP BY 1),
       reasons AS (SELECT symbol, arg_max(reason, (date, seq)) AS reason FROM (
           SELECT user_id AS symbol, CAST(ts AS DATE) AS date, event_id AS seq, CASE event_type
             WHEN 'purchase' THEN 'Acquired by peer' WHEN 'error' THEN 'Market cap' ELSE '' END AS reason
           FROM events) GROUP BY symbol),
       audit AS (SELECT t.symbol, t.rows, t.first_date, t.last_date, CASE
           WHEN l.new_symbol IS NOT NULL AND c.rows IS NOT NULL THEN 'rename, target cached'
           WHEN l.new_symbol IS NOT NULL THEN 'rename, target missing'
           WHEN lower(r.reason) LIKE '%acquire%' OR lower(r.reason) LIKE '%merge%' THEN 'merger or acquisition'
           WHEN coalesce(r.reason, '') <> '' THEN 'delisted or removed' ELSE 'unknown' END AS category
         FROM counts t LEFT JOIN latest l ON l.old_symbol = t.symbol LEFT JOIN counts c ON c.symbol = l.new_symbol
         LEFT JOIN reasons r ON r.symbol = t.symbol WHERE t.rows < (SELECT m FROM cut))"""


def thin_audit(t):
    counts = t.bars.groupBy("symbol").count()
    cut = float(counts.agg(F.median("count")).first()[0])
    renames = t.read("orders").filter("o_orderstatus = 'P'").select(
        F.struct(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")).alias("date"),
        F.col("o_custkey").alias("old_symbol"), F.col("o_orderkey").alias("new_symbol"),
    )
    kind = F.col("event_type")
    reasons = t.read("events").select(
        F.col("event_id").alias("seq"), F.to_date("ts").alias("date"), F.col("user_id").alias("symbol"),
        F.when(kind == "purchase", "Acquired by peer").when(kind == "error", "Market cap")
        .otherwise("").alias("reason"),
    )
    return u.thin_coverage(t.bars, renames, reasons, cut)


@query(
    "b12_thin_coverage_audit", "symbol rows:i first_date:d last_date:d category",
    f"{THIN_SQL} SELECT * FROM audit", "bars",
)
def thin_coverage(t):
    return thin_audit(t)


@query(
    "b12_thin_coverage_counts", "category n:i",
    f"{THIN_SQL} SELECT category, count(*) AS n FROM audit GROUP BY 1", "bars",
)
def thin_counts(t):
    return thin_audit(t).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b14_return_cap", "date:d symbol r:8",
    """SELECT date, symbol, greatest(-0.3, least(0.3, r)) AS r FROM (SELECT date, symbol,
         close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM bars) WHERE r IS NOT NULL""",
    "bars",
)
def return_cap(t):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("date")
    return t.bars.withColumn("r", u.clip(ts.change("close", 1, w), 0.3)).filter("r is not null")


@query(
    "b15_broker_contract", "code us:i symbol exchange currency",
    f"""SELECT code, NOT (code LIKE '%.TO' OR code LIKE '%.L') AS us,
          CASE WHEN code LIKE '%.TO' THEN replace(code[:-4], '-', ' ') WHEN code LIKE '%.L' THEN code[:-3]
            ELSE code END AS symbol,
          CASE WHEN code LIKE '%.TO' THEN 'TSE' WHEN code LIKE '%.L' THEN 'LSE' ELSE 'SMART' END AS exchange,
          CASE WHEN code LIKE '%.TO' THEN 'CAD' WHEN code LIKE '%.L' THEN 'GBP' ELSE 'USD' END AS currency
        FROM (SELECT CASE code WHEN 'X6' THEN 'RENAMED.TO' ELSE code END AS code FROM ({SYMBOL_SQL}))""".replace(
        "SELECT code, NOT", "SELECT CASE code WHEN 'RENAMED.TO' THEN 'X6' ELSE code END AS code, NOT"
    ).replace("NOT (code LIKE '%.TO' OR code LIKE '%.L') AS us", "code = 'RENAMED.TO' OR NOT (code LIKE '%.TO' OR code LIKE '%.L') AS us"),
)
def broker_contract(t):
    df = listing_codes(t).withColumn("us", u.is_us_listing(F.col("code")))
    return df.withColumn("c", u.broker_contract(F.col("code"), {"X6": "RENAMED.TO"})).select("code", "us", "c.*")


@query(
    "b16_next_signal_day", "o_orderkey:i day:d",
    f"SELECT o_orderkey, {week('CAST(o_orderdate AS DATE)')} AS day FROM orders",
)
def next_signal_day(t):
    day = u.next_signal_day(F.to_date("o_orderdate"), "THU")
    return t.read("orders").withColumn("day", day)


@query(
    "b17_as_of_bin", "as_of_date:d target_date:d",
    f"""SELECT max(w) AS as_of_date, max(w) + 7 AS target_date FROM (SELECT {week('date')} AS w FROM cal)
        WHERE w <= DATE '2000-05-10'""",
    "cal",
)
def as_of_bin(t):
    weeks = t.calendar.select(ts.week_of("date").alias("date")).distinct()
    return u.as_of_bin(weeks, F.lit("2000-05-10").cast("date"))
