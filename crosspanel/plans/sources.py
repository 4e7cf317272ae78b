"""Queries for sources, keyed merges and sinks."""

import uuid

from pyspark.sql import functions as F

from crosspanel.functions import ts
from crosspanel.plans.registry import query
from crosspanel.session import stage_dir
from crosspanel.sources import store
from crosspanel.sources.keyed import KeyedTable

SERIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NAMES = ["urgent", "high", "medium", "unspecified", "low"]
SERIES_COLUMNS = dict(zip(SERIES, NAMES))


@query(
    "a1_load_bars", "date:d symbol close:5 volume:4",
    "SELECT date, symbol, avg(price) AS close, avg(quantity) AS volume FROM trades GROUP BY 1, 2",
    "trades",
)
def load_bars(t):
    return store.load_bars(t.trades, t.read("supplier").select(F.col("s_suppkey").alias("symbol")))


@query(
    "a2_long_to_wide", "date:d " + " ".join(f"{n}:2" for n in NAMES),
    "SELECT date, " + ", ".join(f"avg(value) FILTER (WHERE series = '{s}') AS {n}" for s, n in SERIES_COLUMNS.items())
    + " FROM macro GROUP BY date",
    "macro",
)
def long_to_wide(t):
    wide = store.to_wide(t.macro, "series", SERIES, "value")
    return wide.withColumnsRenamed(SERIES_COLUMNS)


@query(
    "a3_normalize_days", "event_id:i day:d",
    "SELECT event_id, CAST(ts AS DATE) AS day FROM events",
)
def normalize_days(t):
    return t.read("events").withColumn("day", store.normalize_day(F.col("ts")))


@query(
    "a4_append_only_merge", "date:d symbol close:4 added:i",
    """WITH old AS (SELECT date, symbol, close FROM bars WHERE date < '1999-01-01'),
       new AS (SELECT date, symbol, arg_min(price, (l_orderkey, l_linenumber, l_partkey, price)) AS close
               FROM trades WHERE date >= '1998-06-01' GROUP BY 1, 2)
       SELECT *, 0 AS added FROM old UNION ALL
       SELECT *, 1 FROM new WHERE (date, symbol) NOT IN (SELECT (date, symbol) FROM old)""".replace(
        "WHERE (date, symbol) NOT IN (SELECT (date, symbol) FROM old)",
        "n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.date = n.date AND o.symbol = n.symbol)",
    ),
    "trades bars",
)
def append_only_merge(t):
    old = t.bars.filter("date < '1999-01-01'").select("date", "symbol", "close")
    new = t.trades.filter("date >= '1998-06-01'").select(
        "date", "symbol", F.col("price").alias("close"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "price").alias("seq"),
    )
    return store.merge_append_only(old, new, ["date", "symbol"], "seq")


@query(
    "a5_event_dedupe", "symbol date:d action seq:i",
    """SELECT symbol, date, action, min(seq) AS seq FROM (
         SELECT * FROM ratings UNION ALL
         SELECT symbol, date, CASE WHEN seq % 5 = 0 THEN 'upgrade' ELSE action END, seq + 1000000000
         FROM ratings WHERE date >= DATE '2024-01-15') GROUP BY 1, 2, 3""",
    "ratings",
)
def event_dedupe(t):
    # The top-up comes later, and some of its rows differ, so they add keys of their own.
    later = t.ratings.filter("date >= '2024-01-15'").withColumns({
        "action": F.when(F.col("seq") % 5 == 0, "upgrade").otherwise(F.col("action")),
        "seq": F.col("seq") + 1_000_000_000,
    })
    return store.first_by_key(t.ratings.unionByName(later), ["symbol", "date", "action"], "seq")


@query(
    "a6_refresh_ranges", "symbol kind range_from:d range_to:d",
    """WITH have AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars
                     WHERE date <= '2000-06-30' GROUP BY symbol),
       plan AS (SELECT c_custkey AS symbol, lo, hi, DATE '1995-01-10' AS a, DATE '2000-06-25' AS b
                FROM customer LEFT JOIN have ON symbol = c_custkey)
       SELECT symbol, 'full' AS kind, a AS range_from, b AS range_to FROM plan WHERE lo IS NULL
       UNION ALL SELECT symbol, 'leading', a, lo - 1 FROM plan WHERE a < lo
       UNION ALL SELECT symbol, 'trailing', greatest(a, hi - 7), b FROM plan
         WHERE lo IS NOT NULL AND b >= greatest(a, hi - 7)""",
    "bars",
)
def refresh_ranges(t):
    cached = t.bars.filter("date <= '2000-06-30'")
    # Customers are more than suppliers, so many wanted keys have no bars at all.
    wanted = t.read("customer").select(F.col("c_custkey").alias("symbol"))
    return store.refresh_ranges(cached, wanted, "1995-01-10", "2000-06-25")


@query(
    "a7_failure_guard", "requested:i failed:i rate:6 refuse:i",
    """SELECT *, requested >= 20 AND rate > 0.05 AS refuse FROM (
         SELECT count(*) AS requested, count(*) FILTER (WHERE o.k IS NULL) AS failed,
           count(*) FILTER (WHERE o.k IS NULL) / count(*) AS rate
         FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') o
         ON k = c_custkey)""",
)
def failure_guard(t):
    cached = t.read("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("symbol"))
    wanted = t.read("customer").select(F.col("c_custkey").alias("symbol"))
    return store.failure_guard(cached, wanted)


@query(
    "a8_assemble_series", "date:d series value:2",
    """SELECT * FROM (SELECT d.date, s.series, last_value(m.value IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY d.date
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
       FROM (SELECT DISTINCT date FROM macro) d CROSS JOIN (SELECT DISTINCT series FROM macro) s
       LEFT JOIN macro m ON m.date = d.date AND m.series = s.series) WHERE value IS NOT NULL""",
    "macro",
)
def assemble_series(t):
    return store.assemble_series(t.macro, ts.calendar(t.macro))


@query(
    "a9_unpivot_tenors", "date:d series value:2",
    "SELECT date, series, value FROM macro WHERE series IN ('1-URGENT', '5-LOW')",
    "macro",
)
def unpivot_tenors(t):
    curve = store.to_wide(t.macro, "series", SERIES, "value")
    return store.unpivot_tenors(curve, ["1-URGENT", "5-LOW"])


@query(
    "a11_upsert", "symbol action seq:i date:d",
    """SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings GROUP BY 1, 2""",
    "ratings",
)
def upsert(t):
    old = store.first_by_key(
        t.ratings.filter("date < '2024-01-20'"), ["symbol", "action"], "seq", last=True
    )
    new = t.ratings.filter("date >= '2024-01-20'")
    return store.upsert(old, new, ["symbol", "action"], "seq")


@query(
    "a12_insert_missing", "symbol action seq:i date:d",
    """WITH old AS (SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings
                    WHERE date < '2024-01-05' GROUP BY 1, 2),
       new AS (SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings
               WHERE date >= '2024-01-05' GROUP BY 1, 2)
       SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (
         SELECT 1 FROM old o WHERE o.symbol = n.symbol AND o.action = n.action)""",
    "ratings",
)
def insert_missing(t):
    keys = ["symbol", "action"]
    old = store.first_by_key(t.ratings.filter("date < '2024-01-05'"), keys, "seq", last=True)
    new = store.first_by_key(t.ratings.filter("date >= '2024-01-05'"), keys, "seq", last=True)
    return store.insert_missing(old, new, keys)


@query(
    "a15_pruned_read", "o_orderpriority n:i total:2",
    """SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""",
)
def pruned_read(t):
    orders = t.read("orders").select("o_orderpriority", "o_totalprice", "o_orderdate")
    recent = orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"))
    return recent.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )


@query(
    "a16_freshness", "symbol last_date:d fresh:i",
    """SELECT symbol, max(date) AS last_date, max(date) >= (SELECT max(date) FROM cal) - 7 AS fresh
       FROM bars GROUP BY symbol""",
    "bars cal",
)
def freshness(t):
    floor = t.calendar.agg(F.date_sub(F.max("date"), 7)).scalar()
    return store.freshness(t.bars, floor)


@query(
    "a16_series_set_check", "series status",
    """SELECT s AS series, 'missing' AS status FROM (VALUES ('1-URGENT'), ('9-NONE')) v(s)
       WHERE s NOT IN (SELECT o_orderpriority FROM orders)
       UNION ALL SELECT DISTINCT o_orderpriority, 'extra' FROM orders WHERE o_orderpriority <> '1-URGENT'""",
)
def series_set_check(t):
    expected = F.explode(F.array(F.lit("1-URGENT"), F.lit("9-NONE")))
    names = t.spark.range(1).select(expected.alias("series"))
    found = t.read("orders").select(F.col("o_orderpriority").alias("series"))
    return store.missing_and_extra(found, names, "series")


def _scratch(t, name: str) -> str:
    return f"{stage_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "a13_csv_mirror", "symbol date:d close:4 volume:2",
    "SELECT symbol, date, close, volume FROM bars", "bars",
)
def csv_mirror(t):
    path = _scratch(t, "mirror")
    store.write_csv_mirror(t.bars.select("symbol", "date", "close", "volume"), path, [F.col("date"), F.col("symbol")])
    return t.spark.read.csv(path, header=True, schema="symbol long, date date, close double, volume double")


@query(
    "a14_metrics_json", "symbol n:i first:d volume:2",
    "SELECT symbol, count(*) AS n, min(date) AS first, sum(volume) AS volume FROM bars GROUP BY 1", "bars",
)
def metrics_json(t):
    path = _scratch(t, "metrics")
    stats = t.bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.sum("volume").alias("volume"))
    store.write_metrics_json(stats, path)
    return t.spark.read.json(path, schema="symbol long, n long, first date, volume double")


@query(
    "a14_result_versions", "version:i symbol rows:i",
    """SELECT v.version, symbol, count(*) AS rows FROM bars CROSS JOIN (VALUES (1), (2)) v(version)
       WHERE v.version = 1 OR date >= DATE '1995-01-01' GROUP BY 1, 2""",
    "bars",
)
def result_versions(t):
    path = _scratch(t, "results")
    store.write_version(t.bars, path, 1)
    store.write_version(t.bars.filter("date >= '1995-01-01'"), path, 2)
    return t.spark.read.parquet(path).groupBy("version", "symbol").agg(F.count(F.lit(1)).alias("rows"))


def _ratings_table(t) -> KeyedTable:
    """Ratings before the cut, keyed by (symbol, action)."""
    old = t.ratings.filter("date < '2024-01-20'").select("symbol", "action", "seq", "date")
    return KeyedTable.create(old, _scratch(t, "keyed"), ["symbol", "action"], "seq", buckets=16)


@query(
    "a11_upsert_in_place", "symbol action seq:i date:d",
    """SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings GROUP BY 1, 2""",
    "ratings",
)
def upsert_in_place(t):
    table = _ratings_table(t)
    table.upsert(t.ratings.filter("date >= '2024-01-20'"))
    return table.read()


@query(
    "a12_gap_fill_in_place", "symbol action seq:i date:d",
    """WITH old AS (SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings
                    WHERE date < DATE '2024-01-20' GROUP BY 1, 2),
       new AS (SELECT symbol, action, max(seq) AS seq, arg_max(date, seq) AS date FROM ratings
               WHERE date >= DATE '2024-01-20' GROUP BY 1, 2)
       SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (
         SELECT 1 FROM old o WHERE o.symbol = n.symbol AND o.action = n.action)""",
    "ratings",
)
def gap_fill_in_place(t):
    table = _ratings_table(t)
    table.insert_missing(t.ratings.filter("date >= '2024-01-20'"))
    return table.read()


@query(
    "a14_current_version", "version:i action keys:i seq:i",
    """SELECT 1 AS version, action, count(DISTINCT symbol) AS keys, max(seq) AS seq FROM ratings
       WHERE date < DATE '2024-01-20' GROUP BY 2
       UNION ALL SELECT 2, action, count(DISTINCT symbol), max(seq) FROM ratings GROUP BY 2
       UNION ALL SELECT 3, action, count(DISTINCT symbol), max(seq) FROM ratings WHERE action <> 'upgrade' GROUP BY 2""",
    "ratings",
)
def current_version(t):
    table = _ratings_table(t)
    table.upsert(t.ratings.filter("date >= '2024-01-20'"))
    table.delete(t.ratings.filter("action = 'upgrade'"))
    out = None
    for version in table.versions():
        rows = table.read(version).groupBy("action").agg(
            F.count(F.lit(1)).alias("keys"), F.max("seq").alias("seq")).withColumn("version", F.lit(version))
        out = rows if out is None else out.unionByName(rows)
    return out
