"""As-of, interval and reconciliation joins without range-join fan-out.

An as-of join is turned around: each fact row is repeated over the calendar rows on
which it is the current one.  The facts of a symbol are bounded by its history, the
output is exactly the answer, and every join left is an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.session import stage


def with_default(df: DataFrame, table: DataFrame, on: str, col: str, default: str = "Unknown") -> DataFrame:
    """Left lookup; a missing key gets the default label."""
    joined = df.join(table.select(on, col), on, "left")
    return joined.withColumn(col, F.coalesce(col, F.lit(default)))


def next_session(cal: DataFrame) -> DataFrame:
    """(day, t) for every day from the first session on: the first session not before it."""
    prev = F.coalesce(F.lag("date").over(Window.orderBy("t")), F.date_sub("date", 1))
    return cal.withColumn("prev", prev).select(
        "t", F.explode(F.sequence(F.date_add("prev", 1), F.col("date"))).alias("day")
    )


def effective_reports(reports: DataFrame, cal: DataFrame, lag_days: int = 90, exact: bool = False) -> DataFrame:
    """Reports with ``eff``, the day from which they count, and ``t``, the first session from then on."""
    eff = reports.withColumn("eff", F.date_add("date", lag_days)).drop("date")
    # Reports already in force before the first session count from it.
    first = cal.agg(F.min("date")).scalar()
    eff = eff.withColumn("day", F.col("eff") if exact else F.greatest("eff", first))
    days = cal.select("t", F.col("date").alias("day")) if exact else next_session(cal)
    return eff.join(F.broadcast(days), "day")


def report_asof(reports: DataFrame, cols: Sequence[str], cal: DataFrame, lag_days: int = 90,
                exact: bool = False) -> DataFrame:
    """Report values on every calendar row from ``date + lag`` until the next report.

    ``exact`` keeps only reports whose effective day is itself a session.  Values are
    carried per column, so a null in a later report leaves the earlier value in force.

    The rows multiply in the last step, after the last shuffle whose size Spark knows, so a join
    with them would be taken for a small one and broadcast: the hint keeps it a sorted one.
    """
    rows = effective_reports(reports, cal, lag_days, exact)
    # Two reports effective on one session: the later one stands, column by column.
    rows = rows.groupBy("symbol", "t").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("eff"))).alias(c) for c in cols]
    )
    w = Window.partitionBy("symbol").orderBy("t")
    rows = rows.select(
        "symbol", "t", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols],
        F.lead("t").over(w).alias("next"),
    )
    n_days = cal.agg(F.max("n_days")).scalar()
    until = F.coalesce("next", n_days) - 1
    return rows.select("symbol", F.explode(F.sequence(F.col("t"), until)).alias("t"), *cols).hint("merge")


def first_after(bars: DataFrame, signal_day: str = "THU") -> DataFrame:
    """First own close strictly after each weekly label.

    A bar answers for the labels from the symbol's previous bar up to the day before it.
    Labels before the first bar are answered by it too, back to one week.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    since = F.coalesce(F.lag("date").over(w), F.date_sub("date", 7))
    first_label = F.next_day(F.date_sub(since, 1), signal_day)
    rows = bars.select("symbol", "date", "close", first_label.alias("a")).filter(
        F.col("a") < F.col("date")
    )
    return rows.select(
        "symbol",
        F.explode(F.sequence("a", F.date_sub("date", 1), F.expr("interval 7 days"))).alias("label"),
        F.col("date").alias("entry_date"),
        F.col("close").alias("entry_close"),
    )


def session_on_or_before(labels: DataFrame, cal: DataFrame) -> DataFrame:
    """Latest calendar date not after each label; one row per day of history."""
    nxt = F.coalesce(F.lead("date").over(Window.orderBy("t")), F.date_add("date", 1))
    days = cal.withColumn("next", nxt).select(
        F.col("date").alias("session"),
        F.explode(F.sequence(F.col("date"), F.date_sub("next", 1))).alias("_day"),
    )
    # A label past the last session is answered by that session.
    last = cal.agg(F.max("date")).scalar()
    capped = labels.withColumn("_day", F.least("date", last))
    return capped.join(F.broadcast(days), "_day", "left").drop("_day")


def asof_events(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], order: str,
                ts: str = "ts", forward: bool = False, strict: bool = False,
                within: str | None = None, parts: int | None = None) -> DataFrame:
    """Latest ``right`` row at or before each ``left`` row of one key, with no calendar between.

    ``forward`` takes the earliest at or after instead, ``strict`` leaves out the same instant,
    ``within`` (an interval such as ``"2 days"``) nulls an older match.  Of the ``right`` rows of
    one instant the one of greatest ``order`` counts.  All ``left`` rows stay; a null key or time
    matches nothing.  Adds ``cols`` and ``matched_ts``.

    Rows are first reduced to instants, one per (key, time), which are cut into ranges of
    (key, time): a key with a large share of all instants is spread over many ranges.  The last
    match of a range is carried into the key's next ones; each border is crossed by one key at
    most, so at most ``parts`` carried rows are broadcast.
    """
    clash = {*cols, "matched_ts"} & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    left = left.withColumn("_at", -at if forward else at)
    facts = (
        right.withColumn("_at", -at if forward else at).dropna(subset=[key, "_at"])
        .groupBy(key, "_at").agg(F.max_by(F.struct(*cols), order).alias("_fact"))
    )
    found = F.when(F.col("_fact").isNotNull(), F.struct("_at", "_fact"))
    asks = left.select(key, "_at").dropna().distinct()
    instants = asks.select(key, "_at", F.lit(None).cast(facts.schema["_fact"].dataType).alias("_fact"),
                           F.lit(True).alias("_asked")).unionByName(facts.withColumn("_asked", F.lit(False)))
    instants = instants.groupBy(key, "_at").agg(
        F.any_value("_fact", ignoreNulls=True).alias("_fact"), F.max("_asked").alias("_asked"))
    # Stored: the number of a range must not change when a task is run again.
    ranged = stage(instants.repartitionByRange(parts, key, "_at").withColumn("_part", F.spark_partition_id()))
    past = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy(key, "_part").agg(F.max_by(found, F.when(F.col("_fact").isNotNull(), F.col("_at"))).alias("_tail"))
        .select(key, "_part", F.last("_tail", ignorenulls=True).over(past).alias("_carried"))
        .filter(F.col("_carried").isNotNull())
    )
    upto = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    match = F.coalesce(F.last(found, ignorenulls=True).over(upto), F.col("_carried"))
    answers = (
        ranged.join(F.broadcast(carried), [key, "_part"], "left")
        .withColumn("_match", match).filter(F.col("_asked") & F.col("_match").isNotNull())
        .select(key, "_at", F.timestamp_micros(-F.col("_match._at") if forward else F.col("_match._at"))
                .alias("matched_ts"), "_match._fact.*")
    )
    out = left.join(answers, [key, "_at"], "left")
    if within:
        stale = F.abs(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros("matched_ts")) > F.unix_micros(
            F.timestamp_micros(F.lit(0)) + F.expr(f"interval {within}"))
        out = out.withColumns({c: F.when(~stale, F.col(c)) for c in (*cols, "matched_ts")})
    return out.select(*[c for c in left.columns if c != "_at"], *cols, "matched_ts")


def in_interval(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows whose date lies in a half-open span of their symbol; null ends are open."""
    joined = rows.join(spans, "symbol")
    return joined.filter(
        (F.col("date_added").isNull() | (F.col("date") >= F.col("date_added")))
        & (F.col("date_removed").isNull() | (F.col("date") < F.col("date_removed")))
    )


def reconcile(target: DataFrame, held: DataFrame, flatten_first: bool = False) -> DataFrame:
    """Signed share deltas between a target book and the positions held.

    ``flatten_first`` closes every position and opens the target from zero instead.
    """
    if flatten_first:
        close_all = held.select(
            "symbol", F.lit(0.0).alias("target"), F.col("shares").alias("held")
        )
        open_all = target.select(
            "symbol", F.col("shares").alias("target"), F.lit(0.0).alias("held")
        )
        both = close_all.unionByName(open_all)
        delta = F.col("target") - F.col("held")
        kept = both.withColumn("delta", delta).filter(F.abs("delta") >= 1)
    else:
        both = target.select("symbol", F.col("shares").alias("target")).join(
            held.select("symbol", F.col("shares").alias("held")), "symbol", "full_outer"
        )
        both = both.na.fill(0.0, ["target", "held"])
        delta = F.bround(F.col("target") - F.col("held"), 0)
        kept = both.withColumn("delta", delta).filter(F.abs("delta") >= 1)
    return kept.withColumn("action", F.when(F.col("delta") > 0, "BUY").otherwise("SELL")).withColumn(
        "qty", F.floor(F.abs("delta"))
    )


def common_keys(long: DataFrame, key: str, series: str) -> DataFrame:
    """Keys present in every series."""
    n = long.agg(F.count_distinct(series)).scalar()
    per_key = long.select(key, series).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.filter(F.col("n") == n).select(key)


def merge_by_priority(first: DataFrame, second: DataFrame, group: str, key: str, order: str,
                      first_cap: int, cap: int) -> DataFrame:
    """Up to ``first_cap`` rows of ``first``, then rows of ``second`` with an unseen key.

    The caps are the feature; both are row_number limits, applied before the shuffle.
    """
    w = Window.partitionBy(group)
    lead = (
        first.withColumn("_r", F.row_number().over(w.orderBy(order)))
        .filter(F.col("_r") <= first_cap)
        .drop("_r")
    )
    rest = second.join(lead.select(group, key), [group, key], "left_anti")
    both = lead.withColumn("prio", F.lit(0)).unionByName(rest.withColumn("prio", F.lit(1)))
    return (
        both.withColumn("rank", F.row_number().over(w.orderBy("prio", order)))
        .filter(F.col("rank") <= cap)
    )
