"""Universe construction: sector, liquidity, membership and listing filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import ts

# Fixed value: the preferred-share suffix, e.g. ENB-PN.TO, BAC-PL.
PREFERRED_SUFFIX = r"(?i)-P[A-Z]?(\.[A-Z]+)?$"

# Fixed value: order in which regions claim a symbol listed in several.
REGION_PRIORITY = ["US", "UK", "CA"]


def exclude_sectors(profile: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Drop excluded sectors; an unknown sector is kept."""
    return profile.filter(F.col("sector").isNull() | ~F.col("sector").isin(list(excluded)))


def lookup(key: Column, table: dict[str, float], default: Column) -> Column:
    """A short configuration table as an expression, so no join is needed."""
    if not table:
        return default
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


# Money is added up in whole millionths: doubles add those exactly, up to sums of 9e9, so an
# average that equals its floor compares as equal in whatever order the window is added up.
MONEY_UNIT = 1e6


def dollar_volume_average(grid: DataFrame, rows: int = 126, min_count: int | None = None) -> DataFrame:
    """Trailing mean of close x volume over traded rows, from half a window on."""
    need = rows // 2 if min_count is None else min_count
    dv = F.rint(F.col("close") * F.col("volume") * MONEY_UNIT)
    out = ts.moving_sums(
        grid, {"_n": F.when(dv.isNotNull(), F.lit(1.0)), "_s": dv}, rows
    )
    return out.withColumn(
        "adv", F.when(F.col("_n") >= need, F.col("_s") / F.col("_n") / MONEY_UNIT)
    ).drop("_n", "_s")


INFINITE_FLOOR = 1.0e300


def adv_mask(grid: DataFrame, profile: DataFrame, min_adv: float | dict[str, float],
             rows: int = 126, min_count: int | None = None) -> DataFrame:
    """``liquid`` per cell: average dollar volume reaches the scalar or regional floor."""
    adv = dollar_volume_average(grid, rows, min_count)
    if isinstance(min_adv, dict):
        adv = adv.join(profile.select("symbol", "region"), "symbol", "left")
        floor = lookup(F.col("region"), min_adv, F.lit(INFINITE_FLOOR))
    else:
        floor = F.lit(float(min_adv))
    return adv.withColumn("liquid", F.coalesce(F.col("adv") >= floor, F.lit(False)))


def keep_by_last_row(mask: DataFrame, flag: str) -> DataFrame:
    """Symbols whose flag holds on the last calendar date."""
    last = mask.agg(F.max("date")).scalar()
    return mask.filter((F.col("date") == last) & F.col(flag)).select("symbol").distinct()


def active_on(membership: DataFrame, day: Column) -> Column:
    return (F.col("date_added").isNull() | (F.col("date_added") <= day)) & (
        F.col("date_removed").isNull() | (F.col("date_removed") > day)
    )


def members_on(membership: DataFrame, day: Column, regions: Sequence[str]) -> DataFrame:
    """Point-in-time members over the regions; a symbol keeps its first region listed."""
    prio = F.array_position(F.array(*map(F.lit, regions)), F.col("region"))
    rows = membership.filter(F.col("region").isin(list(regions)) & active_on(membership, day))
    return rows.groupBy("symbol").agg(F.min_by("region", prio).alias("region"))


def members_during(membership: DataFrame, start: Column, end: Column,
                   snapshot_regions: Sequence[str]) -> DataFrame:
    """Symbols whose interval touches [start, end]; snapshot regions are always in."""
    overlaps = (F.col("date_removed").isNull() | (F.col("date_removed") >= start)) & (
        F.col("date_added").isNull() | (F.col("date_added") <= end)
    )
    always = F.col("region").isin(list(snapshot_regions))
    return membership.filter(overlaps | always).select("symbol", "region").distinct()


def eligibility(weekly: DataFrame, profile: DataFrame, membership: DataFrame | None,
                min_price: dict[str, float], min_adv: dict[str, float],
                pit_region: str = "US") -> DataFrame:
    """``eligible`` per (date, symbol) from price, ADV and point-in-time membership.

    A region without a price floor passes; one without an ADV floor fails.  Membership is an
    equi-join on symbol with the interval test as a condition, reduced to the member cells.
    """
    df = weekly.join(profile.select("symbol", "region"), "symbol", "left")
    price_ok = F.col("close") >= lookup(F.col("region"), min_price, F.lit(0.0))
    adv_ok = F.col("adv") >= lookup(F.col("region"), min_adv, F.lit(INFINITE_FLOOR))
    ok = F.coalesce(price_ok & adv_ok, F.lit(False))
    if membership is None:
        return df.withColumn("eligible", ok)
    # One flag per (date, symbol) that is a member, from cells and spans alone; then one join.
    spans = membership.select("symbol", "date_added", "date_removed").filter(
        F.col("date_added").isNotNull() | F.col("date_removed").isNotNull())
    in_span = (F.col("date") >= F.coalesce("date_added", F.col("date"))) & (
        F.col("date_removed").isNull() | (F.col("date") < F.col("date_removed"))
    )
    members = weekly.select("date", "symbol").join(spans, "symbol").filter(in_span)
    flags = members.select("date", "symbol").distinct().withColumn("_member", F.lit(True))
    member = (F.col("region") != pit_region) | F.coalesce("_member", F.lit(False))
    return df.join(flags, ["date", "symbol"], "left").select(
        "date", "symbol", "close", "adv", "region", (ok & F.coalesce(member, F.lit(True))).alias("eligible"))


def mask_scores(scores: DataFrame, eligible: DataFrame) -> DataFrame:
    """Null the prediction of ineligible cells; an absent cell is ineligible."""
    flags = eligible.select("date", "symbol", "eligible")
    joined = scores.join(flags, ["date", "symbol"], "left")
    return joined.withColumn(
        "prediction", F.when(F.coalesce("eligible", F.lit(False)), F.col("prediction"))
    ).drop("eligible")


def is_preferred(symbol: Column) -> Column:
    return F.trim(symbol).rlike(PREFERRED_SUFFIX)


def region_of(listings: DataFrame) -> DataFrame:
    """First region, in priority order, that lists each symbol."""
    prio = F.array_position(F.array(*map(F.lit, REGION_PRIORITY)), F.col("region"))
    known = listings.filter(F.col("region").isin(REGION_PRIORITY))
    return known.groupBy("symbol").agg(F.min_by("region", prio).alias("region"))


def membership_intervals(events: DataFrame, current: DataFrame) -> DataFrame:
    """Add/remove log to membership intervals.

    ``events`` is (seq, date, added, removed) with one of each per row at most; within a
    row the removal comes first.  A removal closes the last start since the symbol's
    previous removal; without one the start is unknown.  A start that is never closed
    stays open.  Current members the log never adds start at ``date_first_added``.
    """
    out = events.filter(F.col("removed") != "").select(
        F.col("removed").alias("symbol"), "date", "seq", F.lit(0).alias("kind")
    )
    came = events.filter(F.col("added") != "").select(
        F.col("added").alias("symbol"), "date", "seq", F.lit(1).alias("kind")
    )
    log = out.unionByName(came)
    # Ordered within a day only; between days one row per (symbol, day) carries the state,
    # so a symbol with a large share of the log is spread over its days.
    in_day = Window.partitionBy("symbol", "date").orderBy("seq", "kind")
    stint = F.coalesce(
        F.sum(1 - F.col("kind")).over(in_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    stints = log.withColumn("stint", stint).groupBy("symbol", "date", "stint").agg(
        F.max("kind").alias("added"), F.min("kind").alias("kept")
    )
    days = log.groupBy("symbol", "date").agg(
        F.max_by("kind", F.struct("seq", "kind")).alias("open")
    )
    w = Window.partitionBy("symbol").orderBy("date")
    days = days.withColumns(
        {
            "carried": F.when(F.lag("open").over(w) == 1, F.lag("date").over(w)),
            "newest": F.lead("date").over(w).isNull(),
        }
    )
    closed = stints.filter("kept = 0").join(days, ["symbol", "date"]).select(
        "symbol",
        F.when(F.col("added") == 1, F.col("date"))
        .when(F.col("stint") == 0, F.col("carried"))
        .alias("date_added"),
        F.col("date").alias("date_removed"),
    )
    still_in = days.filter("newest and open = 1").select(
        "symbol", F.col("date").alias("date_added"), F.lit(None).cast("date").alias("date_removed")
    )
    spans = closed.unionByName(still_in)
    unseen = current.join(spans, "symbol", "left_anti").select(
        "symbol", F.col("date_first_added").alias("date_added"),
        F.lit(None).cast("date").alias("date_removed"),
    )
    return spans.unionByName(unseen).join(
        current.select("symbol", "sector", "sub_industry"), "symbol", "left"
    )


def screener_snapshot(listings: DataFrame, country: str, region: str, exchange: str) -> DataFrame:
    """Current members of one market, as open-ended intervals."""
    never = F.lit(None).cast("date")
    return listings.filter(F.col("country") == country).select(
        "symbol", "sector", never.alias("date_added"), never.alias("date_removed"),
        F.lit(region).alias("region"), F.lit(exchange).alias("exchange"),
    )


def thin_coverage(bars: DataFrame, renames: DataFrame, events: DataFrame,
                  min_rows: int) -> DataFrame:
    """Symbols with short price history and the likely reason.

    ``renames`` is (date, old_symbol, new_symbol); ``events`` is (seq, date, symbol, reason).
    """
    counts = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    thin = counts.filter(F.col("rows") < min_rows)
    latest = renames.groupBy(F.col("old_symbol").alias("symbol")).agg(
        F.max_by("new_symbol", "date").alias("new_symbol")
    )
    target = counts.select(F.col("symbol").alias("new_symbol"), F.col("rows").alias("target_rows"))
    reason = events.groupBy("symbol").agg(F.max_by("reason", F.struct("date", "seq")).alias("reason"))
    df = (
        thin.join(latest, "symbol", "left")
        .join(target, "new_symbol", "left")
        .join(reason, "symbol", "left")
    )
    text = F.lower(F.coalesce("reason", F.lit("")))
    merged = text.contains("acquire") | text.contains("merge")
    category = (
        F.when(F.col("new_symbol").isNotNull() & F.col("target_rows").isNotNull(),
               "rename, target cached")
        .when(F.col("new_symbol").isNotNull(), "rename, target missing")
        .when(merged, "merger or acquisition")
        .when(text != "", "delisted or removed")
        .otherwise("unknown")
    )
    return df.withColumn("category", category)


def clip(col: Column, cap: float) -> Column:
    """Bound a value to +-cap, nulls kept."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(-cap)), F.lit(cap)))


# Fixed value: exchange suffixes with venue and currency.
SUFFIXES = {".TO": ("TSE", "CAD"), ".L": ("LSE", "GBP")}
DEFAULT_VENUE = ("SMART", "USD")


def is_us_listing(symbol: Column) -> Column:
    foreign = F.lit(False)
    for suffix in SUFFIXES:
        foreign = foreign | symbol.endswith(suffix)
    return ~foreign


def broker_contract(symbol: Column, renames: dict[str, str] | None = None) -> Column:
    """struct(symbol, exchange, currency) for a listing code."""
    sym = symbol
    if renames:
        pairs = [F.lit(x) for kv in renames.items() for x in kv]
        sym = F.coalesce(F.try_element_at(F.create_map(*pairs), symbol), symbol)
    bare = F.regexp_replace(sym, r"\.(TO|L)$", "")
    code = F.when(sym.endswith(".TO"), F.replace(bare, F.lit("-"), F.lit(" "))).otherwise(bare)
    venue = F.when(sym.endswith(".TO"), "TSE").when(sym.endswith(".L"), "LSE").otherwise("SMART")
    money = F.when(sym.endswith(".TO"), "CAD").when(sym.endswith(".L"), "GBP").otherwise("USD")
    return F.struct(code.alias("symbol"), venue.alias("exchange"), money.alias("currency"))


def next_signal_day(today: Column, day: str) -> Column:
    """First given weekday on or after ``today``."""
    return F.next_day(F.date_sub(today, 1), day)


def as_of_bin(weeks: DataFrame, today: Column) -> DataFrame:
    """Latest weekly label not after ``today`` and the target one week on."""
    return weeks.filter(F.col("date") <= today).agg(F.max("date").alias("as_of_date")).withColumn(
        "target_date", F.date_add("as_of_date", 7)
    )
