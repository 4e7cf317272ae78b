"""Trading sessions observed from coverage, per group, and snapping of dates to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import ts


def sessions(bars: DataFrame, dates: DataFrame, group: str | None = None, min_frac: float = 0.2,
             window: int = 21) -> DataFrame:
    """Dates on which a group traded: its count reaches ``min_frac`` of the local median.

    Counts are one row per (group, calendar day), so the windows are calendar-sized.
    """
    keys = [group] if group else []
    counts = bars.filter(F.col("close").isNotNull()).groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("n")
    )
    if group:
        # A day with no row for the group still counts as 0 in the local median.
        days = dates.agg(F.sort_array(F.collect_set("date")).alias("days")).select("days").scalar()
        groups = counts.select(group).distinct()
        every = groups.withColumn("days", days).select(group, F.explode("days").alias("date"))
        counts = every.join(counts, [group, "date"], "left").na.fill(0, ["n"])
    out = ts.rolling_medians(counts, {"norm": "n"}, 2 * (window // 2) + 1, by=keys, order="date", centered=True)
    return out.filter((F.col("n") >= F.col("norm") * min_frac) & (F.col("n") > 0))


def resolve_session(nominal: DataFrame, days: DataFrame, group: str | None = None,
                    max_back: int = 3, max_forward: int = 3) -> DataFrame:
    """Snap each nominal date to a session: itself, else up to 3 back, else up to 3 ahead.

    Each nominal row becomes at most seven candidate days, joined on equality.
    """
    offsets = [0, *[-i for i in range(1, max_back + 1)], *range(1, max_forward + 1)]
    cand = nominal.select(
        *nominal.columns, F.posexplode(F.array(*map(F.lit, offsets))).alias("prio", "off")
    ).withColumn("session", F.date_add("nominal", F.col("off")))
    keys = [group] if group else []
    open_days = days.select(*keys, F.col("date").alias("session"), F.lit(True).alias("open"))
    hit = cand.join(open_days, [*keys, "session"], "left")
    return hit.groupBy(*nominal.columns).agg(
        F.min_by("session", F.when(F.col("open"), F.col("prio"))).alias("session")
    )


def region_trade_dates(nominal: DataFrame, days: DataFrame, group: str = "region") -> DataFrame:
    """Trade date per (group, nominal): the resolved session, or the nominal date when it
    is past the group's data or nothing is near."""
    last = days.groupBy(group).agg(F.max("date").alias("last"))
    out = resolve_session(nominal, days, group).join(last, group, "left")
    ahead = F.col("last").isNull() | (F.col("last") < F.col("nominal"))
    return out.withColumn(
        "trade_date",
        F.when(ahead, F.col("nominal")).otherwise(F.coalesce("session", "nominal")),
    )
