"""Keyed table maintenance: append-only merges, upserts, coverage, partitioned results.

Spark files are immutable, so a merge here returns the whole new table, and
:func:`write_version` puts it beside the old one.  ``sources.keyed`` has tables that rewrite
only the buckets a change touches and name their current version.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load_bars(rows: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row per (date, symbol); repeated rows are averaged."""
    if symbols is not None:
        rows = rows.join(symbols, "symbol", "left_semi")
    return rows.groupBy("date", "symbol").agg(
        F.avg("price").alias("close"), F.avg("quantity").alias("volume")
    )


def to_wide(long: DataFrame, column: str, names: Sequence, value: str) -> DataFrame:
    """Export form: one row per date, one column per listed name.

    The names are given, so the pivot needs no pass to find them.
    """
    return long.groupBy("date").pivot(column, list(names)).agg(F.avg(value))


def normalize_day(ts: Column) -> Column:
    """Timestamp or text, zoned or not, to the calendar day."""
    return F.to_date(ts)


def first_by_key(rows: DataFrame, keys: Sequence[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the earliest (or latest) by ``order``.

    A min/max over structs combines map-side, so a key repeated without end never
    gathers its copies in one task.
    """
    rest = [c for c in rows.columns if c not in keys and c != order]
    pick = (F.max_by if last else F.min_by)(F.struct(order, *rest), order)
    return rows.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def merge_append_only(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Existing rows win; new rows are deduplicated (first by ``order``) and added.

    ``added`` marks rows that came from ``new``.
    """
    fresh = first_by_key(new, keys, order).join(existing, list(keys), "left_anti")
    fresh = fresh.select(*existing.columns)
    return existing.withColumn("added", F.lit(False)).unionByName(
        fresh.withColumn("added", F.lit(True))
    )


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert or replace: the row with the latest ``order`` wins for each key."""
    return first_by_key(existing.unionByName(new), keys, order, last=True)


def insert_missing(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill gaps only: a key already present keeps its row."""
    return existing.unionByName(new.join(existing, list(keys), "left_anti"))


def refresh_ranges(cached: DataFrame, wanted: DataFrame, start: str, end: str,
                   refresh_days: int = 7) -> DataFrame:
    """(symbol, kind, range_from, range_to) still to fetch for a requested span.

    No cached rows: the whole span.  Otherwise the gap before the first cached day and
    the trailing refresh window, each only where it is not empty.
    """
    start_d, end_d = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    have = cached.groupBy("symbol").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    df = wanted.join(have, "symbol", "left")
    day = lambda e: e.cast("date")
    span = lambda kind, a, b: F.struct(
        F.lit(kind).alias("kind"), day(a).alias("range_from"), day(b).alias("range_to")
    )
    tail_from = F.greatest(start_d, F.date_sub("hi", refresh_days))
    ranges = F.array_compact(
        F.array(
            F.when(F.col("lo").isNull(), span("full", start_d, end_d)),
            F.when(start_d < F.col("lo"), span("leading", start_d, F.date_sub("lo", 1))),
            F.when(F.col("lo").isNotNull() & (end_d >= tail_from), span("trailing", tail_from, end_d)),
        )
    )
    return df.select("symbol", F.explode(ranges).alias("r")).select("symbol", "r.*")


def failure_guard(cached: DataFrame, wanted: DataFrame, max_rate: float = 0.05,
                  min_batch: int = 20) -> DataFrame:
    """One row: requested, failed, rate, and whether the batch must be refused."""
    have = cached.select("symbol").distinct().withColumn("ok", F.lit(1))
    c = wanted.join(have, "symbol", "left").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("ok").isNull()).alias("failed"),
    )
    rate = F.try_divide(F.col("failed").cast("double"), F.col("requested"))
    return c.withColumn("rate", rate).withColumn(
        "refuse", (F.col("requested") >= min_batch) & (rate > max_rate)
    )


def freshness(bars: DataFrame, floor: Column) -> DataFrame:
    """Last day per symbol and whether it reaches the floor."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    return last.withColumn("fresh", F.col("last_date") >= floor)


def missing_and_extra(found: DataFrame, expected: DataFrame, col: str) -> DataFrame:
    """Names expected but absent, and present but not expected."""
    a, b = expected.select(col).distinct(), found.select(col).distinct()
    return a.subtract(b).withColumn("status", F.lit("missing")).unionByName(
        b.subtract(a).withColumn("status", F.lit("extra"))
    )


def assemble_series(long: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every series on every calendar row from its first value on, carried forward.

    Like the price grid, a value is repeated up to the series' next row.
    """
    w = Window.partitionBy("series").orderBy("t")
    rows = long.filter(F.col("value").isNotNull()).join(F.broadcast(calendar), "date").drop("date")
    until = F.coalesce(F.lead("t").over(w), F.col("n_days")) - 1
    cells = rows.withColumn("until", until).select(
        "series", "value", F.explode(F.sequence("t", "until")).alias("t")
    )
    return cells.join(F.broadcast(calendar.select("t", "date")), "t").select("date", "series", "value")


def unpivot_tenors(curve: DataFrame, tenors: Sequence[str]) -> DataFrame:
    """Wide yield-curve rows to long (date, series, value), nulls dropped."""
    return curve.unpivot(["date"], list(tenors), "series", "value").filter("value is not null")


# -- results ---------------------------------------------------------------------


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``.

    The rebalance hint gathers a partition's rows into few files and lets AQE split a
    partition that holds a large share of the table over several tasks.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest partition, by the names of the folders; no file of another is opened."""
    df = spark.read.parquet(path)
    folders = df.inputFiles()
    values = {m[1] for m in (re.search(rf"/{re.escape(key)}=([^/]*)/", f) for f in folders) if m}
    dated = [v for v in values if v != "__HIVE_DEFAULT_PARTITION__"]
    if not dated:
        return df.limit(0)
    names = spark.createDataFrame([(unquote(v),) for v in dated], "v string")
    newest = names.agg(F.max(F.col("v").cast(df.schema[key].dataType))).scalar()
    return df.filter(F.col(key) == newest)


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Write a table version beside the earlier ones and return its folder."""
    folder = f"{path}/version={version:08d}"
    df.write.mode("errorifexists").parquet(folder)
    return folder


def write_csv_mirror(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Sorted CSV export.  The range-partitioned sort keeps part files in global order,
    so no single task has to hold the table."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """One JSON object per row, for the small metrics tables."""
    df.write.mode("overwrite").json(path)
