"""Mixing of sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear.  Its integral is
the source's cumulative token demand.  The documents of a source, in the order of a digest,
are laid end to end, pass after pass, up to the source's target; the demand curve is inverted
at the middle of each document to give its training position, and documents are range-sorted
by position.  A document whose middle lies beyond the target is not taken.  A source's words
come within half a document of its target, and no document is taken more than ``MAX_PASSES``
times.

Targets: sources by code point, null last, weigh ``WEIGHTS`` in turn and share the sum of all
sizes; a target stops at ``MAX_PASSES`` times the source's size and what is over is reshared
by weight until none is above (solved in one pass over the sources: the sources that are cut
are those with the smallest size per weight).

Sizes are word counts.  Null, empty and wordless texts have size 0 and take nothing.  Rows
equal in id, source and text are counted before the shuffle and laid one after the other.
A hot source is cut into buckets of the digest.  One row per source goes through one task, to
rank them.  An empty table gives an empty result; clashing extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.llm.ordering import copies, digest, key_text, running_start
from crosspanel.session import stage

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
# (time, relative weight) of each weight class: the heaviest early, the lightest late.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
KEY = ["doc_id", "source", "size", "text_hash"]


def keyed(
    docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", whole: bool = False
) -> DataFrame:
    """The key of each row; with the row itself as a struct, if ``whole``."""
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    key = {
        "doc_id": F.col(id_col).cast("long"),
        "source": F.col(source_col).cast("string"),
        "size": F.coalesce(words, F.lit(0)).cast("long"),
        "text_hash": F.xxhash64(F.col(text_col)),
    }
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] if whole else []
    return docs.select(*row, *[col.alias(name) for name, col in key.items()])


def digest_key(*cols: str) -> Column:
    return F.md5(key_text(*cols))


def targets(rows: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, class (index of its weight), target, of rows with n and size."""
    by_point = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    sources = (
        rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
        .withColumn("class", ((F.row_number().over(by_point) - 1) % len(weights)).cast("int"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("double"))
        .withColumn("cap", (F.col("source_size") * max_passes).cast("double"))
    )
    # Cut sources come first in this order; all before the first that fits are cut.
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8")]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (
        sources.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(from_here))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("share", F.min(F.when(F.col("fits"), F.struct(
            (F.col("cap") / F.col("weight")).alias("at"), F.col("level").alias("level"))))
            .over(everything)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap")))
    target = F.round(target, 6)
    return level.select("source", "source_size", "class", target.alias("target"))


def _segments(schedule) -> list[tuple[float, ...]]:
    """(demand at start, start, weight at start, slope) of each piece, for a total demand of 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))
    out, demand = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((demand, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        demand += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position_at(demand: Column, klass: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integral of the class's schedule reaches ``demand`` (0..1)."""
    out = F.lit(None).cast("double")
    for c, schedule in enumerate(schedules):
        here = F.lit(None).cast("double")
        for d0, t0, w0, slope in _segments(schedule):
            d = F.greatest(demand - d0, F.lit(0.0))
            t = t0 + 2 * d / (w0 + F.sqrt(F.greatest(w0 * w0 + 2 * slope * d, F.lit(0.0))))
            here = F.when(demand >= d0, t).otherwise(here)
        out = F.when(klass == c, here).otherwise(out)
    return out


def plan(
    docs: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES, schedules=SCHEDULES, **cols: str
) -> DataFrame:
    """One row per document: its key (doc_id, source, size, text_hash), n (equal rows), copy
    (0..n-1), source_size, target, positions (one per pass taken, ascending)."""
    rows = stage(
        keyed(docs, **cols).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", digest(key_text("doc_id", "size")))
        .withColumn("words", F.col("n") * F.col("size"))
    )
    goal = stage(targets(rows, weights, max_passes))
    placed = running_start(rows, "words", ["doc_id", "size", "text_hash"], rows.count(), ["source"])
    joined = placed.join(
        goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source", "words", "h")
    middle = F.col("start") + F.col("copy") * F.col("size") + F.col("size") / 2
    passes = F.array(*[
        F.when(middle + F.col("source_size") * e < F.col("target"),
               position_at((middle + F.col("source_size") * e) / F.col("target"), F.col("class"), schedules))
        for e in range(max_passes)
    ])
    return copies(joined, "n", "copy").select(
        *KEY, "n", "copy", "source_size", "target",
        F.when(F.col("size") > 0, F.array_compact(passes)).otherwise(F.array().cast("array<double>"))
        .alias("positions"),
    )


def in_order(rows: DataFrame, position: str = "position") -> DataFrame:
    """Range-sorted by training position, untaken documents last."""
    return rows.orderBy(F.col(position).asc_nulls_last(), "doc_id")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, range-sorted by training position."""
    taken = plan(docs, **options).filter(F.size("positions") > 0).select(
        digest_key(*KEY).alias("key"), "copy", "positions"
    )
    # Equal rows are told apart by number; the join needs no other shuffle than this window's.
    each = W.partitionBy("key").orderBy(F.lit(0))
    rows = (
        keyed(docs, whole=True, **options)
        .select("whole", digest_key(*KEY).alias("key"))
        .withColumn("copy", (F.row_number().over(each) - 1).cast("long"))
    )
    return (
        rows.join(taken, ["key", "copy"])
        .select("whole", "key", F.explode("positions").alias("position"))
        .orderBy("position", "key")
        .select("whole.*")
    )
