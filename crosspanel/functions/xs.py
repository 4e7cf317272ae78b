"""Cross-sectional primitives: statistics, ranks, quantiles within a date.

A date's cross-section grows with the number of symbols, so each primitive has two
plans and picks by ``max_group``, an upper bound on the rows of any one group that the
caller has proven (see ``Tables.n_symbols``) or that is counted here:

* up to ``WINDOW_LIMIT`` cells (rows times columns held at once), one window or one exact
  ``percentile`` buffer per group;
* beyond it, groups are cut into value ranges at sketched split points.  Rows are ranked
  inside their range and shifted by the exact count of the ranges below, and quantiles
  are read from the few distinct values inside a sketched bracket.  The sketch only
  decides how work is cut up, so both plans give the same values, for null group keys and
  text ties of any alphabet too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.session import stage

WINDOW_LIMIT = 2_000_000
N_SPLITS = 64
SKETCH_ACCURACY = 10_000
BRACKET = 1.0 / 500


# Doubles add whole multiples of 2^-20 exactly up to sums of 2^33, and what is left of values from
# 1 on, multiples of 2^-52, over some million rows.
SUM_UNIT, SUM_SPLIT = 2.0**20, 2.0**32


def exact_sum(x: Column) -> Column:
    """Sum of doubles, rounded once, so that the order of the rows doesn't matter.

    Holds for sums up to 2^33; beyond it the sum depends on the order as any sum of doubles does.
    """
    x = x.cast("double")
    fits = F.abs(x) < SUM_SPLIT
    coarse = F.when(fits, F.rint(x * SUM_UNIT) / F.lit(SUM_UNIT)).otherwise(x)
    return F.sum(coarse) + F.sum(F.when(fits, x - coarse).otherwise(F.when(x.isNotNull(), F.lit(0.0))))


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows in the biggest group: a single number, from partially aggregated counts."""
    row = df.groupBy(*by).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def fits_window(df: DataFrame, by: Sequence[str], max_group: int | None,
                width: int = 1) -> tuple[DataFrame, bool]:
    """Whether every group, ``width`` values a row, is small enough for a window over it.

    Past the limit the input is staged, because the other plans pass over it more than
    once.  Without a proven bound it is staged to be counted.
    """
    if max_group is None:
        df = stage(df)
        return df, largest_group(df, by) * width <= WINDOW_LIMIT
    if max_group * width <= WINDOW_LIMIT:
        return df, True
    return stage(df), False


def join_groups(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner",
                small: bool = False) -> DataFrame:
    """Join on group keys, where null equals null; the keys of ``df`` are kept."""
    other = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return df.join(F.broadcast(other) if small else other, same, how).drop(*[f"_on_{k}" for k in keys])


def with_stats(df: DataFrame, by: Sequence[str], aggs: dict[str, Column],
               max_group: int | None = None) -> DataFrame:
    """Attach per-group aggregates to every row.

    Large groups are aggregated map-side and joined back, so no group is collected.  A
    table keyed by DATE alone holds one row per calendar day and is broadcast; any other
    key is left to the optimizer, which broadcasts by measured size and otherwise splits
    skewed join keys.
    """
    df, small = fits_window(df, by, max_group)
    if small:
        w = Window.partitionBy(*by)
        return df.withColumns({n: c.over(w) for n, c in aggs.items()})
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_groups(df, stats, by, "left", small=list(by) == ["date"])


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("date",),
           max_group: int | None = None) -> DataFrame:
    """(x - mean) / sample std per group; a zero or undefined std gives null.

    Applied repeatedly it returns its input, so one pass stands for any iteration count.
    """
    aggs = {}
    for c in cols:
        aggs[f"_m_{c}"], aggs[f"_s_{c}"] = F.avg(c), F.stddev_samp(c)
    out = with_stats(df, by, aggs, max_group)
    z = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in cols}
    return out.withColumns(z).drop(*aggs)


# -- quantiles --------------------------------------------------------------------


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    max_group: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, ``{col}_q{i}`` columns."""
    df, small = fits_window(df, by, max_group, len(cols))
    if small:
        aggs = [F.percentile(c, F.array(*map(F.lit, probs))).alias(f"_{c}") for c in cols]
        wide = df.groupBy(*by).agg(*aggs)
        return wide.select(
            *by, *[F.col(f"_{c}")[i].alias(f"{c}_q{i}") for c in cols for i in range(len(probs))]
        )
    return _bracketed_quantiles(df, by, cols, probs)


def _bracketed_quantiles(df, by, cols, probs) -> DataFrame:
    """Selection between sketched brackets, checked by exact counts.

    A group with a quantile outside its bracket goes again with a wider one, at last with
    all its values, so a poor sketch costs passes but never the result.
    """
    width, done = BRACKET, []
    while True:
        read = stage(_bracket_pass(df, by, cols, probs, width))
        again = F.max("missed").over(Window.partitionBy(*by))
        read = read.withColumn("again", again)
        done.append(read.filter("not again"))
        missed = read.filter("again").select(*by).distinct()
        if width >= 1 or missed.isEmpty():
            break
        df, width = join_groups(df.select(*by, *cols), missed, by, small=list(by) == ["date"]), width * 8
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    names = [f"{c}_q{i}" for c in cols for i in range(len(probs))]
    return out.groupBy(*by).pivot("key", names).agg(F.first("q"))


def _bracket_pass(df, by, cols, probs, width: float) -> DataFrame:
    """(by, key, q, missed): quantiles found by ranks within brackets of ``width`` to each side."""
    low = [max(0.0, p - width) for p in probs]
    high = [min(1.0, p + width) for p in probs]
    sketch = []
    for c in cols:
        sketch.append(F.percentile_approx(c, low + high, SKETCH_ACCURACY).alias(f"_b_{c}"))
        sketch.append(F.count(c).alias(f"_n_{c}"))
    # Small groups keep every value: there the sketch's rank error could exceed the bracket.
    brackets = stage(df.groupBy(*by).agg(*sketch))
    m, few = len(probs), 4 / width
    rows = join_groups(df.select(*by, *cols), brackets, by)
    items, below = [], []
    for c in cols:
        x = F.col(c)
        for i in range(m):
            small = (F.col(f"_n_{c}") <= few) if width < 1 else F.lit(True)
            under = ~small & (x < F.col(f"_b_{c}")[i])
            inside = small | (x <= F.col(f"_b_{c}")[m + i])
            head = (F.lit(f"{c}_q{i}").alias("key"), F.lit(float(probs[i])).alias("p"))
            items.append(F.when(
                x.isNotNull() & ~under & inside, F.struct(*head, F.col(f"_n_{c}").alias("n"), x.alias("value"))
            ))
            below.append(F.struct(
                *head, F.max(f"_n_{c}").alias("n"), F.lit(None).cast("double").alias("value"),
                F.count_if(x.isNotNull() & under).alias("c"),
            ))
    # One counted row per distinct value in the bracket, one for everything below it: only
    # rows inside a bracket are expanded, the others are counted where they are.
    inside = (
        rows.select(*by, F.explode(F.array_compact(F.array(*items))).alias("e"))
        .groupBy(*by, "e.key", "e.p", "e.n", F.col("e.value").cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    under = rows.groupBy(*by).agg(F.array(*below).alias("_under")).select(*by, F.inline("_under"))
    counts = inside.unionByName(under)
    w = Window.partitionBy(*by, "key").orderBy(F.col("value").asc_nulls_first())
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    at = F.col("p") * (F.col("n") - 1)
    k = F.floor(at)
    found = counts.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("c"))
    covers = lambda pos: (F.col("lo") <= pos) & (pos < F.col("hi"))
    a = F.max(F.when(covers(k), F.col("value")))
    b = F.max(F.when(covers(F.least(k + 1, F.col("n") - 1)), F.col("value")))
    frac = F.max(at - k)
    q = a + (b - a) * frac
    return found.groupBy(*by, "key").agg(q.alias("q"), (q.isNull() & (F.max("n") > 0)).alias("missed"))


def with_quantiles(df, by, cols, probs, max_group=None) -> DataFrame:
    """Attach ``{col}_q{i}`` to every row."""
    df, small = fits_window(df, by, max_group, len(cols))
    names = {c: [f"{c}_q{i}" for i in range(len(probs))] for c in cols}
    if small:
        w = Window.partitionBy(*by)
        arr = F.array(*[F.lit(float(p)) for p in probs])
        out = df.withColumns({f"_{c}": F.percentile(c, arr).over(w) for c in cols})
        picked = {n: F.col(f"_{c}")[i] for c in cols for i, n in enumerate(names[c])}
        return out.withColumns(picked).drop(*[f"_{c}" for c in cols])
    q = _bracketed_quantiles(df, by, cols, probs)
    return join_groups(df, q, by, "left", small=list(by) == ["date"])


def winsorize(df, cols, lower=0.02, upper=0.98, by=("date",), max_group=None) -> DataFrame:
    """Clip each column to its quantiles within the group."""
    out = with_quantiles(df, by, cols, (lower, upper), max_group)
    clipped = {
        c: F.when(
            F.col(c).isNotNull(),
            F.least(F.greatest(F.col(c), F.col(f"{c}_q0")), F.col(f"{c}_q1")),
        )
        for c in cols
    }
    return out.withColumns(clipped).drop(*[f"{c}_q{i}" for c in cols for i in (0, 1)])


def subtract_median(df, cols, by, max_group=None, min_size: int = 1) -> DataFrame:
    """x minus the group's median; groups below ``min_size`` rows are left as they are."""
    out = with_quantiles(df, by, cols, (0.5,), max_group)
    if min_size > 1:
        out = with_stats(out, by, {"_size": F.count(F.lit(1))}, max_group)
    else:
        out = out.withColumn("_size", F.lit(1))
    new = {
        c: F.when(F.col("_size") >= min_size, F.col(c) - F.col(f"{c}_q0")).otherwise(F.col(c))
        for c in cols
    }
    return out.withColumns(new).drop("_size", *[f"{c}_q0" for c in cols])


def quantile_bins(df, value: str, q: int, by=("date",), name="bin", max_group=None) -> DataFrame:
    """0-based quantile bin with right-closed edges; repeated edges are merged."""
    out = with_quantiles(df, by, [value], [i / q for i in range(q + 1)], max_group)
    return _binned(out, value, q, name)


def pooled_bins(df, value: str, q: int, by, name="bin") -> DataFrame:
    """``quantile_bins`` for a few groups of any size: edges are aggregated and broadcast.

    ``by`` must have few values, as its edges are one broadcast row each.
    """
    edges = _bracketed_quantiles(df, by, [value], [i / q for i in range(q + 1)])
    return _binned(join_groups(df, edges, by, "left", small=True), value, q, name)


def _binned(out: DataFrame, value: str, q: int, name: str) -> DataFrame:
    edges = F.array_distinct(F.array(*[F.col(f"{value}_q{i}") for i in range(q + 1)]))
    x = F.col(value)
    # Edges strictly below x, less one; the lowest edge belongs to the first bin.
    below = F.size(F.filter(edges, lambda e: e < x))
    return out.withColumn(name, F.greatest(below - 1, F.lit(0))).drop(
        *[f"{value}_q{i}" for i in range(q + 1)]
    )


# -- ranks ------------------------------------------------------------------------


def rank_first(
    df: DataFrame,
    value: str,
    tie: str = "symbol",
    by: Sequence[str] = ("date",),
    descending: bool = False,
    name: str = "pos",
    count: str = "n",
    max_group: int | None = None,
) -> DataFrame:
    """1-based position by (value, tie) among non-null values, and the group's count.

    Rows with a null value are dropped.  Descending order reverses the value only.
    """
    df, small = fits_window(df.filter(F.col(value).isNotNull()), by, max_group)
    order = [F.desc(value) if descending else F.asc(value), F.asc(tie)]
    if small:
        w = Window.partitionBy(*by)
        return df.withColumn(name, F.row_number().over(w.orderBy(*order))).withColumn(
            count, F.count(F.lit(1)).over(w)
        )
    key = F.col(value) * (-1 if descending else 1)
    cut = _cut(df.withColumn("_v", key), by, tie)
    w = Window.partitionBy(*by, "_range", "_sub").orderBy(*order)
    return (
        cut.withColumn(name, (F.row_number().over(w) + F.col("_below")).cast("int"))
        .withColumnRenamed("_total", count)
        .drop("_v", "_range", "_sub", "_below", "_run_below", "_run")
    )


def rank_average(
    df: DataFrame,
    value: str,
    by: Sequence[str] = ("date",),
    name: str = "rank",
    count: str = "n",
    max_group: int | None = None,
) -> DataFrame:
    """Average-tie rank among non-null values; null values keep a null rank."""
    df, small = fits_window(df, by, max_group)
    if small:
        w = Window.partitionBy(*by)
        x = F.col(value)
        first = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
        ties = F.count(x).over(Window.partitionBy(*by, value))
        return df.withColumn(name, F.when(x.isNotNull(), first + (ties - 1) / 2)).withColumn(
            count, F.count(x).over(w)
        )
    # Ties are counted before the shuffle, so a run of equal values is one row.
    present = df.filter(F.col(value).isNotNull())
    runs = stage(present.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties")))
    cut = _cut(runs.withColumn("_v", F.col(value)), by, value, weight="_ties")
    w = Window.partitionBy(*by, "_range", "_sub").orderBy("_v")
    inside = F.sum("_ties").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_ties")
    ranked = cut.select(
        *by,
        value,
        (F.col("_below") + inside + (F.col("_ties") + 1) / 2).alias(name),
        F.col("_total").alias(count),
    )
    return join_groups(df, ranked, [*by, value], "left")


def pct_rank(df, value, by=("date",), name="pct", max_group=None) -> DataFrame:
    """Average-tie percentile rank in (0, 1]."""
    out = rank_average(df, value, by, "_rank", "_count", max_group)
    return out.withColumn(name, F.col("_rank") / F.col("_count")).drop("_rank", "_count")


def _cut(df: DataFrame, by: Sequence[str], tie: str, weight: str | None = None) -> DataFrame:
    """Assign each row to a value range and give the exact count of the ranges below.

    A value that is itself a split point may stand for a large share of the group, so
    its rows form a range of their own, cut again by ranges of the tie column.
    """
    df = stage(df)
    text = dict(df.dtypes)[tie] == "string"
    probs = [i / N_SPLITS for i in range(1, N_SPLITS)]
    ends = df.groupBy(*by).agg(F.min(tie).alias("_first"), F.max(tie).alias("_last"))
    ends = stage(ends.select(*by, (_shared_bytes() if text else F.lit(0)).alias("_skip")))
    # One row per group, without a bound on the groups: left to the optimizer.
    keyed = join_groups(df, ends, by).withColumn("_tie", _tie_key(tie, text)).drop("_skip")
    splits = stage(
        keyed.groupBy(*by).agg(
            F.array_distinct(F.percentile_approx("_v", probs, SKETCH_ACCURACY)).alias("_splits"),
            F.array_distinct(F.percentile_approx("_tie", probs, SKETCH_ACCURACY)).alias("_tie_splits"),
        )
    )
    v, key = F.col("_v"), F.col("_tie")
    under = F.size(F.filter("_splits", lambda s: s < v))
    on_split = F.array_contains("_splits", v)
    tie_range = F.size(F.filter("_tie_splits", lambda s: s < key))
    rows = (
        join_groups(keyed, splits, by)
        .withColumn("_range", 2 * under + on_split.cast("int"))
        .withColumn("_sub", F.when(on_split, tie_range).otherwise(0))
        .drop("_splits", "_tie_splits", "_tie")
    )
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = rows.groupBy(*by, "_range", "_sub").agg(size.alias("_size"))
    # At most 2 * N_SPLITS ranges times N_SPLITS sub-ranges per group.
    w = Window.partitionBy(*by)
    running = F.sum("_size").over(
        w.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, 0)
    )
    offsets = sizes.withColumn("_below", running - F.col("_size")).withColumn(
        "_total", F.sum("_size").over(w)
    )
    return join_groups(rows, offsets.drop("_size"), [*by, "_range", "_sub"])


def _shared_bytes() -> Column:
    """Length of the common prefix, in UTF-8 bytes, of ``_first`` and ``_last``: all texts
    between the two share it."""
    first, last = F.hex(F.encode("_first", "UTF-8")), F.hex(F.encode("_last", "UTF-8"))
    shorter = F.floor(F.least(F.length(first), F.length(last)) / 2).cast("int")
    same = F.filter(
        F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substr(first, F.lit(1), 2 * i) == F.substr(last, F.lit(1), 2 * i),
    )
    return F.coalesce(F.size(same), F.lit(0))


def _tie_key(tie: str, text: bool) -> Column:
    """A number that never falls as the tie rises: itself, or six bytes of a text.

    Texts sort by their UTF-8 bytes.  The six bytes after the group's common prefix decide
    how ties are cut up; inside a piece the whole text is compared.
    """
    if not text:
        return F.col(tie).cast("double")
    six = F.substr(F.hex(F.encode(tie, "UTF-8")), 2 * F.col("_skip") + 1, F.lit(12))
    return F.conv(F.rpad(six, 12, "0"), 16, 10).cast("double")


def top_and_bottom(
    df: DataFrame, n: int, value="prediction", tie="symbol", by=("date",), max_group=None
) -> DataFrame:
    """The n highest (LONG) and n lowest (SHORT) rows per group; rank 1 is most extreme.

    ``row_number() <= n`` lets Spark keep n rows per group before the shuffle, so no
    full cross-section is moved or sorted in one task.
    """
    w = Window.partitionBy(*by)
    df = df.filter(F.col(value).isNotNull())
    parts = []
    for side, order in (
        ("LONG", [F.desc(value), F.asc(tie)]),
        ("SHORT", [F.asc(value), F.desc(tie)]),
    ):
        ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order)))
        parts.append(ranked.filter(F.col("rank") <= n).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])
