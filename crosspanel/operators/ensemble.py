"""Rank-IC, member combination and attribution aggregates.

Member predictions are long: (date, symbol, model, prediction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import xs
from crosspanel.session import stage


def rank_ic(rows: DataFrame, pred: str, actual: str, keys: Sequence[str] = (), min_names: int = 5,
            max_group: int | None = None) -> DataFrame:
    """Spearman correlation per (keys, date): Pearson on average-tie ranks.

    Dates with fewer than ``min_names`` rows, or without spread, give null.
    """
    by = [*keys, "date"]
    both = rows.dropna(subset=[pred, actual])
    ranked = xs.rank_average(both, pred, by, "_rp", "_n", max_group).drop("_n")
    ranked = xs.rank_average(ranked, actual, by, "_ra", "_n", max_group)
    # Not ``corr``, which fails on a date without spread.
    spread = F.stddev_samp("_rp") * F.stddev_samp("_ra")
    ic = F.when(F.count(F.lit(1)) >= min_names, F.try_divide(F.covar_samp("_rp", "_ra"), spread))
    return ranked.groupBy(*by).agg(ic.alias("ic"))


def mean_rank_ic(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ic.groupBy(*keys).agg(F.avg("ic").alias("ic"))


def combine_mean(preds: DataFrame) -> DataFrame:
    return preds.groupBy("date", "symbol").agg(F.avg("prediction").alias("prediction"))


def member_ranks(preds: DataFrame, max_group: int | None = None) -> DataFrame:
    return xs.pct_rank(preds, "prediction", ["model", "date"], "pct", max_group)


def combine_rank_mean(preds: DataFrame, max_group: int | None = None) -> DataFrame:
    ranked = member_ranks(preds, max_group)
    return ranked.groupBy("date", "symbol").agg(F.avg("pct").alias("prediction"))


def combine_ic_weighted(preds: DataFrame, val_ic: DataFrame, members: Sequence[str],
                        max_group: int | None = None) -> DataFrame:
    """Rank sum weighted by max(val_ic, 0), normalized per date over the members.

    Equal weights where no member is positive or the date has no IC; an absent member
    adds nothing.  ``val_ic`` is one row per (date, member), small and broadcast.
    """
    k = len(members)
    clipped = F.greatest(F.col("val_ic"), F.lit(0.0))
    per_date = val_ic.groupBy("date").agg(F.sum(clipped).alias("_total"))
    w = val_ic.join(per_date, "date").select(
        "date", "model",
        F.when(F.col("_total") > 0, F.coalesce(clipped / F.col("_total"), F.lit(1.0 / k)))
        .otherwise(1.0 / k).alias("_w"),
    )
    ranked = member_ranks(preds, max_group).join(F.broadcast(w), ["date", "model"], "left")
    term = F.col("pct") * F.coalesce("_w", F.lit(1.0 / k))
    return ranked.groupBy("date", "symbol").agg(F.sum(term).alias("prediction"))


def combine_stack(preds: DataFrame, target: DataFrame, members: Sequence[str],
                  min_weeks: int = 26, alpha: float = 1.0, max_group: int | None = None) -> DataFrame:
    """Walk-forward ridge of the target on member ranks, fit on all earlier weeks.

    Each week contributes its moments once; running sums over weeks give every week's
    normal equations, solved by a Cholesky decomposition for any number of members.  Weeks
    without enough history use the rank mean.
    """
    ms = list(members)
    # Stored: both the moments and the scores are taken from it.
    ranked = stage(member_ranks(preds, max_group).groupBy("date", "symbol").agg(
        *[F.max(F.when(F.col("model") == m, F.col("pct"))).alias(m) for m in ms]
    ))
    both = ranked.join(target.select("date", "symbol", "target"), ["date", "symbol"], "left")
    complete = F.col("target").isNotNull()
    for m in ms:
        complete = complete & F.col(m).isNotNull()
    x = {m: F.when(complete, F.col(m)) for m in ms}
    y = F.when(complete, F.col("target"))
    sums = {"n": F.count(y).cast("double"), "y": F.sum(y)}
    sums |= {f"x{i}": F.sum(x[m]) for i, m in enumerate(ms)}
    sums |= {f"xy{i}": F.sum(x[m] * y) for i, m in enumerate(ms)}
    sums |= {
        f"xx{i}{j}": F.sum(x[ms[i]] * x[ms[j]])
        for i in range(len(ms)) for j in range(i, len(ms))
    }
    weekly = both.groupBy("date").agg(*[e.alias(f"_{k}") for k, e in sums.items()])
    w = Window.orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    run = weekly.select(
        "date", (F.row_number().over(w) - 1).alias("_week"),
        *[F.coalesce(F.sum(f"_{k}").over(past), F.lit(0.0)).alias(f"_{k}") for k in sums],
    )
    n = F.nullif("_n", F.lit(0.0))
    cov = lambda k, a, b: F.col(f"_{k}") - F.col(f"_{a}") * F.col(f"_{b}") / n
    a = [
        [cov(f"xx{min(i, j)}{max(i, j)}", f"x{i}", f"x{j}") + (alpha if i == j else 0.0)
         for j in range(len(ms))]
        for i in range(len(ms))
    ]
    b = [cov(f"xy{i}", f"x{i}", "y") for i in range(len(ms))]
    enough = (F.col("_week") >= min_weeks) & (n >= len(ms) + 1)
    means = [(F.col(f"_x{i}") / n).alias(f"_m{i}") for i in range(len(ms))]
    k = range(len(ms))
    cells = [a[i][j].alias(f"_a{i}_{j}") for i in k for j in range(i + 1)]
    coef = run.select("date", enough.alias("_ok"), *means, *cells, *[b[i].alias(f"_z{i}") for i in k])
    coef = solved(coef, len(ms)).select("date", "_ok", *[f"_{c}{i}" for c in "mb" for i in k])
    scored = ranked.join(F.broadcast(coef), "date")
    stacked = F.lit(0.0)
    for i, m in enumerate(ms):
        stacked = stacked + (F.col(m) - F.col(f"_m{i}")) * F.col(f"_b{i}")
    seen = sum((F.col(m).isNotNull().cast("int") for m in ms), F.lit(0))
    mean = sum((F.coalesce(m, F.lit(0.0)) for m in ms), F.lit(0.0)) / seen
    return scored.select(
        "date", "symbol", F.when(F.col("_ok"), stacked).otherwise(mean).alias("prediction")
    )


def solved(df: DataFrame, k: int) -> DataFrame:
    """Adds ``_b0``.. with A b = z for the symmetric A of ``_a{i}_{j}`` (j <= i) and ``_z{i}``.

    A = L D L' column by column, then the two triangular systems.  Each step is a projection
    on the columns of the one before, so expressions stay short however many members there are.
    """
    col = F.col
    for j in range(k):
        df = df.withColumn(f"_d{j}", col(f"_a{j}_{j}") - sum(
            (col(f"_l{j}_{p}") * col(f"_l{j}_{p}") * col(f"_d{p}") for p in range(j)), F.lit(0.0)))
        df = df.withColumns({f"_l{i}_{j}": F.try_divide(col(f"_a{i}_{j}") - sum(
            (col(f"_l{i}_{p}") * col(f"_l{j}_{p}") * col(f"_d{p}") for p in range(j)), F.lit(0.0)), col(f"_d{j}"))
            for i in range(j + 1, k)})
    for i in range(k):
        df = df.withColumn(f"_y{i}", col(f"_z{i}") - sum((col(f"_l{i}_{p}") * col(f"_y{p}") for p in range(i)), F.lit(0.0)))
    for i in reversed(range(k)):
        df = df.withColumn(f"_b{i}", F.try_divide(col(f"_y{i}"), col(f"_d{i}")) - sum(
            (col(f"_l{p}_{i}") * col(f"_b{p}") for p in range(i + 1, k)), F.lit(0.0)))
    return df


def combine(method: str, preds: DataFrame, **inputs) -> DataFrame:
    """Combine by name: mean, rank_mean, ir_weighted or stack."""
    methods = {"mean": combine_mean, "rank_mean": combine_rank_mean,
               "ir_weighted": combine_ic_weighted, "stack": combine_stack}
    if method not in methods:
        raise ValueError(f"unknown combine method: {method}")
    return methods[method](preds, **inputs)


def score_week(preds: DataFrame, method: str = "rank_mean", max_group: int | None = None) -> DataFrame:
    """One live cross-section: methods that need history fall back to the rank mean."""
    if method == "mean":
        return combine_mean(preds)
    return combine_rank_mean(preds, max_group)


# -- attributions -------------------------------------------------------------------
# Long rows: (date, symbol, member, feature, value, attr).


def mean_abs_attribution(attr: DataFrame) -> DataFrame:
    return attr.groupBy("member", "feature").agg(F.avg(F.abs("attr")).alias("mean_abs"))


def average_members(attr: DataFrame) -> DataFrame:
    """Mean attribution over members after equalizing their mean magnitude per date."""
    scale = attr.groupBy("date", "member").agg(F.avg(F.abs("attr")).alias("_scale"))
    sized = attr.join(F.broadcast(scale), ["date", "member"])
    a = F.when(F.col("_scale") > 0, F.col("attr") / F.col("_scale")).otherwise(F.col("attr"))
    return sized.groupBy("date", "symbol", "feature").agg(
        F.avg(a).alias("attr"), F.first("value").alias("value")
    )


def top_drivers(attr: DataFrame, k: int = 2) -> DataFrame:
    """The k largest attributions per row as text, largest first; zeros are left out."""
    w = Window.partitionBy("date", "symbol").orderBy(F.desc(F.abs("attr")), "feature")
    top = attr.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).filter("attr <> 0")
    piece = F.concat(
        "feature", F.lit(" "), F.when(F.col("value") >= 0, "high").otherwise("low"),
        F.when(F.col("attr") > 0, " (pushes score up)").otherwise(" (pushes score down)"),
    )
    listed = F.array_sort(F.collect_list(F.struct("r", piece.alias("p"))))
    return top.groupBy("date", "symbol").agg(
        F.array_join(F.transform(listed, lambda s: s["p"]), "; ").alias("commentary")
    )
