"""Walk-forward schedule, fold assembly, MLlib members, bagging and scoring."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from heapq import heappop, heappush
from math import exp, log
from random import Random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import xs
from crosspanel.operators import boosting, ensemble
from crosspanel.session import stage, stage_dir


def schedule(weeks: DataFrame, train: int, val: int, retrain: int, window: str = "rolling",
             max_train: int | None = None, purge_weeks: int = 0) -> DataFrame:
    """One row per retrain: its training, validation and scoring date ranges.

    ``rolling`` trains on the last ``train`` weeks before validation, ``expanding`` on all
    of them, or on at most ``max_train``.  A week's label ends after the next week's close, so
    the last ``purge_weeks`` weeks of training and of validation can be left out: their labels
    overlap what follows.  Input is one row per week of history.
    """
    if not 0 <= purge_weeks < min(train, val):
        raise ValueError("purge_weeks must leave weeks to train and validate on")
    w = Window.orderBy("date")
    idx = weeks.select("date").distinct().select("date", (F.row_number().over(w) - 1).alias("i"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    start = train + val
    rows = idx.withColumn("n", n).filter(
        (F.col("i") >= start) & ((F.col("i") - start) % retrain == 0)
    )
    i = F.col("i")
    if window == "expanding":
        first = F.greatest(i - val - max_train, F.lit(0)) if max_train else F.lit(0)
    else:
        first = i - train - val
    rows = rows.select(
        ((i - start) / retrain).cast("int").alias("retrain_id"),
        F.col("date").alias("retrain_date"),
        first.cast("int").alias("a"), (i - val - 1 - purge_weeks).alias("b"), (i - val).alias("c"),
        (i - 1 - purge_weeks).alias("d"), i.alias("e"), F.least(i + retrain - 1, F.col("n") - 1).alias("f"),
    )
    for name, ref in (("train_from", "a"), ("train_to", "b"), ("val_from", "c"), ("val_to", "d"),
                      ("score_from", "e"), ("score_to", "f")):
        day = idx.select(F.col("i").alias(ref), F.col("date").alias(name))
        rows = rows.join(F.broadcast(day), ref)
    return rows.select("retrain_id", "retrain_date", "train_from", "train_to", "val_from",
                       "val_to", "score_from", "score_to")


def weeks_in(plan: DataFrame, first: str, last: str) -> DataFrame:
    """One row per retrain and week of a date range of the plan, to join on equality."""
    return plan.withColumn("date", F.explode(F.sequence(first, last, F.expr("interval 7 days"))))


def assemble_fold(features: DataFrame, target: DataFrame, cols: Sequence[str],
                  first: Column, last: Column) -> DataFrame:
    """Feature rows of a date range with a target; missing features become 0."""
    rows = features.filter(F.col("date").between(first, last)).na.fill(0.0, list(cols))
    return rows.join(target, ["date", "symbol"]).filter("target is not null")


def _vector(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features")


def gbt(label: str = "target", **params) -> GBTRegressor:
    settings = {"maxDepth": 4, "stepSize": 0.03, "maxIter": 2000, "seed": 42} | params
    return GBTRegressor(labelCol=label, **settings)


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Index of the lowest loss before ``patience`` rounds bring no lower one, and whether
    that happened."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def boosted(fold: DataFrame, label: str = "target", patience: int = 50, **params) -> object:
    """Boosted trees cut at their best round on the rows flagged ``is_val``.

    MLlib's own stop ends at the first round that improves by little, so the rounds are run
    in growing fits without a stop (a longer fit starts with the trees of a shorter one) until
    ``patience`` rounds in a row bring nothing or ``maxIter`` is reached, and the trees up to
    the best round are fitted.  A ``maxIter`` of few patiences is run at once: growing up to it
    would fit as many trees again.  Without validation rows all ``maxIter`` rounds are kept.
    """
    train, val = fold.filter(~F.col("is_val")), fold.filter("is_val")
    most = gbt(label, **params).getMaxIter()
    if val.isEmpty():
        return gbt(label, **params).fit(train)
    rounds = most if most <= 8 * patience else 2 * patience
    while True:
        model = gbt(label, **params | {"maxIter": rounds}).fit(train)
        best, ended = best_round(model.evaluateEachIteration(val, "squared"), patience)
        if ended or rounds == most:
            break
        rounds = min(most, 2 * rounds)
    if best + 1 == rounds:
        return model
    return gbt(label, **params | {"maxIter": best + 1}).fit(train)


def forest(label: str = "target", **params) -> RandomForestRegressor:
    settings = {"numTrees": 400, "maxDepth": 8, "minInstancesPerNode": 50,
                "featureSubsetStrategy": "0.7", "seed": 42} | params
    return RandomForestRegressor(labelCol=label, **settings)


Fit = Callable[[DataFrame], object]


def bagged_gbt(space: dict[str, tuple[float, float]], n_candidates: int = 200, n_select: int = 50,
               logs: Sequence[str] = ("stepSize",), ints: Sequence[str] = ("maxDepth", "maxIter"),
               seed: int = 42, base: dict | None = None, max_group: int | None = None) -> Fit:
    """Random-parameter bag: fit candidates, keep the best by validation rank-IC.

    Only the ``n_select`` best models so far are held.
    """

    def fit(fold: DataFrame):
        rng, kept = Random(seed), []
        for k in range(n_candidates):
            params = (base or {}) | draw_params(space, rng, logs, ints)
            model = boosted(fold, **params, seed=seed + k)
            val = model.transform(fold.filter("is_val"))
            ic = ensemble.rank_ic(val, "prediction", "target", max_group=max_group)
            value = ensemble.mean_rank_ic(ic).first()[0]
            heappush(kept, (value if value is not None else float("-inf"), -k, model))
            if len(kept) > n_select:
                heappop(kept)
        return [m for _, _, m in sorted(kept, key=lambda s: s[:2], reverse=True)]

    return fit


# The ranges that the bag draws from.
LEAFWISE_SPACE = {"leaves": (15, 63), "rate": (0.01, 0.08), "columns": (0.5, 0.9), "rows": (0.5, 0.9),
                  "min_rows": (20, 200), "l2": (0.0, 5.0)}


def leafwise(cols: Sequence[str], **params) -> Fit:
    """Leaf-wise boosted trees with early stopping: the second boosting member."""
    return lambda fold: boosting.fit_all(fold, cols, [boosting.Spec(**params)])


def leafwise_bag(cols: Sequence[str], space: dict[str, tuple[float, float]] = LEAFWISE_SPACE,
                 n_candidates: int = 200, n_select: int = 50, seed: int = 42, base: dict | None = None,
                 max_group: int | None = None) -> Fit:
    """Random-parameter bag of leaf-wise boosters, fitted by ``boosting.fit_bag``.

    Gives the ``n_select`` candidates of best mean rank-IC on the validation rows, best first;
    candidates without a rank-IC come last.
    """

    def fit(fold: DataFrame) -> list[boosting.Booster]:
        rng = Random(seed)
        specs = [
            boosting.Spec(**(base or {}) | draw_params(space, rng, ("rate",), ("leaves", "min_rows")),
                          seed=rng.randrange(2**31))
            for _ in range(n_candidates)
        ]
        fitted = boosting.fit_bag(fold, cols, specs)
        val = boosting.score_each(fold.filter("is_val"), fitted, ["date", "symbol", "target"])
        ic = ensemble.rank_ic(val, "prediction", "target", ["candidate"], max_group=max_group)
        found = {r.candidate: r.ic for r in ensemble.mean_rank_ic(ic, ["candidate"]).collect() if r.ic is not None}
        best = sorted(range(n_candidates), key=lambda c: (-found.get(c, float("-inf")), c))
        return [fitted[c] for c in best[:n_select]]

    return fit


def draw_params(space: dict[str, tuple[float, float]], rng: Random, logs: Sequence[str],
                ints: Sequence[str]) -> dict:
    """One draw per range: log-uniform for the listed names, rounded for integer ones."""
    out = {}
    for name, (lo, hi) in space.items():
        v = exp(rng.uniform(log(lo), log(hi))) if name in logs else rng.uniform(lo, hi)
        out[name] = int(round(v)) if name in ints else v
    return out


def score(model, rows: DataFrame, keep: Sequence[str] = ("date", "symbol")) -> DataFrame:
    """Predictions of one model, or the mean over a bag."""
    models = model if isinstance(model, list) else [model]
    if isinstance(models[0], boosting.Booster):
        return boosting.score(rows, models, keep)
    out = rows
    for i, m in enumerate(models):
        out = m.copy({m.predictionCol: f"_p{i}"}).transform(out)
    total = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0))
    return out.select(*keep, (total / len(models)).alias("prediction"))


def walk_forward(features: DataFrame, target: DataFrame, cols: Sequence[str], plan: DataFrame,
                 members: dict[str, Fit],
                 max_group: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit every member at each retrain and score the weeks of its block.

    Returns predictions (date, symbol, model, prediction, retrain_id), validation rank-IC per
    (retrain_id, model), and feature importances.  The driver loops over the retrains in
    the plan, each a distributed MLlib fit; data stays in the tables, and the predictions of
    each block are written as it is fitted.
    """
    spark = features.sparkSession
    folder = f"{stage_dir(spark)}/predictions-{uuid.uuid4().hex}"
    vec = _vector(cols)
    features = stage(features.na.fill(0.0, list(cols)))
    joined = stage(features.join(target, ["date", "symbol"]).filter("target is not null"))
    ics, imps = [], []
    for row in plan.orderBy("retrain_id").collect():
        in_val = F.col("date").between(row.val_from, row.val_to)
        fold = joined.filter(F.col("date").between(row.train_from, row.val_to))
        fold = vec.transform(fold.withColumn("is_val", in_val)).cache()
        weeks = features.filter(F.col("date").between(row.score_from, row.score_to))
        for name, fit in members.items():
            model = fit(fold)
            score(model, vec.transform(weeks)).write.parquet(f"{folder}/retrain_id={row.retrain_id}/model={name}")
            val = score(model, fold.filter("is_val"), ["date", "symbol", "target"])
            ic = ensemble.rank_ic(val, "prediction", "target", max_group=max_group)
            value = ensemble.mean_rank_ic(ic).first()[0]
            ics.append((row.retrain_id, row.score_from, row.score_to, name, value))
            imps += [(row.retrain_id, name, c, v) for c, v in feature_importance(model, cols).items()]
        fold.unpersist()
    schema = features.select("date", "symbol").schema.add("prediction", "double")
    every = spark.read.schema(schema.add("retrain_id", "integer").add("model", "string")).parquet(folder)
    ic_table = spark.createDataFrame(
        ics, "retrain_id int, score_from date, score_to date, model string, val_ic double"
    )
    imp_table = spark.createDataFrame(
        imps, "retrain_id int, model string, feature string, importance double"
    )
    return every, ic_table, imp_table


def feature_importance(model, cols: Sequence[str]) -> dict[str, float]:
    """Share of the splits' gain by column: that of one model, or the mean over a bag."""
    models = model if isinstance(model, list) else [model]
    each = [
        m.importances() if isinstance(m, boosting.Booster) else dict(zip(cols, m.featureImportances.toArray().tolist()))
        for m in models
    ]
    return {c: sum(x[c] for x in each) / len(each) for c in cols}


def permutation_importance(model, fold: DataFrame, cols: Sequence[str], label: str = "target",
                           seed: int = 7, max_group: int | None = None) -> list[tuple[str, float]]:
    """Drop in mean rank-IC when one column's values are exchanged between rows.

    A column is permuted inside each date by pairing two hashed orders of its rows: the k-th
    row of one takes the value of the k-th of the other.  Positions come from
    ``xs.rank_first``, so a date of any size gets the same permutation.
    """
    return importances(lambda rows: score(model, _vector(cols).transform(rows), ["date", "symbol", label]),
                       fold, cols, label, seed, max_group)


def hashed_symbol(seed: int) -> Column:
    return F.xxhash64("symbol", F.lit(seed))


def permuted(rows: DataFrame, col: str, seed: int = 7, max_group: int | None = None,
             order: Callable[[int], Column] = hashed_symbol) -> DataFrame:
    """``rows`` with the values of ``col`` exchanged within each date.

    ``order`` gives a number to order a date's rows by, for each seed.
    """
    for i in (0, 1):
        rows = rows.withColumn(f"_h{i}", order(seed + i))
        rows = xs.rank_first(rows, f"_h{i}", name=f"_k{i}", count="_n", max_group=max_group).drop("_n")
    rows = stage(rows.drop("_h0", "_h1"))
    taken = rows.select("date", F.col("_k1").alias("_k0"), F.col(col).alias("_value"))
    return (
        xs.join_groups(rows.drop(col), taken, ["date", "_k0"])
        .withColumnRenamed("_value", col).drop("_k0", "_k1")
    )


def importances(predict: Callable[[DataFrame], DataFrame], fold: DataFrame, cols: Sequence[str],
                label: str = "target", seed: int = 7, max_group: int | None = None,
                order: Callable[[int], Column] = hashed_symbol) -> list[tuple[str, float]]:
    """(column, loss of mean rank-IC) of any scorer that adds ``prediction``."""

    def quality(rows):
        ic = ensemble.rank_ic(predict(rows), "prediction", label, max_group=max_group)
        return ensemble.mean_rank_ic(ic).first()[0] or 0.0

    fold = stage(fold.drop("features"))
    base = quality(fold)
    return [(c, base - quality(permuted(fold, c, seed, max_group, order))) for c in cols]


def retrain_due(weeks: DataFrame, retrains: DataFrame, every_weeks: int) -> DataFrame:
    """Last retrain up to each week and whether a new one is due."""
    w = Window.orderBy("date")
    marked = weeks.join(F.broadcast(retrains.withColumn("retrain_date", F.col("date"))), "date", "left")
    last = F.last("retrain_date", ignorenulls=True).over(w)
    out = marked.withColumn("last_retrain", last)
    due = F.col("last_retrain").isNull() | (
        F.datediff("date", "last_retrain") >= 7 * every_weeks
    )
    return out.select("date", "last_retrain", due.alias("due"))


def run_parts(features: Sequence[str], member_params: dict[str, dict], train: int, val: int, retrain: int,
              window: str, max_train: int | None, signal_day: str) -> list[str]:
    """Texts that identify a run but for its dates, which go before the last of them."""
    return [
        "|".join(features), "|".join(sorted(member_params)), f"{train},{val},{retrain}", window,
        f"cap={'' if max_train is None else max_train}", signal_day.upper(),
        json.dumps(member_params, sort_keys=True),
    ]


def fingerprint(parts: Sequence[Column], length: int = 16) -> Column:
    """Short SHA-1 over newline-joined parts, e.g. features, members, windows and dates."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts)), 1, length)


def spec_changes(versions: DataFrame) -> DataFrame:
    """Versions whose hash differs from the one before, per signal day."""
    w = Window.partitionBy("signal_day").orderBy("bundle_retrain_date")
    prev = F.lag("config_hash").over(w)
    return versions.withColumn("_p", prev).filter(~F.col("config_hash").eqNullSafe(F.col("_p"))).drop("_p")
