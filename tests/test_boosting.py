"""Leaf-wise boosting against a plain implementation, and the shared passes of a bag."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import boosting, walkforward
from crosspanel.operators.boosting import Spec


def panel(seed=3, weeks=12, names=60, n=3):
    rng = np.random.default_rng(seed)
    days = [dt.date(2020, 1, 2) + dt.timedelta(7 * w) for w in range(weeks)]
    pdf = pd.DataFrame([(d, s, *rng.normal(size=n).round(1)) for d in days for s in range(names)],
                       columns=["date", "symbol", *[f"f{i}" for i in range(n)]])
    pdf["target"] = np.where(pdf.f0 > 0.3, np.where(pdf.f1 > 0, 1.0, -1.0), 0.5 * pdf.f1) + rng.normal(size=len(pdf)) * 0.2
    pdf["is_val"] = pdf.date >= days[-3]
    return pdf


def plain_tree(bins, g, spec, columns):
    """Split by split, every leaf looked through each time: places and values of the leaves."""
    def best(rows):
        found = None
        for f in columns:
            for cut in np.unique(bins[rows, f]):
                left = rows[bins[rows, f] <= cut]
                right = rows[bins[rows, f] > cut]
                if min(len(left), len(right)) < spec.min_rows:
                    continue
                part = lambda r: g[r].sum() ** 2 / (len(r) + spec.l2)
                gain = part(left) + part(right) - part(rows)
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = gain, f, cut
        return found

    leaves = [(np.arange(len(g)), lambda b: np.ones(len(b), bool))]
    while len(leaves) < spec.leaves:
        gains = [best(rows) for rows, _ in leaves]
        if not any(gains):
            break
        i = max(range(len(leaves)), key=lambda j: gains[j][0] if gains[j] else -1)
        (rows, inside), (_, f, cut) = leaves.pop(i), gains[i]
        leaves.append((rows[bins[rows, f] <= cut], lambda b, p=inside, f=f, c=cut: p(b) & (b[:, f] <= c)))
        leaves.append((rows[bins[rows, f] > cut], lambda b, p=inside, f=f, c=cut: p(b) & (b[:, f] > c)))
    return lambda b: sum(inside(b) * spec.rate * g[rows].sum() / (len(rows) + spec.l2) for rows, inside in leaves)


def plain_boosting(spark, pdf, cols, spec, edges):
    h = np.array([r[0] for r in spark.createDataFrame(pdf[["date", "symbol"]]).select(F.xxhash64("date", "symbol")).collect()])
    bins = boosting.binned(pdf[cols].to_numpy(), edges)
    y, val = pdf.target.to_numpy(), pdf.is_val.to_numpy()
    score = np.full(len(y), y[~val].mean())
    trees, losses = [], []
    for step in range(spec.rounds + 1):
        losses.append(np.square(y - score)[val].mean())
        if step == spec.rounds or len(losses) - 1 - int(np.argmin(losses)) >= spec.patience:
            break
        rows = np.flatnonzero(~val & boosting.drawn(h, spec.rows, spec.seed, step))
        columns = boosting.drawn_columns(len(cols), spec, step)
        trees.append(plain_tree(bins[rows], (y - score)[rows], spec, columns))
        score = score + trees[-1](bins)
    kept = max(1, int(np.argmin(losses)))
    return sum((t(bins) for t in trees[:kept]), np.full(len(y), y[~val].mean())), losses


SPECS = [
    Spec(rounds=3, leaves=6, rate=0.3, l2=1.0, rows=0.7, columns=0.7, min_rows=5, patience=3, seed=1),
    Spec(rounds=2, leaves=31, rate=0.5, l2=0.0, rows=1.0, columns=1.0, min_rows=9, patience=1, seed=2),
    Spec(rounds=3, leaves=2, rate=1.5, l2=3.0, rows=0.5, columns=0.4, min_rows=20, patience=1, seed=3),
]


def test_shared_passes_equal_plain_boosting(spark):
    pdf, cols = panel(), ["f0", "f1", "f2"]
    fold = spark.createDataFrame(pdf).repartition(5)
    edges = [np.linspace(-2, 2, 17)] * 3
    fitted = boosting.fit_all(fold, cols, SPECS, edges=edges)
    each = boosting.score_each(fold, fitted).toPandas()
    for c, spec in enumerate(SPECS):
        want, losses = plain_boosting(spark, pdf, cols, spec, edges)
        assert np.allclose(fitted[c].losses, losses[: len(fitted[c].losses)], atol=1e-9)
        assert len(fitted[c].losses) == len(losses)
        got = pdf.merge(each[each.candidate == c], on=["date", "symbol"]).prediction.to_numpy()
        assert np.allclose(got, want, atol=1e-9)
    mean = boosting.score(fold, fitted).toPandas()
    merged = each.groupby(["date", "symbol"]).prediction.mean().reset_index().merge(mean, on=["date", "symbol"])
    assert np.allclose(merged.prediction_x, merged.prediction_y)
    alone = boosting.fit_all(fold.coalesce(1), cols, SPECS[:1], edges=edges)[0]
    assert [t.feature for t in alone.trees] == [t.feature for t in fitted[0].trees]


def test_many_leaves_beat_shallow_trees(spark):
    """A target of many steps in one corner: 31 best leaves go there, four levels can't."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"date": dt.date(2020, 1, 2), "symbol": range(4000), "f0": rng.uniform(size=4000), "f1": rng.uniform(size=4000)})
    pdf["target"] = np.where(pdf.f0 > 0.8, np.floor(pdf.f1 * 25) % 2, 0.0)
    pdf["is_val"] = pdf.symbol % 4 == 0
    fold = spark.createDataFrame(pdf)
    spec = Spec(rounds=1, leaves=31, rate=1.0, rows=1.0, columns=1.0, min_rows=5, patience=1)
    fitted = boosting.fit_all(fold, ["f0", "f1"], [spec])[0]
    shallow = walkforward.gbt(maxIter=1, maxDepth=4, stepSize=1.0).fit(
        walkforward._vector(["f0", "f1"]).transform(fold.filter("not is_val")))
    loss = lambda scored: scored.selectExpr("avg(pow(target - prediction, 2))").first()[0]
    deep = loss(boosting.score(fold.filter("is_val"), [fitted], ["target"]))
    assert deep < 0.5 * loss(shallow.transform(walkforward._vector(["f0", "f1"]).transform(fold.filter("is_val"))))
    assert abs(fitted.importances()["f0"] + fitted.importances()["f1"] - 1) < 1e-9


def test_bag_keeps_the_best_by_rank_ic(spark, monkeypatch):
    pdf, cols = panel(weeks=10, names=40), ["f0", "f1", "f2"]
    fold = spark.createDataFrame(pdf)
    passes = []
    count = boosting._pass
    monkeypatch.setattr(boosting, "_pass", lambda *a: passes.append(1) or count(*a))
    base = {"rounds": 1, "patience": 1}
    space = {"leaves": (3, 7), "rate": (0.1, 0.5), "min_rows": (3, 9), "l2": (0.0, 2.0)}
    bag = walkforward.leafwise_bag(cols, space, 12, 4, base=base)(fold)
    assert len(bag) == 4 and len(passes) <= 8  # as many passes as the deepest candidate needs
    val = pdf[pdf.is_val]

    def ic(b):
        scored = val.assign(p=b.predict(val[cols].to_numpy()))
        return np.mean([g.p.rank().corr(g.target.rank()) for _, g in scored.groupby("date")])

    ranks = [ic(b) for b in bag]
    assert ranks == sorted(ranks, reverse=True)
    every = walkforward.leafwise_bag(cols, space, 12, 12, base=base)(fold)
    assert np.allclose(sorted((ic(b) for b in every), reverse=True)[:4], ranks)
    shares = walkforward.feature_importance(bag, cols)
    assert abs(sum(shares.values()) - 1) < 1e-9
    assert shares["f0"] == pytest.approx(np.mean([b.importances()["f0"] for b in bag]))


def test_folds_without_validation_rows_or_splits(spark):
    pdf = panel(weeks=3, names=20)
    pdf["is_val"] = False
    fold = spark.createDataFrame(pdf)
    fitted = boosting.fit_all(fold, ["f0", "f1"], [Spec(rounds=2, leaves=4, min_rows=3, rows=1.0)])[0]
    assert len(fitted.trees) == 2 and fitted.losses == []
    pdf["target"], pdf["f0"] = 1.0, np.nan  # nothing to split on
    flat = boosting.fit_all(spark.createDataFrame(pdf), ["f0"], [Spec(rounds=1, leaves=4)])[0]
    assert flat.predict(np.zeros((2, 1))).tolist() == [1.0, 1.0] and flat.importances() == {"f0": 0.0}
    nothing = boosting.fit_all(spark.createDataFrame(pdf).limit(0), ["f0"], [Spec(rounds=1, leaves=4)])[0]
    assert nothing.predict(np.zeros((1, 1))).tolist() == [0.0]
