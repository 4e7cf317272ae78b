"""The registered bag is the whole one, and both ways to fit it give the same trees."""

import numpy as np
import pytest

from crosspanel.operators import boosting, walkforward
from crosspanel.operators.boosting import Spec
from crosspanel.plans import modelling

from test_boosting import SPECS, panel


class Bag(Exception):
    pass


def test_registered_bag_leaves_nothing_out(monkeypatch):
    def fitted(fold, cols, specs, *args, **kwargs):
        raise Bag(specs)

    monkeypatch.setattr(modelling, "trained", lambda t, members: [members["bag"](None)])
    monkeypatch.setattr(boosting, "fit_all", fitted)
    monkeypatch.setattr(boosting, "fit_bag", fitted, raising=False)
    with pytest.raises(Bag) as found:
        modelling.parameter_bag(type("T", (), {"n_symbols": 5}))
    specs = found.value.args[0]
    assert len(specs) == 200 and {(s.rounds, s.patience) for s in specs} == {(2000, 50)}
    assert min(s.leaves for s in specs) < 20 and max(s.leaves for s in specs) > 55


def test_tasks_and_shared_passes_agree(spark, monkeypatch):
    pdf, cols = panel(), ["f0", "f1", "f2"]
    # Quarters add up exactly, so neither way depends on the order of its sums in the first round.
    pdf["target"] = (pdf.target * 4).round() / 4
    fold = spark.createDataFrame(pdf).repartition(3)
    specs = [*SPECS, Spec(rounds=6, leaves=9, rate=0.8, min_rows=4, patience=2, seed=4), Spec(rounds=2, leaves=1, seed=5)]
    here = boosting.fit_bag(fold, cols, specs)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "AT_ONCE", 2)
    shared = boosting.fit_bag(fold, cols, specs)
    values = pdf[cols].to_numpy()
    for a, b in zip(here, shared, strict=True):
        assert np.allclose(a.losses, b.losses) and len(a.trees) == len(b.trees)
        assert np.allclose(a.predict(values), b.predict(values))
    alone = boosting._fit_in_tasks(fold.coalesce(1), cols, specs[:1], "target", ["date", "symbol"], here[0].edges)[0]
    assert alone.trees[0].feature == shared[0].trees[0].feature or np.allclose(alone.predict(values), here[0].predict(values))


def test_no_rows_and_no_validation(spark):
    pdf = panel(weeks=3, names=20)
    pdf["is_val"] = False
    fold = spark.createDataFrame(pdf)
    kept = boosting.fit_bag(fold, ["f0"], [Spec(rounds=2, leaves=4, min_rows=3)])[0]
    assert len(kept.trees) == 2 and kept.losses == []
    nothing = boosting.fit_bag(fold.limit(0), ["f0"], [Spec(rounds=1, leaves=4)])[0]
    assert nothing.predict(np.zeros((1, 1))).tolist() == [0.0]
    assert walkforward.feature_importance([nothing], ["f0"]) == {"f0": 0.0}
