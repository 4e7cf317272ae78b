"""Parameter draws, walk-forward fits and permutation importance on a small panel."""

import datetime as dt
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from crosspanel.operators import walkforward as wf


def test_draws_stay_in_range():
    rng = Random(0)
    space = {"stepSize": (0.01, 0.3), "maxDepth": (2, 5), "subsamplingRate": (0.5, 1.0)}
    for _ in range(200):
        p = wf.draw_params(space, rng, ["stepSize"], ["maxDepth"])
        assert all(lo <= p[k] <= hi for k, (lo, hi) in space.items())
        assert isinstance(p["maxDepth"], int)


def test_walk_forward_learns_the_signal(spark):
    rng = np.random.default_rng(5)
    weeks = [dt.date(2020, 1, 2) + dt.timedelta(7 * w) for w in range(14)]
    pdf = pd.DataFrame([(d, s, *rng.normal(size=2)) for d in weeks for s in range(200)], columns=["date", "symbol", "f0", "f1"])
    pdf["target"] = 1.5 * pdf.f0 + rng.normal(size=len(pdf)) * 0.1
    df = spark.createDataFrame(pdf)
    plan = wf.schedule(df, 8, 2, 2)
    assert [r.retrain_id for r in plan.orderBy("retrain_id").collect()] == [0, 1]
    fit = lambda fold: wf.boosted(fold, maxIter=12, patience=3, maxDepth=3, stepSize=0.1)
    features, target = df.select("date", "symbol", "f0", "f1"), df.select("date", "symbol", "target")
    bag = wf.bagged_gbt({"stepSize": (0.1, 0.3)}, 2, 1, base={"maxIter": 4, "patience": 2, "maxDepth": 3}, max_group=40)
    preds, ics, imps = wf.walk_forward(features, target, ["f0", "f1"], plan, {"gbt": fit, "bag": bag}, 200)
    assert preds.groupBy("model").count().toPandas().set_index("model")["count"].to_dict() == {"gbt": 800, "bag": 800}
    assert all(r.val_ic > 0.8 for r in ics.collect())
    best = imps.groupBy("feature").agg(F.avg("importance").alias("v")).orderBy(F.desc("v")).first()
    assert best.feature == "f0"
    fold = df.withColumn("is_val", F.col("date") >= F.lit("2020-03-15").cast("date"))
    model = fit(wf._vector(["f0", "f1"]).transform(fold))
    assert model.getNumTrees >= 8  # a signal keeps many trees
    drops = [dict(wf.permutation_importance(model, fold, ["f0", "f1"], max_group=n)) for n in (200, None)]
    assert drops[0] == drops[1]  # the permutation does not depend on the bound
    assert drops[0]["f0"] > 0.3 > abs(drops[0]["f1"])


def test_patience_passes_flat_rounds_and_ends_the_run():
    falling = [5.0, 4.0, 4.0, 4.1, 3.0, 2.0]
    assert wf.best_round(falling, 3) == (5, False)
    assert wf.best_round(falling, 2) == (1, True)
    assert wf.best_round([1.0, 2.0, 2.0, 0.5], 2) == (0, True)


def test_run_parts_see_every_parameter():
    one = wf.run_parts(["f"], {"gbt": {"stepSize": 0.1}}, 1, 2, 3, "rolling", None, "thu")
    for change in ({"member_params": {"gbt": {"stepSize": 0.2}}}, {"max_train": 9}, {"signal_day": "fri"}):
        given = {"features": ["f"], "member_params": {"gbt": {"stepSize": 0.1}}, "train": 1, "val": 2, "retrain": 3,
                 "window": "rolling", "max_train": None, "signal_day": "thu"} | change
        assert wf.run_parts(**given) != one
