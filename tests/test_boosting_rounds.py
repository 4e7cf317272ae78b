"""How many rounds are fitted to find the best one."""

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import walkforward as wf


class Rounds:
    """Stands in for a learner and its model: the loss falls up to round ``best``."""

    def __init__(self, best, fitted, most):
        self.best, self.fitted, self.most = best, fitted, most

    def getMaxIter(self):
        return self.most

    def fit(self, rows):
        self.fitted.append(self.most)
        return self

    def evaluateEachIteration(self, rows, loss):
        return [abs(self.best - i) for i in range(self.most)]


@pytest.mark.parametrize("most, best, fits", [(24, 23, [24]), (24, 9, [24, 10]), (400, 30, [8, 16, 32, 64, 31])])
def test_few_rounds_are_fitted_once(spark, monkeypatch, most, best, fits):
    fitted = []
    monkeypatch.setattr(wf, "gbt", lambda label, **params: Rounds(best, fitted, params["maxIter"]))
    fold = spark.range(4).select((F.col("id") % 2 == 0).alias("is_val"))
    model = wf.boosted(fold, patience=4, maxIter=most)
    assert fitted == fits and model.getMaxIter() == best + 1
