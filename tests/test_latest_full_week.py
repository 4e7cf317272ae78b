"""The latest full week is found whether it is among the newest weeks or not."""

import datetime as dt
from types import SimpleNamespace

import pytest

from crosspanel.functions import ts
from crosspanel.plans.profiling import latest_full_week


@pytest.mark.parametrize("full, built", [({19, 12, 3}, [1]), ({14, 3}, [1, 2, 4]), (set(), [1, 2, 4, 8, 5])])
def test_newest_weeks_first(spark, full, built):
    weeks = [dt.date(2020, 1, 2) + dt.timedelta(7 * i) for i in range(20)]
    rows = spark.createDataFrame(
        [(w, s, 1.0 if i in full or s else None) for i, w in enumerate(weeks) for s in range(3)],
        "date date, symbol long, x double")
    cal = ts.calendar(rows)
    sizes = []

    def build(listed):
        sizes.append(listed.count())
        return rows.join(listed, "date", "left_semi")

    t = SimpleNamespace(spark=spark, calendar=cal, store_bars=lambda: None)
    got = latest_full_week(t, build, ["x", "x"], 2, at_once=1).collect()
    assert {r.date for r in got} == ({weeks[max(full)]} if full else set())
    assert len(got) == (3 if full else 0) and sizes == built
