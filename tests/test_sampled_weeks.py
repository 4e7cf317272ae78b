"""Days outside the listed weekly bins are left out after the windows."""

import datetime as dt

from crosspanel.functions import ts
from crosspanel.operators import features


def test_weeks_only_keeps_whole_bins(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(d) for d in range(40)]
    daily = spark.createDataFrame([(d, 1) for d in days], "date date, symbol long")
    weeks = spark.createDataFrame([(dt.date(2020, 1, 9),), (dt.date(2020, 1, 30),)], "date date")
    got = sorted(r.date for r in features.weeks_only(daily, weeks, "THU").collect())
    assert got == [d for d in days if dt.date(2020, 1, 3) <= d <= dt.date(2020, 1, 9)
                   or dt.date(2020, 1, 24) <= d <= dt.date(2020, 1, 30)]
    assert features.weeks_only(daily, None, "THU") is daily
    labels = {r[0] for r in features.weeks_only(daily, weeks, "THU").select(ts.week_of("date")).collect()}
    assert labels == {dt.date(2020, 1, 9), dt.date(2020, 1, 30)}
