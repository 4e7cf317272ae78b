"""Closes meet the picks of their own symbol and day only, not all picks of the symbol."""

import re

from crosspanel.streaming.events import pick_outcomes


def test_the_target_day_is_a_join_key(spark):
    picks = spark.createDataFrame([], "symbol long, target_ts timestamp, entry_close double, side string")
    bars = spark.createDataFrame([], "symbol long, ts timestamp, close double")
    plan = pick_outcomes(picks, bars)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"to_date\(week_end#\d+.*?\) = to_date\(target_ts#\d+", plan)
