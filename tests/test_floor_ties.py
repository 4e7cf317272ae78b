"""An average dollar volume that equals its floor reaches it."""

import numpy as np
from pyspark.sql import functions as F

from crosspanel.operators import universe


def test_average_equal_to_its_floor_is_liquid(spark):
    rng, days, floor = np.random.default_rng(5), 45, 52_000.0
    rows = []
    for symbol in range(60):
        cents = rng.integers(90_000, 10_500_000, days)
        cents[-1] += int(floor * 100) * days - cents.sum()  # the mean is the floor
        volume = rng.integers(1, 51, days).astype(float)
        for t, (c, v) in enumerate(zip(cents.tolist(), volume.tolist())):
            rows.append((symbol, t, c / 100 / v, v))
    grid = spark.createDataFrame(rows, "symbol long, t long, close double, volume double")
    profile = spark.createDataFrame([(s, "US") for s in range(60)], "symbol long, region string")
    mask = universe.adv_mask(grid, profile, {"US": floor}, 60, 40)
    last = mask.filter(F.col("t") == days - 1)
    assert last.filter("liquid").count() == 60
    above = universe.adv_mask(grid, profile, {"US": floor + 1e-6}, 60, 40)
    assert above.filter((F.col("t") == days - 1) & F.col("liquid")).count() == 0
