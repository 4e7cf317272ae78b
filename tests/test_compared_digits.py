"""Digits compared with SQL, also where a double is beyond a bigint."""

import math

from pyspark.sql import functions as F

from crosspanel.plans.registry import _spark_column


def test_compared_digits_beyond_a_bigint(spark):
    values = [math.inf, -math.inf, 1e300, 1e13, 2.0000005, -2.0000005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(_spark_column("x", "6")).collect()]
    assert got == [math.inf, -math.inf, 1e300, 1e13, 2.000001, -2.0]
    assert math.isnan(spark.range(1).select(F.lit(math.nan).alias("x")).select(_spark_column("x", "6")).first()[0])
