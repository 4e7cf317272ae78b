"""The last report's figures do not depend on the order of its rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crosspanel.functions import xs
from crosspanel.plans.research import valuation
from crosspanel.sources.tables import Tables


def test_sums_are_rounded_once(spark):
    rng = random.Random(5)
    groups = {k: [round(rng.uniform(900, 99000), 2) * (rng.randrange(11) / 100) for _ in range(40)] for k in range(50)}
    groups |= {50: [math.inf, 1.0], 51: [1e300, -1.0], 52: [None, 2.5], 53: [None], 54: [math.nan, 1.0]}
    rows = [(k, x) for k, xs_ in groups.items() for x in xs_]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, x double").repartition(7)
    got = {r.k: r.s for r in df.groupBy("k").agg(xs.exact_sum(F.col("x")).alias("s")).collect()}
    for k in range(50):
        assert got[k] == math.fsum(groups[k])
    assert got[50] == math.inf and got[51] == 1e300 and got[52] == 2.5 and got[53] is None and math.isnan(got[54])


@pytest.mark.parametrize("seed", range(3))
def test_valuation_whatever_the_order(spark, tmp_path, seed):
    """Net income is near 0, so the last bit of a plain sum would move the digits compared."""
    rng = random.Random(11)
    items = []
    for s in range(40):
        part = [round(rng.uniform(900, 99000), 2) for _ in range(30)]
        items += [(s, p, d, 0.02) for i, p in enumerate(part) for d in (0.05, 0.07) if p]
    want = {}
    for s in range(40):
        mine = [i for i in items if i[0] == s]
        ext = math.fsum(p for _, p, _, _ in mine)
        ni = 0.06 * ext - math.fsum(p * d for _, p, d, _ in mine)
        want[s] = (math.fsum(p * (1 - d) for _, p, d, _ in mine) + 10.0) / ni if ni else None
    random.Random(seed).shuffle(items)
    at = F.lit("2001-05-04").cast("timestamp")
    df = spark.createDataFrame([(s, p, d, x, 1.0) for s, p, d, x in items],
                               "l_suppkey long, l_extendedprice double, l_discount double, l_tax double, l_quantity double")
    df.withColumn("l_shipdate", at).repartition(1 + seed).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, 10.0) for s in range(40)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.symbol: r.pe_ttm for r in valuation(Tables(spark, str(tmp_path))).collect()}
    assert got == want
