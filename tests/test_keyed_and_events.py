"""Keyed tables, as-of joins of event streams, checked quantiles, streams with late rows."""

import datetime as dt
import random

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from crosspanel.functions import ts, xs
from crosspanel.operators import joins
from crosspanel.sources.keyed import KeyedTable
from crosspanel.streaming import events as streams


def _table(spark, path, n=60):
    rows = [(k if k else None, f"v{k}", k) for k in range(n)]
    return KeyedTable.create(spark.createDataFrame(rows, "k int, v string, at int"), path, ["k"], "at", buckets=8)


def _rows(df):
    return {r.k: (r.v, r["at"]) for r in df.collect()}


def test_change_of_one_key_rewrites_one_bucket(spark, tmp_path):
    table = _table(spark, str(tmp_path / "t"))
    before = table.manifest()["folders"]
    change = spark.createDataFrame([(5, "new", 99), (5, "older", 98), (5, "stale", 1)], "k int, v string, at int")
    assert table.upsert(change) == 2
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert _rows(table.read())[5] == ("new", 99)
    assert _rows(table.read(1))[5] == ("v5", 5)
    assert len(_rows(table.read())) == 60
    assert _rows(table.read_for(spark.createDataFrame([(5,), (None,), (1000,)], "k int"))) == {
        5: ("new", 99), None: ("v0", 0)}


def test_gap_fill_delete_null_keys_and_empty_changes(spark, tmp_path):
    table = _table(spark, str(tmp_path / "t"), 5)
    schema = "k int, v string, at int"
    table.insert_missing(spark.createDataFrame([(3, "no", 99), (7, "yes", 1), (None, "no", 9)], schema))
    got = _rows(table.read())
    assert got[3] == ("v3", 3) and got[7] == ("yes", 1) and got[None] == ("v0", 0)
    table.upsert(spark.createDataFrame([(None, "null", 50)], schema))
    assert _rows(table.read())[None] == ("null", 50)
    version = table.delete(spark.createDataFrame([(None,), (3,), (77,)], "k int"))
    assert set(_rows(table.read())) == {1, 2, 4, 7}
    assert table.upsert(spark.createDataFrame([], schema)) == version
    for k in (1, 2, 4, 7):
        table.delete(spark.createDataFrame([(k,)], "k int"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(9, "again", 1)], schema))
    assert _rows(table.read()) == {9: ("again", 1)}
    assert table.vacuum() > 0 and len(table.versions()) == 1
    assert _rows(table.read()) == {9: ("again", 1)}


def test_failed_and_second_writers_leave_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    table = _table(spark, path)
    broken = spark.createDataFrame([(1, "x", 99)], "k int, v string, at int").withColumn(
        "v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        table.upsert(broken)
    assert table.versions() == [1] and _rows(table.read())[1] == ("v1", 1)
    # Two writers start from one version: the later commit fails and changes nothing.
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(1, "first", 99)], "k int, v string, at int"))
    with pytest.raises(Py4JJavaError):
        table._commit(stale | {"version": 2})
    assert _rows(table.read())[1] == ("first", 99)
    with pytest.raises(ValueError):
        _table(spark, path)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_events(spark, forward, strict):
    rnd = random.Random(7)
    t0 = dt.datetime(1969, 12, 31, 12)
    when = lambda: t0 + dt.timedelta(minutes=rnd.randrange(2000))
    key = lambda: rnd.choice(["hot"] * 6 + ["b", "c", None])
    left = [(i, key(), when() if rnd.random() > .05 else None) for i in range(400)]
    right = [(key(), when() if rnd.random() > .05 else None, i, rnd.choice([None, 1.5, 2.5])) for i in range(300)]
    left += [(1000 + i, "hot", t0 + dt.timedelta(minutes=700)) for i in range(50)]
    left += [(2000, "unknown", t0)]
    a = spark.createDataFrame(left, "id int, k string, ts timestamp")
    b = spark.createDataFrame(right, "k string, ts timestamp, o int, x double")
    got = joins.asof_events(a, b, "k", ["x", "o"], "o", forward=forward, strict=strict, within="3 hours", parts=7)
    got = {r.id: (r.o, r.x) for r in got.collect()}
    assert len(got) == len(left)
    sign = -1 if forward else 1
    for i, k, at in left:
        best = None
        for rk, rt, o, x in right:
            if at is None or rt is None or k is None or rk != k:
                continue
            gap = (at - rt).total_seconds() * sign
            if gap < 0 or (strict and gap == 0):
                continue
            if best is None or (gap, -o) < best[0]:
                best = ((gap, -o), o, x)
        want = best[1:] if best and best[0][0] <= 3 * 3600 else (None, None)
        assert got[i] == want, (i, k, at)


def test_asof_events_empty_and_clashing(spark):
    a = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1))], "id int, k string, ts timestamp")
    none = spark.createDataFrame([], "k string, ts timestamp, o int, x double")
    assert joins.asof_events(a, none, "k", ["x"], "o").collect()[0].x is None
    assert joins.asof_events(a.limit(0), none, "k", ["x"], "o").count() == 0
    with pytest.raises(ValueError):
        joins.asof_events(a.withColumn("x", F.lit(1)), none, "k", ["x"], "o")


def test_a_hot_key_is_spread(spark):
    a = spark.range(4000).select("id", F.lit("hot").alias("k"), F.timestamp_seconds("id").alias("ts"))
    b = spark.range(1).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.lit(0)).alias("ts"),
                              F.lit(1).alias("o"), F.lit(2.0).alias("x"))
    # One match at the very start is carried through all ranges.
    got = joins.asof_events(a, b, "k", ["x"], "o", parts=8)
    assert got.filter("x = 2.0").count() == 4000


def test_quantiles_are_exact_with_a_poor_sketch(spark, monkeypatch):
    monkeypatch.setattr(xs, "SKETCH_ACCURACY", 2)
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=9000), "b": rng.integers(0, 5, 5000).astype(float)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("c", None)] * 3 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.02, 0.5, 0.77, 1.0]
    got = {r.g: r for r in xs._bracketed_quantiles(df, ["g"], ["x"], probs).collect()}
    for g, v in values.items():
        np.testing.assert_allclose([got[g][f"x_q{i}"] for i in range(5)], np.quantile(v, probs), atol=1e-12)
    assert got[None].x_q2 == 1.0
    assert "c" not in got or got["c"].x_q2 is None


def _run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None


def test_weekly_balance_runs_as_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, h=9: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, symbol string, action string"
    rows = [(day(1), "A", "upgrade"), (day(3), "A", "downgrade"), (day(3, 10), "A", "upgrade"), (day(30), "A", "maintain")]
    spark.createDataFrame(rows, schema).write.parquet(src)
    _run(streams.weekly_balance(spark.readStream.schema(schema).parquet(src)), out, str(tmp_path / "cp"))
    got = {r.date: r.UPDOWN1W_RATINGS for r in spark.read.parquet(out).collect()}
    assert got[dt.date(2024, 1, 1)] == 1.0 and got[dt.date(2024, 1, 3)] == pytest.approx(1 / 3)
    batch = streams.weekly_balance(spark.read.schema(schema).parquet(src))
    want = {r.date: r.UPDOWN1W_RATINGS for r in batch.filter("date < '2024-01-28'").collect()}
    assert {d: v for d, v in got.items() if d < dt.date(2024, 1, 28)} == want


def test_late_closes_resolve_a_pick_once(spark, tmp_path):
    bars_in, picks_in, out, cp = (str(tmp_path / d) for d in ("bars", "picks", "out", "cp"))
    bar_schema = "symbol string, ts timestamp, close double"
    pick_schema = "symbol string, target_ts timestamp, entry_close double, side string"
    day = lambda d, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d - 1)
    put = lambda rows, schema, to: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(to)
    stream = lambda: streams.pick_outcomes(
        spark.readStream.schema(pick_schema).parquet(picks_in), spark.readStream.schema(bar_schema).parquet(bars_in))
    picks = [("A", day(4), 10.0, "LONG"), ("B", day(4), 10.0, "SHORT"), ("C", day(4), 10.0, "LONG"),
             ("A", day(11), 12.0, "LONG")]
    put(picks, pick_schema, picks_in)
    first = [("A", day(2, 16), 11.0), ("B", day(3, 16), 9.0), ("A", day(5, 16), 50.0)]
    put(first, bar_schema, bars_in)
    _run(stream(), out, cp)
    # A close of the first week that comes late, after a bar of the second.
    late = [("A", day(4, 16), 12.0), ("B", day(2, 16), 1.0), ("A", day(10, 16), 15.0)]
    put(late, bar_schema, bars_in)
    _run(stream(), out, cp)
    put([("Z", day(40, 16), 1.0)], bar_schema, bars_in)
    put([("Z", day(46), 1.0, "LONG")], pick_schema, picks_in)
    _run(stream(), out, cp)
    put([("A", day(4, 17), 99.0)], bar_schema, bars_in)  # too late: the week has been given out
    _run(stream(), out, cp)
    got = [(r.symbol, r.target_ts, r.exit_close) for r in spark.read.schema(
        pick_schema + ", exit_close double, signed_ret double").parquet(out).collect()]
    weekly = ts.weekly_last(spark.createDataFrame(first + late, bar_schema).withColumn(
        "date", F.to_date("ts")).select("symbol", "date", "close"), ["close"])
    closes = {(r.symbol, r.date): r.close for r in weekly.collect()}
    want = [(s, t, closes.get((s, t.date()))) for s, t, _, _ in picks]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [w[2] for w in want] == [12.0, 9.0, None, 15.0]
