"""Hand fixtures of the time grid."""

import pytest
from pyspark.sql import functions as F

from gridcast import SeriesSpec
from gridcast.functions.scalars import mask_zero, to_number
from gridcast.operators import align, grid
from tests.data import STEP, at, series, values

N = None
GAPPY = [N, 1, N, N, N, N, 6, N, 8] + [N] * 11
RAW = SeriesSpec(("k",), "ts", step_s=10, chunk_rows=4)


@pytest.mark.parametrize("chunk", [1, 3, 4, 7, 100])
def test_interpolate_three_into_gaps(spark, chunk):
    out = grid.interpolate(series(spark, GAPPY), STEP.replace(chunk_rows=chunk), ["v"], 3)
    assert values(out, "v") == [N, 1, 2, 3, 4, N, 6, 7, 8, 8, 8, 8] + [N] * 8


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_ffill_one(spark, chunk):
    out = grid.ffill(series(spark, GAPPY), STEP.replace(chunk_rows=chunk), ["v"], 1)
    assert values(out, "v") == [N, 1, 1, N, N, N, 6, 6, 8, 8] + [N] * 10


def test_interpolation_is_linear_in_time(spark):
    rows = [("a", at(0), 0.0), ("a", at(10), None), ("a", at(40), 4.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = grid.interpolate(df, SeriesSpec(("k",), "ts", step_s=10), ["v"], 3)
    assert values(out, "v") == [0.0, 1.0, 4.0]


def test_resample_keeps_empty_bins(spark):
    rows = [("a", at(7), 1.0), ("a", at(9), 2.0), ("a", at(41), 3.0), ("b", at(25), 5.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = grid.resample_mean(df, RAW, ["v"])
    assert values(out, "v") == [1.5, N, N, N, 3.0, 5.0]
    assert [r.ts for r in out.where("k = 'b'").collect()] == [at(20)]


def test_resample_needs_an_origin_for_odd_steps(spark):
    with pytest.raises(ValueError):
        grid.resample_mean(series(spark, [1, 2]), RAW.replace(step_s=7), ["v"])


def test_clean_fills_then_interpolates(spark):
    df = series(spark, [1, N, N, N, 5])
    out = grid.resample_and_clean(df, RAW, ["v"], max_ffill_steps=1, max_interp_seconds=10)
    # one carried forward, one interpolated from there, one row left empty
    assert values(out, "v") == [1.0, 1.0, pytest.approx(1 + 4 / 3), 5.0]


def test_interpolation_variants(spark):
    df = series(spark, [1, N, 3])
    strict = grid.resample_with_interpolation(df, RAW, ["v"], strict=True)
    assert values(strict, "v") == [1.0, 3.0]
    assert values(grid.resample_with_interpolation(df, RAW, ["v"]), "v") == [1.0, 2.0, 3.0]


def test_cadence_report(spark):
    rows = [("a", at(s), 1.0) for s in (0, 10, 20, 35, 45, 60, 100)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    out = grid.cadence_report(df, RAW.replace(bucket_s=20)).collect()
    assert [(r.interval_s, r.n, r.n_off) for r in out] == [(15.0, 2, 3), (40.0, 1, 3)]


def test_midpoint_and_first_rows(spark):
    df = series(spark, range(7)).unionByName(series(spark, range(10, 14), "b"))
    spec = SeriesSpec(("k",), "ts", bucket_s=20)
    assert values(grid.row_at_position(df, spec, 0.5), "v") == [3.0, 12.0]
    assert values(grid.first_rows(df, spec, 2), "v") == [0.0, 1.0, 10.0, 11.0]
    assert values(grid.first_rows(df, spec.replace(keys=()), 1), "v") in ([0.0], [10.0])


def test_zero_mask_and_numbers(spark):
    df = spark.createDataFrame([("0.0",), ("1",), ("-0.0",), ("x",), ("1.5f",), (" 2e1 ",), ("NaN",), (None,)], "s string")
    num = to_number(F.col("s"))
    assert [r[0] for r in df.select(num).collect()] == [0.0, 1.0, -0.0, N, N, 20.0, N, N]
    assert [r[0] for r in df.select(mask_zero(num)).collect()] == [N, 1.0, N, N, N, 20.0, N, N]


def test_timestamp_column_is_found(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:10", 1.0), ("bad", 2.0)], "Time string, v double")
    assert [r.ts for r in grid.as_timestamp(df).orderBy("v").collect()] == [at(10), N]
    other = df.withColumnRenamed("Time", "when")
    with pytest.raises(ValueError):
        grid.as_timestamp(other)
    assert grid.as_timestamp(other, try_first=True).columns == ["ts", "v"]


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_nearest_tie_goes_to_the_later_row(spark, bucket):
    df = series(spark, [100, 110, 120], step=10)
    asked = [("a", i, at(s)) for i, s in enumerate((5, 4, 10, -50, 99))]
    req = spark.createDataFrame(asked, "k string, req int, ts timestamp")
    out = align.nearest_in_time(req, df, ["v"], bucket, ["k"]).orderBy("req").collect()
    assert [r.v for r in out] == [110.0, 100.0, 110.0, 100.0, 120.0]


def test_nearest_without_series_rows(spark):
    req = spark.createDataFrame([("z", 1, at(0))], "k string, req int, ts timestamp")
    out = align.nearest_in_time(req, series(spark, [1]), ["v"], 10, ["k"]).collect()
    assert [(r.req, r.v) for r in out] == [(1, None)]


def test_many_answers_are_not_broadcast(spark, monkeypatch):
    """Stored answers compress well, so the planner took them and their copies for small."""
    df = series(spark, range(50))
    asked = spark.range(3000).select(
        F.when(F.col("id") % 7 > 0, "a").alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.greatest(F.col("id") % 600 - 100, F.lit(0))).alias("ts"), F.col("id").alias("req"))
    req = asked.unionByName(spark.createDataFrame([("a", None, -1)] * 40, "k string, ts timestamp, req long"))
    want = align.nearest_in_time(req, df, ["v"], 60, ["k"])
    monkeypatch.setattr(align, "few_facts", lambda *_: False)
    us = df.withColumn("us", F.unix_micros("ts"))
    got = align.nearest(req.withColumn("us", F.unix_micros("ts")), us, "us", ["v"], 60_000_000, ["k"], "m", max_bucket_rows=50)
    p = got._jdf.queryExecution().executedPlan().toString()
    assert p.count("SortMergeJoin") == 1 and "Generate explode" in p  # the crowded names alone are broadcast
    rows = lambda x, m: sorted((r.req, r.v is None, r.v or 0, r[m] is None) for r in x.collect())
    assert rows(got, "m") == rows(want, "matched_ts")


def test_many_requests_for_one_time_are_looked_up_once(spark):
    df = series(spark, [1, 2, 3])
    asked = spark.range(5000).select(F.lit("a").alias("k"), F.lit(at(12)).cast("timestamp").alias("ts"), F.col("id").alias("req"))
    more = spark.createDataFrame([("a", None, -1), (None, at(12), -2)], "k string, ts timestamp, req long")
    got = align.nearest_in_time(asked.unionByName(more), df, ["v"], 10, ["k"])
    rows = got.groupBy("v", "matched_ts").count().collect()
    assert sorted((r.v or 0, r["count"]) for r in rows) == [(0, 2), (df.where(f"ts = '{rows[0].matched_ts or rows[1].matched_ts}'").first().v, 5000)]
    # the window sees one row for them
    found = align._nearest_values(asked.select("k", F.unix_micros("ts").alias("x")).distinct(), df.withColumn("x", F.unix_micros("ts")), "x", ["v"], 1000, ["k"], 10)
    assert found.count() == 1
