"""Chunked work equals unchunked work, also with a hot key, and stays in bounds."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcast import SeriesSpec
from gridcast.operators import align, evaluate, features, grid, split
from gridcast.plans.chunks import BUCKET, CHUNK, POS, bucketed, join_facts, positions, prefix_sums, running_sum, with_halo, with_pos
from tests.data import at, series, skewed, values

GRID = SeriesSpec(("k",), "ts", step_s=10, gap_free=True, chunk_rows=16)


def as_rows(df):
    cols = sorted(df.columns)
    return sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols))
        for r in df.select([F.coalesce(F.col(c).cast("double"), F.lit(-9e9)).alias(c) if t == "double" else c for c, t in df.dtypes]).collect()
    )


@pytest.mark.parametrize("chunk", [1, 5, 16])
def test_features_do_not_depend_on_chunks(spark, chunk):
    df = skewed(spark)
    one = features.supervised(df, GRID.replace(chunk_rows=10_000), ["v"], ["u"], k=12, dropna=False)
    many = features.supervised(df, GRID.replace(chunk_rows=chunk), ["v"], ["u"], k=12, dropna=False)
    assert as_rows(one) == as_rows(many)


def test_features_equal_plain_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts")
    frame = w.rowsBetween(-5, 0)
    want = df.select("k", "ts", F.lag("v", 3).over(w).alias("v_lag3"),
                     F.when(F.count("v").over(frame) == 6, F.avg("v").over(frame)).alias("v_roll6_mean"))
    got = features.features_from_list(df, GRID, ["v_lag3", "v_roll6_mean"])
    assert as_rows(want) == as_rows(got)


def test_gappy_rows_count_positions(spark):
    # rows are missing, so lags go by row and not by time
    df = skewed(spark).where("v IS NOT NULL")
    spec = GRID.replace(gap_free=False)
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select("k", "ts", F.lag("v", 2).over(w).alias("v_lag2"))
    got = features.features_from_list(df, spec, ["v_lag2"])
    assert as_rows(want) == as_rows(got)


@pytest.mark.parametrize("limit", [1, 4])
def test_interpolation_does_not_depend_on_chunks(spark, limit):
    df = skewed(spark)
    one = grid.interpolate(df, GRID.replace(chunk_rows=10_000), ["v", "u"], limit)
    many = grid.interpolate(df, GRID.replace(chunk_rows=3), ["v", "u"], limit)
    assert as_rows(one) == as_rows(many)


def test_positions_and_split(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select("k", "ts", (F.row_number().over(w) - 1).cast("long").alias("p"), F.count("*").over(Window.partitionBy("k")).alias("n"))
    got = positions(df, SeriesSpec(("k",), "ts", bucket_s=70)).select("k", "ts", F.col(POS).alias("p"), F.col("__total").alias("n"))
    assert as_rows(want) == as_rows(got)
    spec = SeriesSpec(("k",), "ts", bucket_s=70)
    a = split.time_split(df, spec).select("k", "ts", "split")
    b = split.time_split_by_row(df, spec).select("k", "ts", "split")
    assert as_rows(a) == as_rows(b)
    assert split.time_split(df, spec).where("k = 'hot'").groupBy("split").count().orderBy("split").collect() == [
        ("test", 90), ("train", 420), ("val", 90)]


def crowd(spark):
    """Half of the rows of the hot key lie within one second."""
    df = skewed(spark)
    crowded = spark.range(1000).select(
        F.lit("hot").alias("k"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3 + 1).alias("ts"),
        F.col("id").cast("double").alias("v"), F.lit(0.0).alias("u"))
    return df.unionByName(crowded)


@pytest.mark.parametrize("bucket_s", [70, 100_000])
def test_crowded_buckets_are_cut_further(spark, bucket_s):
    df = crowd(spark)
    spec = SeriesSpec(("k",), "ts", bucket_s=bucket_s, max_bucket_rows=40)
    rows, counts = bucketed(df, spec)
    assert counts.agg(F.max("__n"), F.sum("__n")).first() == (counts.agg(F.max("__n")).first()[0], df.count())
    assert rows.groupBy("k", BUCKET).count().agg(F.max("count")).first()[0] <= 40
    w = Window.partitionBy("k").orderBy("ts")
    want = df.select("k", "ts", (F.row_number().over(w) - 1).cast("long").alias("p"))
    assert as_rows(want) == as_rows(positions(df, spec).select("k", "ts", F.col(POS).alias("p")))


def test_nearest_in_crowded_buckets(spark):
    df = crowd(spark).where("k = 'hot'").select("k", "ts", "v")
    asked = df.select("k", (F.col("ts") + F.expr("interval 1 microsecond")).alias("ts")).withColumn("req", F.unix_micros("ts"))
    one = align.nearest_in_time(asked, df, ["v"], 1e6, ["k"])
    us = [F.col("k"), F.unix_micros("ts").alias("on")]
    many = align.nearest(
        asked.select(*us, "req"), df.select(*us, "v"), "on", ["v"], 10_000_000, ["k"], "m", max_bucket_rows=30)
    assert as_rows(one.select("req", "v")) == as_rows(many.select("req", "v"))


def test_running_sum(spark):
    df = skewed(spark).withColumn("v", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy("k").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "ts", F.sum("v").over(w).alias("s"))
    got = running_sum(df, GRID, {"s": "v"}).select("k", "ts", "s")
    assert [round(x, 6) for x in values(want, "s")] == [round(x, 6) for x in values(got, "s")]


def test_no_group_outgrows_its_chunk(spark):
    laid = with_halo(with_pos(skewed(spark), GRID), GRID.chunk_rows, 12, 3)
    assert laid.groupBy("k", CHUNK).count().agg(F.max("count")).first()[0] <= GRID.chunk_rows + 15


def test_rows_of_others_and_of_the_future_do_not_matter(spark):
    df = series(spark, range(30))
    names = ["v_lag3", "v_roll3_mean"]
    alone = features.features_from_list(df, GRID, names)
    more = df.unionByName(series(spark, [9] * 40, "b")).unionByName(
        series(spark, range(60)).where(F.unix_seconds("ts") >= 1704067200 + 300))
    mixed = features.features_from_list(more, GRID, names)
    first = mixed.where((F.col("k") == "a") & (F.unix_seconds("ts") < 1704067200 + 300))
    assert as_rows(alone) == as_rows(first)


def test_downsample_is_even(spark):
    df = series(spark, range(10))
    spec = SeriesSpec(("k",), "ts", bucket_s=30)
    assert values(evaluate.downsample(df, spec, 4), "v") == [0.0, 3.0, 6.0, 9.0]
    assert len(values(evaluate.downsample(df, spec, 50), "v")) == 10


@pytest.mark.parametrize("n,m", [(1001, 500), (697, 500), (7, 3), (1000, 333)])
def test_downsample_equals_truncated_linspace(spark, n, m):
    import numpy as np

    got = values(evaluate.downsample(series(spark, range(n)), SeriesSpec(("k",), "ts", bucket_s=500), m), "v")
    assert got == sorted(set(np.linspace(0, n - 1, m, dtype=int).astype(float)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_share_one_sort_and_no_single_partition(spark):
    p = plan(features.supervised(skewed(spark), GRID, ["v", "u"], ["v"], k=12))
    final = p.split("== Initial Plan ==")[-1]
    assert final.count("Window") - final.count("RunningWindowFunction") >= 1
    assert final.count("Exchange hashpartitioning") == 1
    assert final.count("Sort [") == 1
    assert "SinglePartition" not in final


def test_resample_joins_nothing(spark):
    p = plan(grid.resample_mean(skewed(spark), GRID.replace(gap_free=False), ["v"]))
    assert "Join" not in p and "SinglePartition" not in p


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_facts_join_alike_broadcast_or_salted(spark, keys, how):
    df = skewed(spark)
    facts = df.groupBy(*keys).agg(F.avg("v").alias("m"))
    if keys:
        facts = facts.where("k <> 'k3'")
    small = join_facts(df, facts, keys, ["ts"], how)
    large = join_facts(df, facts, keys, ["ts"], how, max_cells=0)
    assert "BroadcastHashJoin" in plan(small) and "CartesianProduct" not in plan(large)
    assert "NestedLoop" not in plan(small)
    assert as_rows(small) == as_rows(large)


def test_many_facts_are_not_broadcast_for_their_small_file(spark):
    facts = spark.range(3000).select(F.col("id").alias("k"), *[F.lit(0.5).alias(f"c{i}") for i in range(40)])
    df = spark.range(6000).select((F.col("id") % 3000).alias("k"), "id")
    got = join_facts(df, facts, ["k"], ["id"], max_cells=1000)
    assert "BroadcastHashJoin" not in plan(got) and got.count() == 6000


def test_the_filter_and_the_columns_reach_the_scan(spark):
    from registry import views

    df = grid.resample_mean(
        views.events(spark, "/root/testdata/sf0.001").where("ts >= timestamp'2024-01-10 00:00:00'"), views.EVENTS, ["value"]
    )
    p = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in p.splitlines() if "FileScan" in line]
    assert scans and all("props" not in x and "event_type" not in x for x in scans)


@pytest.mark.parametrize("span", [1, 3, 1000])
@pytest.mark.parametrize("keys", [(), ("k",)])
def test_prefix_sums(spark, keys, span):
    rng = np.random.default_rng(6)
    rows = [(k, int(i), int(rng.integers(0, 9)) if rng.random() < 0.9 else None) for k in "ab" for i in rng.choice(np.arange(-40, 60), 30, replace=False)]
    if not keys:
        rows = [("x", i, x) for _, i, x in {i: (k, i, x) for k, i, x in rows}.values()]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(4)
    got = prefix_sums(df, list(keys), "i", span, {"before": "x"}, {"all": "x"}).collect()
    for r in got:
        same = [(i, x or 0) for k, i, x in rows if not keys or k == r.k]
        assert (r.before, r["all"]) == (sum(x for i, x in same if i < r.i), sum(x for _, x in same))
    assert len(got) == len(rows)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("given", [None, (-9, 40), (2, 21), (30, 33)])
def test_resample_fills_every_bin_of_the_span_and_aggregates_none_of_them(spark, keys, given):
    rows = [("a", -7, 1.0), ("a", -7, 3.0), ("a", 0, 5.0), ("a", 3, None), ("a", 4, 2.0), ("a", 26, 7.0), (None, 5, 8.0), (None, 12, 9.0), ("b", 1, 4.0)]
    df = spark.createDataFrame([(k, at(i * 10), x) for k, i, x in rows] + [("a", None, 1.0)], "k string, ts timestamp, v double").repartition(3)
    spec = SeriesSpec(tuple(keys), "ts", step_s=10, chunk_rows=4, origin_us=1704067200 * 10**6)
    names = sorted({k for k, _, _ in rows if keys}, key=str) or [None]
    span = given and spark.createDataFrame([(k, *given) for k in names], "k string, lo long, hi long").select(*keys, "lo", "hi")
    got = grid.resample_mean(df, spec, ["v"], span)
    want = {}
    for name in names:
        own = [(i, x) for k, i, x in rows if not keys or k == name]
        lo, hi = given or (min(i for i, _ in own), max(i for i, _ in own))
        for i in {*range(lo, hi + 1), *(i for i, _ in own)}:
            seen = [x for j, x in own if j == i and x is not None]
            want[name, at(i * 10)] = sum(seen) / len(seen) if seen else None
    found = [((r.k if keys else None, r.ts), r.v) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want
    # the plan is written from the result down: bins are added above the aggregation
    p = plan(got).split("== Initial Plan ==")[-1]
    assert "Generate explode(sequence(__pos" in p[: p.index("Aggregate")] and "REPARTITION_BY_NUM" in p


@pytest.mark.parametrize("keys", [["k"], []])
def test_readings_are_spread_before_any_bin_is_held(spark, keys):
    # one partition with many sparse bins, and one bin with many readings (some at one time)
    sparse = spark.range(300).select(F.concat(F.lit("s"), F.col("id") % 30).alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") % 7).cast("double").alias("v"))
    crowd = spark.range(500).select(F.lit("hot").alias("k"), (F.lit(40.0) + F.greatest(F.col("id") % 100 - 50, F.lit(0)) / 10).alias("s"), (F.col("id") % 9).cast("double").alias("v"))
    t0 = F.lit(1_704_067_200_000_000)
    df = sparse.unionByName(crowd).select("k", F.timestamp_micros((t0 + F.col("s") * 1_000_000).cast("long")).alias("ts"), "v").coalesce(1)
    spec = SeriesSpec(tuple(keys), "ts", step_s=10, chunk_rows=4)
    got = grid.resample_mean(df, spec, ["v"])
    p = plan(got).split("== Initial Plan ==")[-1]
    # from the result down: final aggregation, exchange, partial aggregation, the spread by bin and time
    held = p.rindex("partial_avg")
    assert "REPARTITION_BY_NUM" in p[held:] and "__salt" in p[held:]
    rows = df.collect()
    bins = {}
    for r in rows:
        bins.setdefault((r.k if keys else None, int((r.ts - at(0)).total_seconds() // 10)), []).append(r.v)
    found = {(r.k if keys else None, int((r.ts - at(0)).total_seconds() // 10)): r.v for r in got.collect()}
    for name in {k for k, _ in bins}:
        own = [i for k, i in bins if k == name]
        for i in range(min(own), max(own) + 1):
            seen = bins.get((name, i))
            assert found.pop((name, i)) == (pytest.approx(sum(seen) / len(seen)) if seen else None)
    assert not found


@pytest.mark.parametrize("keys", [["k"], []])
def test_no_task_holds_bins_merged_by_their_compressed_size(spark, keys):
    # bins of one reading, one bin over many places, one of missing readings; numbers of every kind
    rows = [("a", i, i % 7) for i in range(0, 200, 2)] + [("hot", 3, i % 9) for i in range(90)] + [("a", 5, None), ("b", 1, None)]
    df = spark.createDataFrame([(k, at(i * 10 + j % 80 / 10), x) for j, (k, i, x) in enumerate(rows)], "k string, ts timestamp, i int").repartition(3)
    df = df.select("k", "ts", "i", F.col("i").cast("double").alias("d"), F.col("i").cast("decimal(15,2)").alias("p"))
    got = grid.resample_mean(df, SeriesSpec(tuple(keys), "ts", step_s=10, chunk_rows=4, origin_us=1704067200 * 10**6), ["i", "d", "p"])
    assert [t for _, t in got.dtypes[-3:]] == [t for _, t in df.select(F.avg("i"), F.avg("d"), F.avg("p")).dtypes]
    # AQE merges only exchanges that Spark adds by itself; none of them deals out bins
    p = plan(got).split("== Initial Plan ==")[-1]
    assert not [line for line in p.splitlines() if "ENSURE_REQUIREMENTS" in line and "__pos" in line]
    bins = {}
    for k, i, x in rows:
        bins.setdefault((k if keys else None, i), []).append(x)
    found = {(r.k if keys else None, int((r.ts - at(0)).total_seconds() // 10)): (r.i, r.d, r.p) for r in got.collect()}
    for name, i in bins:
        seen = [x for x in bins[name, i] if x is not None]
        for x in found[name, i]:
            assert x is None if not seen else float(x) == pytest.approx(sum(seen) / len(seen), abs=1e-6)
    assert sum(any(x is not None for x in v) for v in found.values()) == sum(any(x is not None for x in v) for v in bins.values())
