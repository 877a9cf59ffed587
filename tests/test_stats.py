"""Quantiles, clipping, scaling; fitted on train rows only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast import SeriesSpec
from gridcast.operators import stats
from gridcast.plans.dataset import compare_names, prepare_k_ahead
from tests.data import series, skewed, values


def test_quantiles_interpolate_and_skip_missing(spark):
    df = series(spark, [1, 2, 3, 10, None])
    low, high = stats.pooled(stats.winsor_bounds(df, ["v"]))["v"]
    assert (low, high) == (pytest.approx(1.03), pytest.approx(9.79))


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "constant"])
def test_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(7)
    x = {
        "normal": rng.normal(size=20_000),
        "heavy": np.exp(rng.normal(size=20_000) * 12),
        "ties": rng.integers(0, 4, size=20_000).astype(float),
        "constant": np.full(20_000, 3.5),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    qs = [0.01, 0.5, 0.987, 1.0]
    got = stats.quantiles(df, ["v"], qs).first()["v"]
    assert got == pytest.approx(list(np.quantile(x, qs)), rel=1e-12)


def test_quantiles_per_entity_with_a_hot_one(spark):
    df = skewed(spark, hot=6000, others=4, each=3000)
    got = {r.k: r.v for r in stats.quantiles(df, ["v"], [0.01, 0.99], ["k"]).collect()}
    want = {r.k: r.v for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("v")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_quantiles_of_many_columns(spark):
    """112 columns; groups without a key or without values stay."""
    rng = np.random.default_rng(3)
    cols = [f"c{j}" for j in range(112)]
    x = rng.normal(size=(600, 112))
    rows = [(("a", None)[i % 2], *map(float, r[:-1]), None) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols)).repartition(4).cache()
    got = stats.quantiles(df, cols, [0.01, 0.99]).first()
    for j, c in enumerate(cols[:-1]):
        assert got[c] == pytest.approx(list(np.quantile(x[:, j], [0.01, 0.99])), rel=1e-9)
    assert got["c111"] is None
    by = {r.k: r for r in stats.quantiles(df, ["c0", "c111"], [0.5], ["k"]).collect()}
    assert by["a"].c0 == pytest.approx([np.median(x[::2, 0])]) and by[None].c0 == pytest.approx([np.median(x[1::2, 0])])
    assert by["a"].c111 is None and stats.quantiles(df.limit(0), ["c0"], [0.5]).first().c0 is None


def test_ordered_bits(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 20_000).view(np.float64), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 2.0**-1022, 1.0, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308]])
    x = np.concatenate([x, 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1000, 1024), 0), np.nextafter(2.0 ** np.arange(-1000, 1023), np.inf)])
    x = x[~np.isnan(x)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", stats.ordered_bits(F.col("x")).alias("b"))
    rows = df.select("x", "b", stats.from_ordered_bits(F.col("b")).alias("back")).collect()
    raw = np.array([r.x for r in rows])
    want = np.abs(raw).view(np.int64) * np.where(raw < 0, -1, 1)
    assert [r.b for r in rows] == want.tolist() and [r.back for r in rows] == raw.tolist()
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(stats.ordered_bits(F.col("x")).alias("b"))
    assert nan.first().b > max(want) and np.isnan(nan.select(stats.from_ordered_bits(F.col("b"))).first()[0])


def test_clip_keeps_missing(spark):
    assert values(stats.winsorize(series(spark, [None, 5, 1]), {"v": (2, 4), "absent": (0, 1)}), "v") == [None, 4.0, 2.0]


def test_constant_target_has_scale_one(spark):
    df = series(spark, [5, 5, 5])
    fitted = stats.pooled(stats.scaler_fit(df, ["v"]))
    assert fitted["v"] == (5.0, 1.0)
    assert values(stats.scaler_transform(df, fitted, ["v"]), "v") == [0.0] * 3
    assert values(stats.zscore_full(df, ["v"], ["k"]), "v_z") == [0.0] * 3
    with pytest.raises(KeyError):
        stats.scaler_transform(df, {}, ["v"])


def test_scaler_per_entity_round_trip(spark):
    df = skewed(spark).where("v IS NOT NULL")
    fitted = stats.scaler_fit(df, ["v"], ["k"])
    back = stats.scaler_inverse(stats.scaler_transform(df, fitted, ["v"], ["k"]), fitted, ["v"], ["k"])
    assert values(back, "v") == pytest.approx(values(df, "v"))


def test_low_variance_and_missing_columns_go(spark):
    df = series(spark, [1, 2, 3]).withColumn("flat", F.lit(1.0)).withColumn("none", F.lit(None).cast("double"))
    assert stats.keep_columns(df, ["v", "flat", "none"]) == ["v"]


SPEC = SeriesSpec(("k",), "ts", step_s=10, gap_free=True)


def dataset(spark, tail):
    df = series(spark, [((i * 37) % 101) / 3 for i in range(100)] + tail).withColumn("y", F.col("v") * 2 + 1)
    return prepare_k_ahead(df, SPEC, ["v"], ["y"], lags=(1, 3), rolls=(3,), k=2)


def test_changing_test_rows_does_not_change_what_was_fitted(spark):
    a = dataset(spark, [1.0] * 30)
    b = dataset(spark, [1e6] * 30)
    assert a.bounds == b.bounds and a.scaler == b.scaler and a.features == b.features


def test_split_of_697_rows(spark):
    df = series(spark, [((i * 7919) % 1009) / 10 for i in range(721)]).withColumn("y", F.col("v"))
    ds = prepare_k_ahead(df, SPEC, ["v"], ["y"], k=12)
    assert {r.split: r.n for r in ds.counts().collect()} == {"train": 487, "val": 104, "test": 106}
    assert len(ds.features) == 14


def test_feature_list_check(spark):
    assert not compare_names(["a", "b"], ["a", "b"])
    swapped = compare_names(["b", "a"], ["a", "b"])
    assert swapped and swapped.first == 0 and swapped.absent == swapped.surplus == ()
    other = compare_names(["a", "c", "d", "c"], ["a", "b"])
    assert (other.first, other.absent, other.surplus, other.repeated) == (1, ("b",), ("c", "d"), ("c",))
    assert compare_names(["a"], ["a", "b"]).first == 1 and "absent: b" in str(compare_names(["a"], ["a", "b"]))
    df = series(spark, [((i * 7919) % 1009) / 10 for i in range(60)])
    with pytest.raises(ValueError):
        prepare_k_ahead(df, SPEC, ["v"], ["v"], k=1, expected=["v"])
