"""Evaluation, audits, rollouts, models, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast import SeriesSpec
from gridcast.functions.scalars import softplus
from gridcast.operators import audit, evaluate, features, models, rollout
from gridcast.plans.dataset import prepare_k_ahead
from gridcast.plans.forecast import forecast
from gridcast.plans.storage import scratch_path
from tests.data import STEP, at, series, values

PRED = "target string, y_true double, y_pred double"


def table(df, *cols):
    return {r.target: tuple(r[c] for c in cols) for r in df.collect()}


def test_rollup(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0), ("b", 0.0, 2.0)], PRED)
    got = table(evaluate.metrics(df), "MAE", "RMSE", "R2")
    assert got["a"][0] == got["b"][0] == got["__overall__"][0] == 2.0
    assert got["__overall__"][1] == pytest.approx(2.160247, abs=1e-6)
    assert got["a"][2] == 0.0


def test_skill_uses_the_mean_of_the_baselines(spark):
    model = evaluate.metrics(spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.0, 1.0)], PRED))
    base = evaluate.baseline_metrics(spark.createDataFrame([("a", 0.0, 2.0), ("a", 0.0, 2.0), ("b", 0.0, 4.0)], PRED))
    got = table(evaluate.skill_table(model, base), "skill_RMSE", "skill_MAE")
    assert got["a"] == (0.5, 0.5) and got["b"] == (0.75, 0.75)
    assert got["__overall__"] == (pytest.approx(1 - 1 / math.sqrt(10)), pytest.approx(1 - 1 / 3))


def test_perfect_baseline_has_skill_zero(spark):
    m = evaluate.metrics(spark.createDataFrame([("a", 0.0, 1.0)], PRED))
    b = evaluate.baseline_metrics(spark.createDataFrame([("a", 0.0, 0.0)], PRED))
    assert table(evaluate.skill_table(m, b), "skill_RMSE")["a"] == (0.0,)


def test_persistence_forms(spark):
    df = series(spark, [1, 2, 4, 7, 11, 16, 22, 29, 37, 46])
    assert len(evaluate.persistence_one(df, STEP, ["v"]).collect()) == 9
    rows = evaluate.persistence_series(df, STEP, ["v"], 2).orderBy("ts").collect()
    assert [(r.split, r.y_true - r.y_pred) for r in rows][-2:] == [("train", 15.0), ("val", 17.0)]
    split = df.withColumn("split", F.when(F.col("v") < 20, "train").otherwise("test"))
    spec = STEP.replace(gap_free=False)
    assert len(evaluate.persistence_in_split(split, spec, ["v"], 2).collect()) == 4 + 2


def test_constant_residuals_fill_the_middle_bin(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0)] * 4 + [("b", 0.0, 0.0), ("b", 1.0, 0.0)], PRED)
    got = {(r.target, r.bin): r.n for r in evaluate.residual_histogram(df).collect()}
    assert got == {("a", 26): 4, ("b", 1): 1, ("b", 50): 1}


def test_horizons_beyond_the_data_are_left_out(spark):
    rows = [(0, "a", s, 10.0 + s, 10.0) for s in range(30)]
    df = spark.createDataFrame(rows, "scenario_id int, target string, step int, y_true double, y_pred double")
    got = {r.horizon: (r.mae, r.drift) for r in evaluate.horizon_metrics(df).collect()}
    assert got == {10: (4.5, 0.0), 30: (14.5, 0.0)}


def test_constant_futures(spark):
    """Every row's next steps, over chunk edges and gaps, for two targets, against plain loops."""
    rng = np.random.default_rng(4)
    rows = []
    for k in ("a", "b"):
        for i in range(60):
            if rng.random() < 0.85:  # gaps
                rows.append((k, i, float(rng.integers(0, 9)) if rng.random() < 0.8 else None, float(i)))
    spec = SeriesSpec(("k",), "ts", step_s=10, chunk_rows=7)
    df = spark.createDataFrame(rows, "k string, i long, v double, w double").withColumn("ts", F.timestamp_seconds(F.col("i") * 10)).drop("i")
    got = evaluate.constant_futures(df, spec, ["v", "w"], 5).select("k", F.unix_seconds("ts").alias("t"), "target", "steps", "last").collect()
    values = {(k, i, c): x for k, i, v, w in rows for c, x in (("v", v), ("w", w)) if x is not None}
    want = {}
    for (k, i, c), x in values.items():
        steps = sorted((s, values[k, i + 1 + s, c], x) for s in range(5) if (k, i + 1 + s, c) in values)
        want[k, 10 * i, c] = (steps, steps[-1][0] if steps else None)
    assert {(r.k, r.t, r.target): (sorted(map(tuple, r.steps)), r["last"]) for r in got} == want
    table = {r.horizon: (r.mae, r.drift) for r in evaluate.horizon_table(evaluate.constant_futures(df, spec, ["v", "w"], 5), (2, 5)).collect()}
    for h in (2, 5):
        early = [(abs(p - y), [y0 for s0, y0, _ in steps if s0 == 0], p) for steps, _ in want.values() for s, y, p in steps if s < h]
        drift = [abs(p - first[0]) for _, first, p in early if first]
        assert table[h] == (pytest.approx(np.mean([e for e, _, _ in early])), pytest.approx(np.mean(drift)))


def scenario(spark, n, power, fan, ambient=25.0, sid=0):
    return spark.range(n).select(F.lit(sid).alias("scenario_id"), F.col("id").alias("step"), F.lit(power).alias("power"), F.lit(fan).alias("fan"), F.lit(ambient).alias("ambient"))


def rc(spark, rows, t0, **kw):
    start = rows.select("scenario_id").distinct().withColumn("t0", F.lit(t0))
    out = rollout.rc_rollout(rows, start, gamma=0.01, **kw).orderBy("scenario_id", "step")
    return [r.y_pred for r in out.collect()]


def test_cooling_to_ambient_by_hand(spark):
    got = rc(spark, scenario(spark, 60, 0.0, 0.0), 60.0, block=8)
    assert got[:3] == pytest.approx([59.9825, 59.96500875, 59.947526245625])
    assert 25 < got[-1] < 60


def test_directions(spark):
    assert rc(spark, scenario(spark, 60, 300.0, 30.0), 40.0)[-1] > 40
    slow = rc(spark, scenario(spark, 60, 100.0, 30.0), 60.0)[-1]
    assert rc(spark, scenario(spark, 60, 100.0, 90.0), 60.0)[-1] < slow


@pytest.mark.parametrize("block,levels", [(2, 2), (3, 1), (4, 0), (256, 2)])
def test_scan_equals_the_loop(spark, block, levels):
    rows = scenario(spark, 50, 150.0, 50.0).withColumn("power", F.col("step") * 7 % 13 * 20.0)
    rows = rollout.edit_scenario(rows, "fan", 80.0, 10, 20)
    t, want = 40.0, []
    for s in range(50):
        p, f = s * 7 % 13 * 20.0, 80.0 if 10 <= s < 20 else 50.0
        t += (0.01 * p - 0.03 * f - 0.05 * (t - 25)) / 100
        want.append(t)
    assert rc(spark, rows, 40.0, block=block, levels=levels) == pytest.approx(want)


def test_five_scenarios_stay_finite(spark):
    rows = scenario(spark, 90, 150.0, 50.0)
    for i in range(1, 5):
        rows = rows.unionByName(scenario(spark, 90, 150.0, 50.0, sid=i))
    rows = rollout.edit_scenario(rows, "power", 250.0, 30, 60, F.col("scenario_id") == 0)
    rows = rollout.edit_scenario(rows, "fan", 80.0, 40, 70, F.col("scenario_id") == 1)
    got = rc(spark, rows, 40.0)
    assert len(got) == 450 and all(0 < x < 150 for x in got)


def test_targets_share_the_inputs(spark):
    start = spark.createDataFrame([(0, "a", 60.0), (0, "b", 25.0)], "scenario_id int, target string, t0 double")
    out = rollout.rc_rollout(scenario(spark, 5, 0.0, 0.0), start).where("step = 4").collect()
    assert {r.target: round(r.y_pred, 3) for r in out}["b"] == 25.0 and len(out) == 2


def test_physics_and_driver_choice(spark):
    assert audit.physics_drivers(["s_roll12_mean", "s", "u"], "s", "u", "q") == {
        "supply_air": "s_roll12_mean", "cooling_actuator": "u", "load_proxy": None}
    with pytest.raises(ValueError):
        audit.physics_drivers(["s"], "s", "u", None)
    df = spark.createDataFrame([("a", 30.0, 25.0, 20.0, 50.0, 4.0)], "target string, y_now double, y_pred double, s double, u double, q double")
    c = audit.Thermal(100.0, 0.05, 0.03, 0.01)
    want = (-5 - (-0.05 * 10 + 0.03 * 50 + 0.01 * 4) / 100 * 120) ** 2
    got = table(audit.physics_residual(df, {"a": c}, "s", "u", "q"), "physics")
    assert got["a"][0] == pytest.approx(want) and got["__overall__"][0] == pytest.approx(want)


def test_smoothness_of_short_series(spark):
    spec = SeriesSpec(("k",), "ts", step_s=10)
    df = series(spark, [1, 3, 6], name="y_pred").withColumn("target", F.lit("a"))
    assert table(audit.smoothness(df, spec), "smoothness")["a"] == (6.5,)
    assert table(audit.smoothness(df, spec, 2, "sum"), "smoothness")["a"] == (1.0,)
    assert table(audit.smoothness(df.limit(1), spec), "smoothness")["a"] == (0.0,)
    with pytest.raises(ValueError):
        audit.smoothness(df, spec, 3)


def test_score_card(spark):
    terms = spark.createDataFrame([(2.0, 1.0, 4.0, 10.0, 20.0)], "data double, teacher double, physics double, monotonic double, smoothness double")
    got = {r.phase: r.total for r in audit.total_score(terms).collect()}
    assert got == {"stabilize": pytest.approx(3.2), "physics_on": pytest.approx(6.1), "control_ready": pytest.approx(7.05)}


def test_softplus_large_and_small(spark):
    df = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    got = [r[0] for r in df.select(softplus(F.col("x"))).collect()]
    assert got == pytest.approx([0.0, math.log(2), 800.0])


def test_thermal_ratios_recover_the_coefficients(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(g), float(u), float(q), float(-0.5 * g - 0.2 * u + 0.1 * q)) for g, u, q in rng.normal(size=(200, 3))]
    df = spark.createDataFrame(rows, "target string, gap double, u double, q double, change double")
    r = audit.fit_thermal_ratios(df, "change", "gap", "u", "q").first()
    assert (r.h_over_C, r.beta_over_C, r.gamma_over_C) == (pytest.approx(0.5), pytest.approx(-0.2), pytest.approx(0.1))


@pytest.mark.parametrize("kind", ["relu", "silu", "gelu"])
def test_dense_network_in_batches(spark, kind):
    rng = np.random.default_rng(3)
    net = models.Dense([rng.normal(size=(2, 5)), rng.normal(size=(5, 1))], [rng.normal(size=5), rng.normal(size=1)], kind)
    df = series(spark, range(20)).withColumn("w", F.col("v") / 7)
    got = values(models.dense_predictions(df, net, ["v", "w"], ["t"]), "p_t")
    x = np.array([[i, i / 7] for i in range(20)])
    assert got == pytest.approx(list(models.forward(net, x)[:, 0]))


def test_monotonic_network(spark):
    up = models.Dense([np.array([[0.5], [0.0]])], [np.zeros(1)], "relu")
    df = series(spark, [1, 2]).withColumn("w", F.lit(1.0))
    scored = audit.perturbed_scores(df, ["v", "w"], ["t"], models.dense_scorer(up), "v", 0.01, ["k"])
    got = table(audit.monotonic_penalty(scored), "monotonic", "violations")
    assert got["t"] == (pytest.approx(0.5), 1.0)


def test_time_embeddings(spark):
    df = spark.createDataFrame([(3,)], "t int")
    f = df.select(*features.time_embedding(F.col("t"))).first()
    assert len(f) == 32 and f.t_cos0 == pytest.approx(math.cos(2 * math.pi * 3e-3))
    s = df.select(*features.sinusoidal_time(F.col("t"), 5)).first()
    assert len(s) == 5 and s.t_emb1 == pytest.approx(math.sin(3 * 10000**-0.5)) and s.t_emb4 == 0.0


def forest_data(spark):
    df = series(spark, [math.sin(i / 5) * 10 for i in range(300)]).withColumn("y", F.col("v") + 20)
    return df, prepare_k_ahead(df, STEP.replace(chunk_rows=64), ["v"], ["y"], k=6)


def test_forest_beats_persistence_and_survives_the_registry(spark):
    df, ds = forest_data(spark)
    out = forecast(ds, df, STEP, n_trees=10, max_depth=6)
    assert table(out.skill, "skill_RMSE")["__overall__"][0] > 0.5
    assert models.top_importance(spark, out.forest, 3).count() == 3
    models.check_compatible(out.forest, ds.features, ds.targets)
    with pytest.raises(ValueError):
        models.check_compatible(out.forest, ds.features[::-1], ds.targets)
    path = scratch_path(spark, "forest")
    models.save_forest(spark, out.forest, path)
    again = models.load_forest(spark, path)
    models.sample_check(again, ds.rows)
    keep = ["k", "ts", "split"]
    a = models.score_dataset(out.forest, ds, keep).orderBy("ts").collect()
    assert a == models.score_dataset(again, ds, keep).orderBy("ts").collect()
    assert models.load_forest(spark, path + "-none", allow_missing=True) is None
    assert models.with_optional_model(ds.rows, None) is ds.rows
    with pytest.raises(FileNotFoundError):
        models.load_forest(spark, path + "-none")
    with pytest.raises(ValueError):
        models.predict(again, ds.rows.drop(ds.features[0]))


def test_fingerprint_is_of_the_ordered_names(spark):
    from gridcast.functions.scalars import fingerprint

    assert spark.range(1).select(fingerprint(["a", "b"])).first()[0] == models.fingerprint(["a", "b"])


def test_stream_equals_batch(spark):
    from gridcast.operators.grid import resample_mean
    from gridcast.streaming.bins import stream_means

    df = series(spark, range(40), step=3)
    place = scratch_path(spark, "stream")
    df.write.parquet(place)
    spec = SeriesSpec(("k",), "ts", step_s=10)
    bins = stream_means(spark.readStream.schema(df.schema).parquet(place), spec, ["v"], "0 seconds")
    out, state = scratch_path(spark, "bins"), scratch_path(spark, "state")
    bins.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.ts: r.v for r in spark.read.parquet(out).collect()}
    want = {r.ts: r.v for r in resample_mean(df, spec, ["v"]).collect()}
    # the bins still open when the input ends are not final
    assert got and all(want[t] == v for t, v in got.items()) and len(got) >= len(want) - 1
    assert min(got) == at(0)
