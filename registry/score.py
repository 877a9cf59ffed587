"""Baseline, evaluation, audit and rollout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.operators import align, audit, evaluate, features, rollout
from gridcast.plans.chunks import POS, TOTAL, positions
from gridcast.plans.storage import materialize
from registry import views as v
from registry.views import r6, rs, secs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


RACKS = f"WITH {v.RACKS_SQL}"
PRED = f"{RACKS}, {v.predictions_sql()}"
T = "CAST(t AS BIGINT) AS t"

# A second model: y(t+k) is predicted by the mean of the last three values.
MEAN3 = ", ".join(
    f"{v.roll_sql(c, 3, 'mean', 'rack')} AS {c}_p, {v.lead_sql(c, 3, 'rack')} AS {c}_f" for c in v.TARGETS
)
MODEL_SQL = f"model_w AS (SELECT rack, t, {MEAN3} FROM racks), model AS (" + " UNION ALL ".join(
    f"SELECT rack, t, '{c}' AS target, {c}_f AS y_true, {c}_p AS y_pred FROM model_w WHERE {c}_f IS NOT NULL AND {c}_p IS NOT NULL"
    for c in v.TARGETS
) + ")"


def model_predictions(spark, sf):
    return predictions_of(v.racks(spark, sf))


def predictions_of(racks):
    names = [*v.TARGETS, *[f"{c}_roll3_mean" for c in v.TARGETS]]
    feats = features.features_from_list(racks, v.RACKS, names)
    rows = features.add_labels(feats, v.RACKS, v.TARGETS, 3)
    return evaluate.to_long(rows, {c: (f"y_{c}", f"{c}_roll3_mean") for c in v.TARGETS}, ["rack", "ts"])


def metric_sql(cols: str, source: str, group: str = "", r2: bool = True) -> str:
    g = f"{group}, " if group else ""
    ss = "(var_pop(y_true) * count(*))"
    extra = f", {rs(f'CASE WHEN {ss} < 1e-10 THEN 0 ELSE 1 - sum((y_true - y_pred) ** 2) / {ss} END')} AS R2" if r2 else ""
    return f"""SELECT {cols}coalesce(target, '__overall__') AS target, {rs('avg(abs(y_true - y_pred))')} AS MAE,
  {rs('sqrt(avg((y_true - y_pred) ** 2))')} AS RMSE{extra} FROM {source}
  GROUP BY GROUPING SETS (({g}target), ({group}))"""


def rounded(df, cols, *keep):
    return df.select(*keep, *[r6(c).alias(c) for c in cols])


PAIR_COLS = ["y_true", "y_pred"]


@query(f"{RACKS}, w AS (SELECT rack, t, " + ", ".join(f"{c}, {v.lag_sql(c, 1, 'rack')} AS {c}_p" for c in v.TARGETS)
       + " FROM racks) " + " UNION ALL ".join(
    f"SELECT rack, {T}, '{c}' AS target, {rs(c)} AS y_true, {rs(c + '_p')} AS y_pred FROM w "
    f"WHERE t_low_p IS NOT NULL AND t_high_p IS NOT NULL AND {c} IS NOT NULL" for c in v.TARGETS))
def persistence_1(spark, sf):
    out = evaluate.persistence_one(v.racks(spark, sf), v.RACKS, v.TARGETS)
    return rounded(out, PAIR_COLS, "rack", secs().alias("t"), "target")


@query(f"{RACKS}, {v.xy_sql()}, w AS (SELECT rack, t, split, " + ", ".join(
    f"y_{c}, lead(y_{c}, 3) OVER (PARTITION BY rack, split ORDER BY t) AS y_{c}_f" for c in v.TARGETS)
    + " FROM xy) " + " UNION ALL ".join(
    f"SELECT rack, {T}, split, 'y_{c}' AS target, {rs(f'y_{c}_f')} AS y_true, {rs(f'y_{c}')} AS y_pred FROM w "
    "WHERE y_t_low_f IS NOT NULL AND y_t_high_f IS NOT NULL" for c in v.TARGETS))
def persistence_k_split(spark, sf):
    ys = [f"y_{c}" for c in v.TARGETS]
    out = evaluate.persistence_in_split(v.xy(spark, sf), v.RACKS_RAW, ys, 3)
    return rounded(out, PAIR_COLS, "rack", secs().alias("t"), "split", "target")


@query(f"{PRED} SELECT rack, {T}, target, split, {v.r6_list(PAIR_COLS)} FROM pred")
def persistence_k_series(spark, sf):
    out = v.predictions(spark, sf)
    return rounded(out, PAIR_COLS, "rack", secs().alias("t"), "target", "split")


@query(f"{PRED} " + metric_sql("split, ", "pred", "split"))
def metrics_rollup(spark, sf):
    out = evaluate.metrics(v.predictions(spark, sf), ["split"])
    return rounded(out, ["MAE", "RMSE", "R2"], "split", "target")


@query(f"{PRED} " + metric_sql("", "pred", r2=False))
def baseline_metrics(spark, sf):
    return rounded(evaluate.baseline_metrics(v.predictions(spark, sf)), ["MAE", "RMSE"], "target")


@query(f"{RACKS} " + metric_sql("", "(SELECT 'flat' AS target, 5.0::DOUBLE AS y_true, fan AS y_pred FROM racks WHERE fan IS NOT NULL)"))
def r2_of_constant(spark, sf):
    # a truth that never varies has R2 0
    rows = v.racks(spark, sf).select(F.lit("flat").alias("target"), F.lit(5.0).alias("y_true"), F.col("fan").alias("y_pred"))
    return rounded(evaluate.metrics(rows.where("y_pred IS NOT NULL")), ["MAE", "RMSE", "R2"], "target")


SKILL_SQL = f"""{PRED}, {MODEL_SQL},
m AS (SELECT coalesce(target, '__overall__') AS target, avg(abs(y_true - y_pred)) AS MAE, sqrt(avg((y_true - y_pred) ** 2)) AS RMSE
  FROM model GROUP BY GROUPING SETS ((target), ())),
b1 AS (SELECT target, avg(abs(y_true - y_pred)) AS MAE, sqrt(avg((y_true - y_pred) ** 2)) AS RMSE FROM pred GROUP BY target),
b AS (SELECT * FROM b1 UNION ALL SELECT '__overall__', avg(MAE), sqrt(avg(RMSE * RMSE)) FROM b1)"""


@query(f"{SKILL_SQL} SELECT m.target, {rs('CASE WHEN b.RMSE < 1e-10 THEN 0 ELSE 1 - m.RMSE / b.RMSE END')} AS skill_RMSE, "
       f"{rs('CASE WHEN b.MAE < 1e-10 THEN 0 ELSE 1 - m.MAE / b.MAE END')} AS skill_MAE FROM m JOIN b ON m.target = b.target")
def skill_vs_persistence(spark, sf):
    model = evaluate.metrics(model_predictions(spark, sf))
    base = evaluate.baseline_metrics(v.predictions(spark, sf))
    return rounded(evaluate.skill_table(model, base), ["skill_RMSE", "skill_MAE"], "target")


@query(f"{SKILL_SQL} SELECT m.target, {rs('m.RMSE')} AS RMSE, {rs('1 - m.RMSE / b.RMSE')} AS skill_RMSE "
       "FROM m JOIN b ON m.target = b.target WHERE m.target <> '__overall__'")
def skill_per_target(spark, sf):
    model = evaluate.metrics(model_predictions(spark, sf))
    base = evaluate.baseline_metrics(v.predictions(spark, sf))
    out = evaluate.per_target(evaluate.skill_table(model, base))
    return rounded(out, ["RMSE", "skill_RMSE"], "target")


@query(f"{PRED}, {MODEL_SQL}, a AS (SELECT *, 'model' AS split FROM model UNION ALL SELECT rack, t, target, y_true, y_pred, 'persistence' FROM pred) "
       + metric_sql("split, ", "a", "split", r2=False))
def metrics_union(spark, sf):
    out = evaluate.stack_metrics({
        "model": evaluate.baseline_metrics(model_predictions(spark, sf)),
        "persistence": evaluate.baseline_metrics(v.predictions(spark, sf)),
    })
    return rounded(out, ["MAE", "RMSE"], "split", "target")


@query(f"{PRED}, {MODEL_SQL} SELECT model.rack, CAST(model.t AS BIGINT) AS t, model.target, {rs('model.y_pred')} AS y_pred, {rs('pred.y_pred')} AS y_base "
       "FROM model JOIN pred ON model.rack = pred.rack AND model.t = pred.t AND model.target = pred.target")
def model_with_baseline(spark, sf):
    out = align.align_with_baseline(model_predictions(spark, sf), v.predictions(spark, sf), ["rack"])
    return rounded(out, ["y_pred", "y_base"], "rack", secs().alias("t"), "target")


@query(f"{PRED}, {MODEL_SQL} SELECT '__overall__' AS target, {rs('(SELECT avg(abs(y_true - y_pred)) FROM model)')} AS MAE, "
       f"{rs('(SELECT sqrt(avg((y_true - y_pred) ** 2)) FROM model)')} AS RMSE, "
       f"{rs('(SELECT avg(abs(y_true - y_pred)) FROM pred)')} AS base_MAE, {rs('(SELECT sqrt(avg((y_true - y_pred) ** 2)) FROM pred)')} AS base_RMSE")
def model_vs_baseline(spark, sf):
    out = align.overall_comparison(
        evaluate.metrics(model_predictions(spark, sf)), evaluate.baseline_metrics(v.predictions(spark, sf))
    )
    return rounded(out, ["MAE", "RMSE", "base_MAE", "base_RMSE"], "target")


@query(f"{SKILL_SQL} SELECT m.target, {rs('m.MAE')} AS MAE, {rs('b.MAE')} AS base_MAE, {rs('100 * (b.MAE - m.MAE) / b.MAE')} AS change_pct, "
       "CASE WHEN m.MAE < b.MAE THEN 'better' ELSE 'worse' END AS verdict FROM m JOIN b ON m.target = b.target WHERE m.target <> '__overall__'")
def relative_change(spark, sf):
    out = evaluate.relative_change(
        evaluate.per_target(evaluate.metrics(model_predictions(spark, sf))),
        evaluate.baseline_metrics(v.predictions(spark, sf)),
    )
    return rounded(out, ["MAE", "base_MAE", "change_pct"], "target", "verdict")


@query(f"{PRED} SELECT rack, {T}, target, {rs('y_true - y_pred')} AS residual FROM pred")
def residual_series(spark, sf):
    out = evaluate.residuals(v.predictions(spark, sf))
    return rounded(out, ["residual"], "rack", secs().alias("t"), "target")


@query(f"{PRED} SELECT target, {rs('avg(y_true - y_pred)')} AS mean, {rs('stddev_pop(y_true - y_pred)')} AS std FROM pred GROUP BY target")
def residual_stats(spark, sf):
    return rounded(evaluate.residual_stats(v.predictions(spark, sf)), ["mean", "std"], "target")


@query(f"""{PRED}, e AS (SELECT target, y_true - y_pred AS e FROM pred), s AS (SELECT target, min(e) AS lo, max(e) AS hi FROM e GROUP BY target)
  SELECT e.target, CAST(least(floor(50 * (e - lo) / (hi - lo)) + 1, 50) AS INT) AS bin, count(*) AS n
  FROM e JOIN s ON e.target = s.target GROUP BY 1, 2""")
def residual_hist(spark, sf):
    return evaluate.residual_histogram(v.predictions(spark, sf))


@query(f"""{RACKS}, w AS (SELECT rack, t, row_number() OVER (PARTITION BY rack ORDER BY t) - 1 AS rn, count(*) OVER (PARTITION BY rack) AS n FROM racks),
  i AS (SELECT unnest(range(0, 20)) AS i), p AS (SELECT DISTINCT rack, CASE WHEN i = 19 THEN n - 1 ELSE CAST(floor(i * ((n - 1)::DOUBLE / 19)) AS BIGINT) END AS rn
    FROM (SELECT DISTINCT rack, n FROM w), i)
  SELECT w.rack, {T} FROM w JOIN p ON w.rack = p.rack AND w.rn = p.rn""")
def downsample(spark, sf):
    out = evaluate.downsample(v.racks(spark, sf), v.RACKS_RAW, 20)
    return out.select("rack", secs().alias("t"))


# Rollout rows: every rack is a scenario, its bins are the steps; the truth is
# a target, the prediction its value three bins earlier.
STEPS_SQL = f"""steps AS (SELECT rack AS scenario_id, row_number() OVER (PARTITION BY rack ORDER BY b) - 1 AS step,
  fan, supply, load, t_low, t_high, {v.lag_sql('t_low', 3, 'rack')} AS p_low, {v.lag_sql('t_high', 3, 'rack')} AS p_high FROM racks)"""
LONG_SQL = """r AS (SELECT scenario_id, step, 't_low' AS target, t_low AS y_true, coalesce(p_low, t_low) AS y_pred FROM steps
  UNION ALL SELECT scenario_id, step, 't_high', t_high, coalesce(p_high, t_high) FROM steps)"""


def steps(spark, sf):
    rows = features.add_lags(v.racks(spark, sf), v.RACKS, v.TARGETS, [3])
    numbered = positions(rows, v.RACKS_RAW).withColumnRenamed(POS, "step").drop(TOTAL)
    lags = [F.col(f"{c}_lag3").alias(c.replace("t_", "p_")) for c in v.TARGETS]
    return numbered.select(F.col("rack").alias("scenario_id"), "step", *v.EXOG, *v.TARGETS, *lags)


def of_targets(rows, value, name, *kept):
    """Long rows (kept, target, name) of all targets; ``value`` makes the column of one."""
    cells = [F.struct(F.lit(c).alias("target"), value(c).alias(name)) for c in v.TARGETS]
    return rows.select(*kept, F.explode(F.array(*cells)).alias("__r")).select(*kept, "__r.*")


@query(f"""{RACKS}, {STEPS_SQL}, {LONG_SQL},
  z AS (SELECT scenario_id, target, y_true AS start FROM r WHERE step = 0),
  h AS (SELECT unnest([10, 30, 60, 90]) AS horizon)
  SELECT r.target, horizon, {rs('avg(abs(y_pred - y_true))')} AS mae, {rs('sqrt(avg((y_pred - y_true) ** 2))')} AS rmse, {rs('avg(abs(y_pred - start))')} AS drift
  FROM r LEFT JOIN z ON r.scenario_id = z.scenario_id AND r.target = z.target JOIN h ON step < horizon
  WHERE horizon <= (SELECT max(step) + 1 FROM r) GROUP BY r.target, horizon""")
def horizon_metrics(spark, sf):
    both = lambda c: F.struct(F.col(c).alias("y_true"), F.coalesce(c.replace("t_", "p_"), c).alias("y_pred"))
    rows = of_targets(steps(spark, sf), both, "y", "scenario_id", "step").select("scenario_id", "step", "target", "y.*")
    return rounded(evaluate.horizon_metrics(rows, groups=["target"]), ["mae", "rmse", "drift"], "target", "horizon")


POOLED_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS target, a.rack, a.t, o.step, f.{c} AS y_true, a.{c} AS y_pred FROM racks a, o
    JOIN racks f ON f.rack = a.rack AND f.b = a.b + o.step + 1 WHERE f.{c} IS NOT NULL AND a.{c} IS NOT NULL""" for c in v.TARGETS)


@query(f"""{RACKS}, o AS (SELECT unnest(range(0, 30)) AS step), r AS ({POOLED_SQL}),
  z AS (SELECT target, rack, t, y_true AS start FROM r WHERE step = 0), h AS (SELECT unnest([10, 20, 30]) AS horizon)
  SELECT r.target, horizon, {rs('avg(abs(y_pred - y_true))')} AS mae, {rs('sqrt(avg((y_pred - y_true) ** 2))')} AS rmse, {rs('avg(abs(y_pred - start))')} AS drift
  FROM r LEFT JOIN z ON r.rack = z.rack AND r.t = z.t AND r.target = z.target JOIN h ON step < horizon
  WHERE horizon <= (SELECT max(step) + 1 FROM r) GROUP BY r.target, horizon""")
def horizon_pooled(spark, sf):
    # every row starts a rollout; the truth is what came after it
    rows = evaluate.constant_futures(v.racks(spark, sf), v.RACKS, v.TARGETS, 30)
    out = evaluate.horizon_table(rows, evaluate.default_horizons(30), ["target"])
    return rounded(out, ["mae", "rmse", "drift"], "target", "horizon")


@query(f"{PRED}, {MODEL_SQL} SELECT coalesce(model.target, '__overall__') AS target, {rs('avg((model.y_pred - pred.y_pred) ** 2)')} AS mse "
       "FROM model JOIN pred ON model.rack = pred.rack AND model.t = pred.t AND model.target = pred.target GROUP BY GROUPING SETS ((model.target), ())")
def prediction_mse(spark, sf):
    out = audit.prediction_mse(model_predictions(spark, sf), v.predictions(spark, sf), ["rack"])
    return rounded(out, ["mse"], "target")


@query(f"{RACKS} SELECT rack, {T}, {rs('t_low')} AS absolute, {rs('t_low + load')} AS delta FROM racks")
def absolute_from_delta(spark, sf):
    rows = v.racks(spark, sf)
    return rows.select("rack", secs().alias("t"), *[
        r6(rollout.absolute_prediction(F.col("t_low") if m == "absolute" else F.col("load"), F.col("t_low"), m)).alias(m)
        for m in ("absolute", "delta")
    ])


@query("SELECT l_suppkey AS target, " + ", ".join(f"{rs(f'ln(1 + exp({e}))')} AS {c}" for c, e in (
    ("C", "avg(l_quantity) - 25"), ("h", "avg(l_discount)"), ("beta", "avg(l_tax)"), ("gamma", "-avg(l_quantity)"))) + " FROM lineitem GROUP BY l_suppkey")
def softplus_params(spark, sf):
    raw = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("target")).agg(
        (F.avg("l_quantity") - 25).alias("C"), F.avg("l_discount").alias("h"), F.avg("l_tax").alias("beta"), (-F.avg("l_quantity")).alias("gamma"))
    return rounded(audit.thermal_parameters(raw), ["C", "h", "beta", "gamma"], "target")


# Fixed test values: coefficients of the two targets.
THERMAL = {"t_low": audit.Thermal(100.0, 0.05, -0.03, 0.01), "t_high": audit.Thermal(80.0, 0.04, -0.02, 0.02)}
PHYSICS_CASE = " ".join(
    f"WHEN '{t}' THEN (-{c.h} * (y_now - supply) + {c.beta} * fan + {c.gamma} * load) / {c.C} * 10 * 12" for t, c in THERMAL.items()
)


def physics_rows(spark, sf):
    drivers = audit.physics_drivers([*v.EXOG, "fan_roll12_mean"], "supply", "fan", "load")
    feats = features.add_rolls(v.racks(spark, sf), v.RACKS, ["fan"], [12], ["mean"])
    rows = features.add_labels(feats, v.RACKS, v.TARGETS, 3)
    long = evaluate.to_long(rows, {c: (c, f"y_{c}") for c in v.TARGETS}, ["rack", "ts", *[d for d in drivers.values()]])
    return long.withColumnRenamed("y_true", "y_now"), drivers


@query(f"{RACKS}, w AS (SELECT rack, t, supply, load, {v.roll_sql('fan', 12, 'mean', 'rack')} AS fan, t_low, t_high, "
       + ", ".join(f"{v.lead_sql(c, 3, 'rack')} AS {c}_f" for c in v.TARGETS) + " FROM racks), l AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS target, supply, fan, load, {c} AS y_now, {c}_f AS y_pred FROM w WHERE {c} IS NOT NULL AND {c}_f IS NOT NULL" for c in v.TARGETS)
       + f"), g AS (SELECT target, y_pred - y_now - CASE target {PHYSICS_CASE} END AS gap FROM l) "
       f"SELECT coalesce(target, '__overall__') AS target, {rs('avg(gap * gap)')} AS physics FROM g GROUP BY GROUPING SETS ((target), ())")
def physics_residual(spark, sf):
    rows, d = physics_rows(spark, sf)
    out = audit.physics_residual(rows, THERMAL, d["supply_air"], d["cooling_actuator"], d["load_proxy"])
    return rounded(out, ["physics"], "target")


# Fixed test values: weights of a linear scorer per target, over fan, supply, load.
LINEAR = {"t_low": (0.5, -0.25, 0.125), "t_high": (-0.5, 0.75, 0.25)}


def linear_scorer(x):
    return F.array(*[sum((x[i] * w for i, w in enumerate(ws)), F.lit(0.0)) for ws in LINEAR.values()])


def scored_up(spark, sf):
    rows = v.racks(spark, sf).dropna(how="any", subset=v.EXOG)
    return audit.perturbed_scores(rows, v.EXOG, v.TARGETS, linear_scorer, "fan", 0.01, ["rack", "ts"])


@query(f"{RACKS} SELECT unnest(['t_low', 't_high', '__overall__']) AS target, unnest([0.5, 0.0, 0.25]::DOUBLE[]) AS monotonic, "
       "unnest([1.0, 0.0, 0.5]::DOUBLE[]) AS violations FROM (SELECT count(*) AS n FROM racks) WHERE n > 0")
def monotonic_penalty(spark, sf):
    return rounded(audit.monotonic_penalty(scored_up(spark, sf)), ["monotonic", "violations"], "target")


@query(f"{RACKS} SELECT unnest(['t_low', 't_high', '__overall__']) AS target, unnest([0.25, 0.0, 0.125]::DOUBLE[]) AS monotonic "
       "FROM (SELECT count(*) AS n FROM racks) WHERE n > 0")
def monotonic_quadratic(spark, sf):
    return rounded(audit.monotonic_penalty(scored_up(spark, sf), kind="quadratic"), ["monotonic"], "target")


def smooth_sql(diff: str, agg: str) -> str:
    return (f"{PRED}, d AS (SELECT target, {diff} AS d FROM pred WINDOW w AS (PARTITION BY rack, target ORDER BY t)) "
            f"SELECT coalesce(target, '__overall__') AS target, {rs(f'coalesce({agg}(d * d), 0)')} AS smoothness FROM d GROUP BY GROUPING SETS ((target), ())")


@query(smooth_sql("y_pred - lag(y_pred) OVER w", "avg"))
def smoothness_1(spark, sf):
    out = audit.smoothness(materialize(v.predictions(spark, sf)), v.RACKS_RAW, 1)
    return rounded(out, ["smoothness"], "target")


@query(smooth_sql("y_pred - 2 * lag(y_pred) OVER w + lag(y_pred, 2) OVER w", "avg"))
def smoothness_2(spark, sf):
    out = audit.smoothness(materialize(v.predictions(spark, sf)), v.RACKS_RAW, 2)
    return rounded(out, ["smoothness"], "target")


@query(f"{PRED}, d AS (SELECT y_true, y_pred, y_pred - lag(y_pred) OVER (PARTITION BY rack, target ORDER BY t) AS d FROM pred), "
       "s AS (SELECT avg((y_true - y_pred) ** 2) AS data, avg(d * d) AS smoothness FROM d), "
       "w AS (SELECT unnest(['stabilize', 'physics_on', 'control_ready']) AS phase, unnest([0.0, 0.1, 0.2]) AS mono) "
       f"SELECT phase, {rs('data')} AS data, {rs('smoothness')} AS smoothness, {rs('data + 0.25 * mono + 0.05 * smoothness')} AS total FROM s, w")
def total_score(spark, sf):
    pred = materialize(v.predictions(spark, sf))
    parts = [
        audit.prediction_mse(pred, pred.withColumn("y_pred", F.col("y_true")), ["rack"]).withColumnRenamed("mse", "data"),
        audit.smoothness(pred, v.RACKS_RAW, 1),
        audit.monotonic_penalty(scored_up(spark, sf)).select("target", "monotonic"),
    ]
    terms = parts[0].join(parts[1], "target").join(parts[2], "target").where("target = '__overall__'")
    return rounded(audit.total_score(terms), ["data", "smoothness", "total"], "phase")


# Fixed test values: the set point of each target.
SETPOINTS = {"t_low": 38.0, "t_high": 41.0}


@query(f"{RACKS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS target, {T}, {rs(f'-avg(abs({c} - {x}))')} AS reward, {rs(f'avg({c})')} AS mean_temp, {rs(f'max({c})')} AS max_temp, "
    f"{rs(f'min({c})')} AS min_temp FROM racks GROUP BY t" for c, x in SETPOINTS.items()))
def setpoint_kpi(spark, sf):
    # one row per reading of a target, so that one aggregation serves both
    rows = of_targets(v.racks(spark, sf), F.col, "y", "ts")
    x = F.create_map(*[z for c, at in SETPOINTS.items() for z in (F.lit(c), F.lit(at))])[F.col("target")]
    out = audit.setpoint_kpi(rows.withColumn("x", x), ["target", "ts"], "y", F.col("x"))
    return rounded(out, ["reward", "mean_temp", "max_temp", "min_temp"], "target", secs().alias("t"))


@query(f"{RACKS} SELECT rack, {T}, {rs('CASE WHEN fan IS NOT NULL THEN least(greatest((fan - 25) * 20, 0), 100) END')} AS fan FROM racks")
def actuator_clamp(spark, sf):
    rows = v.racks(spark, sf).withColumn("fan", (F.col("fan") - 25) * 20)
    return rounded(audit.clamp_actuator(rows, "fan"), ["fan"], "rack", secs().alias("t"))


@query(f"""{RACKS}, {STEPS_SQL}, i AS (SELECT scenario_id, step, coalesce(load, 0) * 50 AS p, coalesce(supply, 0) AS amb,
    CASE WHEN step BETWEEN 10 AND 19 THEN 80.0 ELSE coalesce(fan, 25) END AS f FROM steps)
  SELECT scenario_id, step, {rs('y_pred')} AS y_pred FROM (
    WITH RECURSIVE r(scenario_id, step, y_pred) AS (
      SELECT scenario_id, step, 40 + (0.01 * p - 0.03 * f - 0.05 * (40 - amb)) / 100 FROM i WHERE step = 0
      UNION ALL SELECT i.scenario_id, i.step, r.y_pred + (0.01 * p - 0.03 * f - 0.05 * (r.y_pred - amb)) / 100
      FROM r JOIN i ON i.scenario_id = r.scenario_id AND i.step = r.step + 1)
    SELECT * FROM r)""")
def rc_rollout(spark, sf):
    # every step is kept: one without a reading runs on neutral inputs
    rows = steps(spark, sf).select(
        "scenario_id", "step", (F.coalesce("load", F.lit(0.0)) * 50).alias("power"),
        F.coalesce("fan", F.lit(25.0)).alias("fan"), F.coalesce("supply", F.lit(0.0)).alias("ambient"))
    rows = rollout.edit_scenario(rows, "fan", 80.0, 10, 20)
    start = rows.select("scenario_id").distinct().withColumn("t0", F.lit(40.0))
    out = rollout.rc_rollout(rows, start, gamma=0.01, block=16)
    return rounded(out, ["y_pred"], "scenario_id", "step")


# Fixed test values: start, mean and scale of each target.
CUM_START = {"t_low": (1.5, 38.0, 2.0), "t_high": (-0.5, 45.0, 3.0)}
CUM_SQL = f"{RACKS}, {STEPS_SQL}, c AS (" + " UNION ALL ".join(
    f"""SELECT scenario_id, '{c}' AS target, step, ({z} + sum(coalesce((fan - 25) / 10, 0)) OVER (PARTITION BY scenario_id ORDER BY step)) * {s} + {m} AS y
    FROM steps""" for c, (z, m, s) in CUM_START.items()) + ")"


def cumulative(spark, sf):
    # every step is kept: one without a reading changes nothing
    delta = F.coalesce((F.col("fan") - 25) / 10, F.lit(0.0))
    rows = of_targets(steps(spark, sf), lambda c: delta, "delta", "scenario_id", "step")
    t0 = F.create_map(*[x for c, (z, _, _) in CUM_START.items() for x in (F.lit(c), F.lit(z))])
    start = rows.select("scenario_id", "target").distinct().withColumn("t0", t0[F.col("target")])
    return rollout.cumulative_rollout(rows, start, scaler={c: (m, s) for c, (_, m, s) in CUM_START.items()}, chunk_rows=16)


@query(CUM_SQL + f" SELECT scenario_id, target, step, {rs('y')} AS y_pred FROM c")
def cumulative_rollout(spark, sf):
    return rounded(cumulative(spark, sf), ["y_pred"], "scenario_id", "target", "step")


def constant(spark, sf):
    rows = of_targets(steps(spark, sf).where("step = 0"), F.col, "y_pred", "scenario_id")
    return rollout.constant_rollout(rows, 90).withColumn("step", F.col("step").cast("long"))


CONST_SQL = " UNION ALL ".join(f"SELECT scenario_id, '{c}' AS target, {c} AS y, unnest(range(0, 90)) AS step FROM steps WHERE step = 0" for c in v.TARGETS)


@query(f"{RACKS}, {STEPS_SQL} SELECT scenario_id, target, step, {rs('y')} AS y_pred FROM ({CONST_SQL})")
def constant_rollout(spark, sf):
    return rounded(constant(spark, sf), ["y_pred"], "scenario_id", "target", "step")


@query(CUM_SQL + f", k AS ({CONST_SQL}) SELECT coalesce(c.scenario_id, k.scenario_id) AS scenario_id, coalesce(c.target, k.target) AS target, "
       f"coalesce(c.step, k.step) AS step, {rs('c.y')} AS net, {rs('k.y')} AS forest "
       "FROM c FULL JOIN k ON c.scenario_id = k.scenario_id AND c.step = k.step AND c.target = k.target")
def rollout_compare(spark, sf):
    out = rollout.compare_rollouts({"net": cumulative(spark, sf), "forest": constant(spark, sf)}, ["scenario_id"])
    return rounded(out, ["net", "forest"], "scenario_id", "target", "step")


THERMAL_SQL = ", ".join(f"""w_{c} AS (SELECT rack, {c}, supply, fan, load, {v.lead_sql(c, 1, 'rack')} - {c} AS d FROM racks),
  l_{c} AS (SELECT supply - {c} AS x0, fan AS x1, load AS x2, d AS y FROM w_{c} WHERE {c} IS NOT NULL AND supply IS NOT NULL AND fan IS NOT NULL AND load IS NOT NULL AND d IS NOT NULL),
  s_{c} AS (SELECT sum(x0*x0) a, sum(x0*x1) b, sum(x0*x2) c, sum(x1*x1) d, sum(x1*x2) e, sum(x2*x2) f, sum(x0*y) p, sum(x1*y) q, sum(x2*y) r FROM l_{c}),
  t_{c} AS (SELECT *, a*(d*f - e*e) - b*(b*f - e*c) + c*(b*e - d*c) AS det FROM s_{c})""" for c in v.TARGETS)


@query(f"{RACKS}, {THERMAL_SQL} " + " UNION ALL ".join(f"""SELECT '{c}' AS target, {rs('(p*(d*f - e*e) - b*(q*f - e*r) + c*(q*e - d*r)) / det')} AS h_over_C,
    {rs('(a*(q*f - e*r) - p*(b*f - e*c) + c*(b*r - q*c)) / det')} AS beta_over_C,
    {rs('(a*(d*r - q*e) - b*(b*r - q*c) + p*(b*e - d*c)) / det')} AS gamma_over_C FROM t_{c}""" for c in v.TARGETS))
def thermal_ratios(spark, sf):
    rows = features.add_labels(v.racks(spark, sf), v.RACKS, v.TARGETS, 1)
    cells = [F.struct(F.lit(c).alias("target"), (F.col(f"y_{c}") - F.col(c)).alias("change"), (F.col(c) - F.col("supply")).alias("gap")) for c in v.TARGETS]
    rows = rows.select("fan", "load", F.explode(F.array(*cells)).alias("__r")).select("__r.*", "fan", "load")
    out = audit.fit_thermal_ratios(rows, "change", "gap", "fan", "load")
    return rounded(out, ["h_over_C", "beta_over_C", "gamma_over_C"], "target")
