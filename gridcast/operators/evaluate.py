"""Persistence baselines and evaluation tables.

Predictions are long rows (keys, ts, target, y_true, y_pred[, split]).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.operators.align import OVERALL, with_baseline
from gridcast.operators.grid import complete_rows
from gridcast.operators.split import time_split
from gridcast.plans.chunks import POS, TOTAL, join_facts, positions, windowed
from gridcast.spec import SeriesSpec


def to_long(
    df: DataFrame, pairs: Mapping[str, tuple[str, str]], keep: Sequence[str]
) -> DataFrame:
    """Wide (true, predicted) column pairs to long prediction rows; gaps dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("target"), F.col(a).cast("double").alias("y_true"), F.col(p).cast("double").alias("y_pred"))
            for t, (a, p) in pairs.items()
        ]
    )
    return (
        df.select(*keep, F.explode(rows).alias("__r"))
        .select(*keep, "__r.*")
        .where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())
    )


def persistence_one(df: DataFrame, spec: SeriesSpec, targets: Sequence[str]) -> DataFrame:
    """Predict the previous value; rows with any missing prediction are dropped."""
    out = windowed(df, spec, [lambda w: {f"__p_{c}": F.lag(c, 1).over(w) for c in targets}], back=1)
    out = complete_rows(out, [f"__p_{c}" for c in targets])
    return to_long(out, {c: (c, f"__p_{c}") for c in targets}, [*spec.keys, spec.ts])


def persistence_in_split(
    df: DataFrame, spec: SeriesSpec, targets: Sequence[str], k: int, split: str = "split"
) -> DataFrame:
    """Predict y(t+k) by y(t) inside each split: its last k rows drop out."""
    out = windowed(
        df, spec, [lambda w: {f"__f_{c}": F.lead(c, k).over(w) for c in targets}], ahead=k, extra_keys=[split]
    )
    out = complete_rows(out, [f"__f_{c}" for c in targets])
    return to_long(out, {c: (f"__f_{c}", c) for c in targets}, [*spec.keys, spec.ts, split])


def persistence_series(
    df: DataFrame,
    spec: SeriesSpec,
    targets: Sequence[str],
    k: int,
    train: float = 0.7,
    val: float = 0.15,
) -> DataFrame:
    """Predict y(t+k) by y(t) over the whole series, split by the row of t.

    The truth may lie in the next split; the last k rows of the series drop out.
    """
    rows = time_split(df.select(*spec.keys, spec.ts, *targets), spec, train, val)
    out = windowed(rows, spec, [lambda w: {f"__f_{c}": F.lead(c, k).over(w) for c in targets}], ahead=k)
    return to_long(out, {c: (f"__f_{c}", c) for c in targets}, [*spec.keys, spec.ts, "split"])


def _error() -> Column:
    return F.col("y_true") - F.col("y_pred")


def metric_exprs(r2: bool = True) -> list[Column]:
    """MAE, RMSE and R2 (0 when the truth hardly varies) as aggregates."""
    e = _error()
    spread = F.var_pop("y_true") * F.count("y_true")
    out = [F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE")]
    if r2:
        out.append(F.when(spread < 1e-10, 0.0).otherwise(1 - F.try_divide(F.sum(e * e), spread)).alias("R2"))
    return out


def metrics(pred: DataFrame, groups: Sequence[str] = (), r2: bool = True) -> DataFrame:
    """Per target and, over all values, ``__overall__``; one table per ``groups``."""
    named = F.when(F.grouping("target") == 1, OVERALL).otherwise(F.col("target"))
    sets = [[*groups, "target"], [*groups]]
    out = pred.groupingSets(sets, *groups, "target").agg(*metric_exprs(r2), named.alias("__name"))
    return out.drop("target").withColumnRenamed("__name", "target")


def baseline_metrics(pred: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The metrics of a baseline: no R2."""
    return metrics(pred, groups, r2=False)


def skill(model: Column, base: Column) -> Column:
    """``1 - model / base``, 0 when the baseline is (nearly) perfect."""
    return F.when(base < 1e-10, 0.0).otherwise(1 - F.try_divide(model, base))


def overall_baseline(baseline: DataFrame) -> DataFrame:
    """The baseline as the skill of the overall row uses it.

    Its RMSE is the root of the mean squared per-target RMSE, its MAE the mean of
    the per-target MAE; that differs from its overall row when counts differ.
    """
    per_target = baseline.where(F.col("target") != OVERALL)
    overall = per_target.agg(
        F.avg("MAE").alias("MAE"), F.sqrt(F.avg(F.col("RMSE") * F.col("RMSE"))).alias("RMSE")
    ).withColumn("target", F.lit(OVERALL))
    return per_target.select("target", "MAE", "RMSE").unionByName(overall)


def skill_table(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics with skill_RMSE and skill_MAE against the baseline of each target."""
    joined = with_baseline(model, overall_baseline(baseline))
    return (
        joined.withColumn("skill_RMSE", skill(F.col("RMSE"), F.col("base_RMSE")))
        .withColumn("skill_MAE", skill(F.col("MAE"), F.col("base_MAE")))
        .drop("base_RMSE", "base_MAE")
    )


def per_target(table: DataFrame) -> DataFrame:
    return table.where(F.col("target") != OVERALL)


def stack_metrics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables of several splits under each other, sorted by split and target."""
    parts = [t.withColumn("split", F.lit(name)) for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("split", "target")


def residuals(pred: DataFrame) -> DataFrame:
    return pred.withColumn("residual", _error())


def residual_stats(pred: DataFrame) -> DataFrame:
    """Mean and population std of the residuals per target."""
    return residuals(pred).groupBy("target").agg(
        F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std")
    )


def residual_histogram(pred: DataFrame, bins: int = 50) -> DataFrame:
    """(target, bin, n): equal bins from min to max, the last one closed.

    A constant residual gets the range ± 0.5. Ranges are one row per target.
    """
    rows = residuals(pred).select("target", "residual")
    spans = rows.groupBy("target").agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spans = spans.select(
        "target",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    slot = F.width_bucket(F.col("residual"), F.col("lo"), F.col("hi"), F.lit(bins))
    return (
        join_facts(rows, spans, ["target"], ["residual"])
        .withColumn("bin", F.least(slot, F.lit(bins)).cast("int"))
        .groupBy("target", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def downsample(df: DataFrame, spec: SeriesSpec, points: int = 500) -> DataFrame:
    """At most ``points`` evenly spaced rows per entity, the first and last among them.

    Row ``int(i * (n-1)/(points-1))`` for each i; shorter series stay whole. A row
    is kept if some i leads to it, which is decided from its own position.
    """
    if points < 2:
        raise ValueError("points must be at least 2")
    pos, n = F.col(POS), F.col(TOTAL)
    step = (n - 1).cast("double") / F.lit(float(points - 1))
    i = F.ceil(pos / step)
    hit = F.lit(False)
    for near in (i - 1, i, i + 1):
        hit = hit | (near.between(0, points - 2) & (F.floor(near * step) == pos))
    kept = positions(df, spec).where((n <= points) | (pos == n - 1) | hit)
    return kept.drop(POS, TOTAL)


def horizon_metrics(
    rollout: DataFrame,
    horizons: Sequence[int] = (10, 30, 60, 90),
    scenario: Sequence[str] = ("scenario_id",),
    groups: Sequence[str] = (),
) -> DataFrame:
    """(horizon, mae, rmse, drift) over the steps before each horizon.

    Rows are (scenario, target, step, y_true, y_pred). Drift is the distance of
    the prediction from the truth at step 0; a scenario without that truth counts
    for the errors and not for the drift. Horizons beyond the data are left out.
    A scenario is gathered into one row of the steps below the largest horizon, which
    bounds it, so its start needs no join.
    """
    step = F.struct("step", "y_true", "y_pred")
    by = list(dict.fromkeys([*groups, *scenario, "target"]))
    lists = rollout.groupBy(*by).agg(
        F.max("step").alias("last"), F.collect_list(F.when(F.col("step") < max(horizons), step)).alias("steps")
    )
    return horizon_table(lists, horizons, groups)


def horizon_table(scenarios: DataFrame, horizons: Sequence[int], groups: Sequence[str] = ()) -> DataFrame:
    """The table of ``horizon_metrics`` from one row per scenario and target:
    ``steps``, an array of (step, y_true, y_pred), and ``last``, the largest step there is."""
    start = F.get(F.filter("steps", lambda s: s["step"] == 0), F.lit(0))["y_true"]
    rows = scenarios.select(*groups, F.col("last").alias("__last"), start.alias("__start"), F.explode_outer("steps").alias("__s"))
    step, pred = F.col("__s.step"), F.col("__s.y_pred")
    e = pred - F.col("__s.y_true")
    drift = F.abs(pred - F.col("__start"))
    aggs = [F.max("__last").alias("__last")]
    for h in horizons:
        early = step < h
        aggs += [
            F.avg(F.when(early, F.abs(e))).alias(f"mae{h}"),
            F.sqrt(F.avg(F.when(early, e * e))).alias(f"rmse{h}"),
            F.avg(F.when(early, drift)).alias(f"drift{h}"),
        ]
    wide = rows.groupBy(*groups).agg(*aggs)
    table = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.col(f"mae{h}").alias("mae"), F.col(f"rmse{h}").alias("rmse"), F.col(f"drift{h}").alias("drift"))
            for h in horizons
        ]
    )
    return (
        wide.select(*groups, "__last", F.explode(table).alias("__h"))
        .where(F.col("__h.horizon") <= F.col("__last") + 1)
        .select(*groups, "__h.*")
    )


def default_horizons(n_steps: int) -> tuple[int, ...]:
    return (10, 30, 60, 90) if n_steps >= 90 else (10, 20, 30)


def constant_futures(series: DataFrame, spec: SeriesSpec, targets: Sequence[str], n_steps: int) -> DataFrame:
    """(keys, ts, target, steps, last): the constant rollout from every row, with what came after it.

    Step i is the value i + 1 grid steps later; steps without a value are left out, and
    so are rows without a value of the target. The future of a row is an array from one
    window over the chunk and its halo: no row is copied for its steps, nothing is joined.
    Gaps of the grid may stay, as the window goes by the grid index.
    """

    def stage(w: WindowSpec) -> dict[str, Column]:
        ahead = w.rangeBetween(1, n_steps)
        return {
            f"__f_{c}": F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("at"), F.col(c).alias("v")))).over(ahead)
            for c in targets
        }

    rows = series.select(*spec.keys, spec.ts, *targets).withColumn(POS, spec.index())
    laid = windowed(rows, spec, [stage], ahead=n_steps)

    def future(c: str) -> Column:
        row = F.transform(
            f"__f_{c}", lambda s: F.struct((s["at"] - F.col(POS) - 1).alias("step"), s["v"].alias("y_true"), F.col(c).alias("y_pred"))
        )
        return F.struct(F.lit(c).alias("target"), F.col(c).alias("y_pred"), row.alias("steps"))

    each = laid.select(*spec.keys, spec.ts, F.explode(F.array(*[future(c) for c in targets])).alias("__r")).where("__r.y_pred IS NOT NULL")
    last = F.array_max(F.transform("__r.steps", lambda s: s["step"]))
    return each.select(*spec.keys, spec.ts, "__r.target", "__r.steps", last.alias("last"))


def relative_change(table: DataFrame, baseline: DataFrame) -> DataFrame:
    """Improvement over the baseline's MAE in percent; negative is worse."""
    return with_baseline(table, baseline).select(
        "target",
        "MAE",
        "base_MAE",
        F.try_divide(100 * (F.col("base_MAE") - F.col("MAE")), F.col("base_MAE")).alias("change_pct"),
        F.when(F.col("MAE") < F.col("base_MAE"), "better").otherwise("worse").alias("verdict"),
    )
