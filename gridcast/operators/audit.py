"""Physics and control audits over prediction tables.

Long prediction rows (keys, ts, target, y_pred, ...) go in; scores per target
and, in the row ``__overall__``, over all of them come out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.scalars import clamp, softplus
from gridcast.operators.align import OVERALL
from gridcast.plans.chunks import windowed
from gridcast.spec import SeriesSpec

# Weights of the score terms in the three training phases.
PHASE_WEIGHTS = {
    "stabilize": {"data": 1.0, "teacher": 0.2, "physics": 0.0, "monotonic": 0.0, "smoothness": 0.05},
    "physics_on": {"data": 1.0, "teacher": 0.1, "physics": 0.5, "monotonic": 0.1, "smoothness": 0.05},
    "control_ready": {"data": 1.0, "teacher": 0.05, "physics": 0.5, "monotonic": 0.2, "smoothness": 0.05},
}
TERMS = ("data", "teacher", "physics", "monotonic", "smoothness")


@dataclass(frozen=True)
class Thermal:
    """Coefficients of one target: capacity C, transfer h, cooling beta, load gamma."""

    C: float
    h: float
    beta: float
    gamma: float


def thermal_parameters(raw: DataFrame) -> DataFrame:
    """(target, C, h, beta, gamma), each made positive by softplus."""
    return raw.withColumns({c: softplus(F.col(c)) for c in ("C", "h", "beta", "gamma")})


def by_target(df: DataFrame, *aggregates: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Aggregate per target and overall."""
    named = F.when(F.grouping("target") == 1, OVERALL).otherwise(F.col("target"))
    out = df.groupingSets([[*groups, "target"], [*groups]], *groups, "target").agg(
        *aggregates, named.alias("__name")
    )
    return out.drop("target").withColumnRenamed("__name", "target")


def physics_drivers(
    columns: Sequence[str], supply: str, actuator: str, load: str | None, window: int = 12
) -> dict[str, str | None]:
    """Which columns drive the physics: the rolling mean if built, else the base."""

    def choose(base: str, required: bool) -> str | None:
        for name in (f"{base}_roll{window}_mean", base):
            if name in columns:
                return name
        if required:
            raise ValueError(f"driver column not found: {base}")
        return None

    return {
        "supply_air": choose(supply, True),
        "cooling_actuator": choose(actuator, True),
        "load_proxy": choose(load, False) if load else None,
    }


def expected_change(
    temperature: Column,
    supply: Column,
    actuator: Column,
    load: Column | None,
    coefficients: Mapping[str, Column],
    dt: float = 10.0,
    window: int = 12,
) -> Column:
    """``[-h (T - T_supply) + beta u + gamma Q] / C * dt * window``.

    beta enters with a plus sign, so a positive beta heats; that is the formula.
    """
    rate = -coefficients["h"] * (temperature - supply) + coefficients["beta"] * actuator
    if load is not None:
        rate = rate + coefficients["gamma"] * load
    return rate / coefficients["C"] * F.lit(float(dt)) * F.lit(window)


def coefficient_columns(thermal: Mapping[str, Thermal]) -> dict[str, Column]:
    """Coefficients of a row's target as literals; a target without any is an error."""
    unknown = F.raise_error(F.concat(F.lit("no coefficients for target: "), F.coalesce("target", F.lit("NULL"))))
    out = {}
    for field in ("C", "h", "beta", "gamma"):
        pairs = [x for t, c in thermal.items() for x in (F.lit(t), F.lit(float(getattr(c, field))))]
        out[field] = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("target")), unknown.cast("double"))
    return out


def physics_residual(
    pred: DataFrame,
    thermal: Mapping[str, Thermal],
    supply: str,
    actuator: str,
    load: str | None,
    now: str = "y_now",
    dt: float = 10.0,
    window: int = 12,
) -> DataFrame:
    """(target, physics): mean squared gap of predicted and expected change.

    ``now`` is the temperature at t; the change is counted from it.
    """
    expected = expected_change(
        F.col(now), F.col(supply), F.col(actuator), F.col(load) if load else None,
        coefficient_columns(thermal), dt, window,
    )
    gap = (F.col("y_pred") - F.col(now)) - expected
    return by_target(pred, F.avg(gap * gap).alias("physics"))


def perturbed_scores(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    scorer: Callable[[Column], Column],
    actuator: str,
    eps: float = 0.01,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score every row as it is and with the actuator raised by ``eps``.

    ``scorer`` maps an array of features to an array of target values. Only the
    actuator column moves, not its lags. Gives (keep, target, y_pred, y_up).
    """
    if actuator not in features:
        raise ValueError(f"actuator not among the features: {actuator}")
    plain = F.array(*[F.col(c).cast("double") for c in features])
    raised = F.array(
        *[F.col(c).cast("double") + (F.lit(eps) if c == actuator else F.lit(0.0)) for c in features]
    )
    both = F.arrays_zip(
        F.array(*[F.lit(t) for t in targets]).alias("target"),
        scorer(plain).alias("y_pred"),
        scorer(raised).alias("y_up"),
    )
    return df.select(*keep, F.explode(both).alias("__s")).select(
        *keep, F.col("__s.target").alias("target"), F.col("__s.y_pred").alias("y_pred"), F.col("__s.y_up").alias("y_up")
    )


def monotonic_penalty(scored: DataFrame, eps: float = 0.01, kind: str = "relu") -> DataFrame:
    """(target, monotonic, violations): more cooling must not heat."""
    slope = (F.col("y_up") - F.col("y_pred")) / F.lit(float(eps))
    over = F.greatest(slope, F.lit(0.0))
    if kind == "quadratic":
        over = over * over
    elif kind != "relu":
        raise ValueError(f"unknown penalty: {kind}")
    return by_target(
        scored, F.avg(over).alias("monotonic"), F.avg((slope > 0).cast("double")).alias("violations")
    )


def smoothness(
    pred: DataFrame, spec: SeriesSpec, order: int = 1, reduction: str = "mean", column: str = "y_pred"
) -> DataFrame:
    """(target, smoothness): squared first or second differences in time order.

    0 where a series is too short to have a difference.
    """
    if order not in (1, 2):
        raise ValueError("order must be 1 or 2")
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    series = spec.replace(keys=(*spec.keys, "target"), gap_free=False)

    def stage(w):
        one = F.lag(column, 1).over(w)
        if order == 1:
            return {"__d": F.col(column) - one}
        return {"__d": F.col(column) - 2 * one + F.lag(column, 2).over(w)}

    rows = windowed(pred, series, [stage], back=order)
    square = F.col("__d") * F.col("__d")
    total = F.avg(square) if reduction == "mean" else F.sum(square)
    return by_target(rows, F.coalesce(total, F.lit(0.0)).alias("smoothness"))


def prediction_mse(pred: DataFrame, other: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """(target, mse) between two prediction tables, paired by entity, time, target."""
    b = other.select(*keys, ts, "target", F.col("y_pred").alias("__other"))
    gap = F.col("y_pred") - F.col("__other")
    return by_target(pred.join(b, [*keys, ts, "target"]), F.avg(gap * gap).alias("mse"))


def total_score(
    terms: DataFrame, weights: Mapping[str, Mapping[str, float]] = PHASE_WEIGHTS
) -> DataFrame:
    """Weighted sum of the terms per phase, next to the terms.

    ``terms`` has the columns data, teacher, physics, monotonic, smoothness; a
    missing term counts as 0.
    """
    phases = F.array(
        *[
            F.struct(F.lit(p).alias("phase"), *[F.lit(float(w.get(t, 0.0))).alias(f"w_{t}") for t in TERMS])
            for p, w in weights.items()
        ]
    )
    have = [t for t in TERMS if t in terms.columns]
    total = sum((F.col(f"__w.w_{t}") * F.coalesce(F.col(t), F.lit(0.0)) for t in have), F.lit(0.0))
    return terms.withColumn("__w", F.explode(phases)).select(
        *terms.columns, F.col("__w.phase").alias("phase"), total.alias("total")
    )


def setpoint_kpi(df: DataFrame, groups: Sequence[str], value: str, target: float | Column) -> DataFrame:
    """Reward (minus the mean distance from the set point, perhaps a column), mean, max, min per group."""
    c = F.col(value)
    target = target if isinstance(target, Column) else F.lit(float(target))
    return df.groupBy(*groups).agg(
        (-F.avg(F.abs(c - target))).alias("reward"),
        F.avg(c).alias("mean_temp"),
        F.max(c).alias("max_temp"),
        F.min(c).alias("min_temp"),
    )


def clamp_actuator(df: DataFrame, col: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    return df.withColumn(col, clamp(F.col(col), low, high))


def fit_thermal_ratios(
    df: DataFrame, change: str, gap: str, actuator: str, load: str, groups: Sequence[str] = ("target",)
) -> DataFrame:
    """Least squares of the change per second on (T - T_supply, u, Q) per target.

    Gives h/C, beta/C, gamma/C; only these ratios can be told apart. The sums of
    products are taken by Spark in one pass, the 3 x 3 system is solved by
    Cramer's rule. NULL where the drivers are collinear.
    """
    x = [-F.col(gap), F.col(actuator), F.col(load)]
    y = F.col(change)
    whole = df.where(sum((c.isNull().cast("int") for c in [*x, y]), F.lit(0)) == 0)
    sums = whole.groupBy(*groups).agg(
        *[F.sum(x[i] * x[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.sum(x[i] * y).alias(f"b{i}") for i in range(3)],
    )
    m = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    rhs = [F.col(f"b{i}") for i in range(3)]

    def det(a) -> Column:
        return (
            a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
            - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
            + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
        )

    def with_rhs(k: int):
        return [[rhs[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]

    names = ("h_over_C", "beta_over_C", "gamma_over_C")
    return sums.select(
        *groups, *[F.try_divide(det(with_rhs(k)), det(m)).alias(n) for k, n in enumerate(names)]
    )
