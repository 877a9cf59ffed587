"""Rollouts over scenario tables: rows (scenario, step, inputs)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.plans.chunks import POS, running_sum, salted_join
from gridcast.spec import SeriesSpec, floor_div


def edit_scenario(
    df: DataFrame,
    column: str,
    value: float,
    first: int,
    stop: int,
    when: Column | None = None,
) -> DataFrame:
    """Set an input for the steps ``first <= step < stop`` of the chosen scenarios."""
    hit = F.col("step").between(first, stop - 1)
    if when is not None:
        hit = hit & when
    return df.withColumn(column, F.when(hit, F.lit(float(value))).otherwise(F.col(column)))


def affine_scan(
    df: DataFrame,
    initial: DataFrame,
    keys: Sequence[str],
    step: str,
    a: str,
    b: str,
    start: str,
    out: str,
    block: int = 256,
    levels: int = 2,
) -> DataFrame:
    """State after each step of ``s' = a s + b``, from ``start`` (one row per key).

    A block of steps is itself such a map, so blocks are composed first, the
    states entering them are found the same way one level up, and every block
    then runs on its own. No task sees more than ``block`` rows of a series,
    but for the top one: it has rows / block^levels.
    """
    carried = [c for c in df.columns if c not in keys]
    entered = _enter(
        df.select(*keys, F.struct(step, a, b, *[c for c in carried if c not in (step, a, b)]).alias("__x")),
        initial, keys, step, a, b, start, block, levels,
    )
    x = F.col("__x")
    return entered.select(
        *keys, *[x[c].alias(c) for c in carried], (x[a] * F.col("__s") + x[b]).alias(out)
    )


def _enter(rows, initial, keys, step, a, b, start, block, levels) -> DataFrame:
    """(keys, __x, __s): the state before each row."""
    steps = F.sort_array(F.collect_list(F.struct(F.col(f"__x.{step}").alias("__o"), F.col("__x")))).alias("__steps")
    if levels == 0:
        blocks = rows.groupBy(*keys).agg(steps)
        entering = initial.select(*keys, F.col(start).cast("double").alias("__s"))
        ready = blocks.join(entering, list(keys))
    else:
        blocks = rows.groupBy(*keys, floor_div(F.col(f"__x.{step}"), block).alias("__blk")).agg(steps)
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        whole = F.aggregate(
            F.col("__steps"),
            one,
            lambda m, r: F.struct(
                (r["__x"][a] * m["a"]).alias("a"), (r["__x"][a] * m["b"] + r["__x"][b]).alias("b")
            ),
        )
        maps = blocks.select(*keys, F.struct(F.col("__blk").alias("o"), whole["a"].alias("a"), whole["b"].alias("b")).alias("__x"))
        above = _enter(maps, initial, keys, "o", "a", "b", start, block, levels - 1)
        ready = blocks.join(above.select(*keys, F.col("__x.o").alias("__blk"), "__s"), [*keys, "__blk"])
    state = F.struct(F.col("__s").alias("s"), F.array().cast("array<double>").alias("seen"))
    before = F.aggregate(
        F.col("__steps"),
        state,
        lambda acc, r: F.struct(
            (r["__x"][a] * acc["s"] + r["__x"][b]).alias("s"),
            F.concat(acc["seen"], F.array(acc["s"])).alias("seen"),
        ),
    )["seen"]
    return ready.select(*keys, F.explode(F.arrays_zip(F.col("__steps"), before.alias("before"))).alias("__z")).select(
        *keys, F.col("__z.__steps.__x").alias("__x"), F.col("__z.before").alias("__s")
    )


def rc_rollout(
    inputs: DataFrame,
    initial: DataFrame,
    scenario: Sequence[str] = ("scenario_id",),
    step: str = "step",
    power: str = "power",
    fan: str = "fan",
    ambient: str = "ambient",
    start: str = "t0",
    dt: float = 1.0,
    C: float = 100.0,
    h: float = 0.05,
    beta: float = -0.03,
    gamma: float = 0.001,
    block: int = 256,
    levels: int = 2,
) -> DataFrame:
    """Lumped thermal response: ``T += dt (gamma P + beta Fan - h (T - T_amb)) / C``.

    ``initial`` has one starting temperature per scenario, or per scenario and
    ``target``. beta is added, so cooling needs a negative one.
    """
    keys = list(scenario)
    rows = inputs
    if "target" in initial.columns:
        rows = salted_join(inputs, initial.select(*keys, "target"), keys, [step])
        keys.append("target")
    drive = F.lit(gamma) * F.col(power) + F.lit(beta) * F.col(fan) + F.lit(h) * F.col(ambient)
    rows = rows.withColumn("__a", F.lit(1.0 - h * dt / C)).withColumn("__b", drive * F.lit(dt / C))
    out = affine_scan(rows, initial, keys, step, "__a", "__b", start, "y_pred", block, levels)
    return out.drop("__a", "__b")


def cumulative_rollout(
    deltas: DataFrame,
    initial: DataFrame,
    scenario: Sequence[str] = ("scenario_id",),
    scaler: Mapping[str, tuple[float, float]] | None = None,
    chunk_rows: int = 4096,
) -> DataFrame:
    """Running sum of scored changes from the initial state, then inverse scaling.

    Rows (scenario, target, step, delta); ``initial`` has (scenario, target, t0).
    """
    keys = [*scenario, "target"]
    spec = SeriesSpec(tuple(keys), "step", chunk_rows=chunk_rows)
    summed = running_sum(deltas.withColumn(POS, F.col("step").cast("long")), spec, {"__sum": "delta"}).drop(POS)
    out = salted_join(summed, initial.select(*keys, "t0"), keys, ["step"])
    state = F.col("t0") + F.col("__sum")
    if scaler is not None:
        facts = [x for t, (m, s) in scaler.items() for x in (F.lit(t), F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")))]
        fact = F.create_map(*facts)[F.col("target")]
        state = state * fact["s"] + fact["m"]
    return out.withColumn("y_pred", state).drop("__sum", "t0")


def constant_rollout(scored: DataFrame, n_steps: int) -> DataFrame:
    """A model that sees fixed features: the same prediction at each step."""
    return scored.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))))


def compare_rollouts(models: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per (keys, target, step) with a column for each model."""
    rows = None
    cols = [*keys, "target", "step"]
    for name, df in models.items():
        part = df.select(*cols, F.lit(name).alias("model"), F.col("y_pred").cast("double").alias("y_pred"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*cols).agg(
        *[F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    )


def absolute_prediction(score: Column, now: Column, mode: str) -> Column:
    """A score as a temperature: as it is, or added to the current one."""
    if mode == "absolute":
        return score
    if mode == "delta":
        return now + score
    raise ValueError(f"unknown mode: {mode}")
