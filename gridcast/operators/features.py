"""Lag, rolling and delta features, future labels, time embeddings."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from gridcast.operators.grid import complete_rows
from gridcast.plans.chunks import POS, positions, windowed
from gridcast.spec import SeriesSpec

# Default lags, rolling windows and statistics of the feature family.
LAGS = (1, 3, 6, 12)
ROLLS = (3, 6, 12)
ROLL_KINDS = ("mean", "std", "delta")

_LAG_NAME = re.compile(r"(.+)_lag(\d+)")
_ROLL_NAME = re.compile(r"(.+)_roll(\d+)_(mean|std|delta)")


def feature_names(
    base: Sequence[str], lags: Sequence[int] = LAGS, rolls: Sequence[int] = ROLLS
) -> list[str]:
    """Canonical order: base, lags by column, then mean / std / delta by window."""
    names = [
        *base,
        *(f"{c}_lag{n}" for c in base for n in lags),
        *(f"{c}_roll{n}_{kind}" for c in base for n in rolls for kind in ROLL_KINDS),
    ]
    return list(dict.fromkeys(names))


def lag_expr(c: str, n: int, w: WindowSpec) -> Column:
    return F.lag(c, n).over(w)


def roll_expr(c: str, n: int, kind: str, w: WindowSpec) -> Column:
    """A rolling statistic; mean and std need ``n`` values present in the window."""
    if kind == "delta":
        return F.col(c) - F.lag(c, n).over(w)
    frame = w.rowsBetween(-(n - 1), 0)
    stat = F.avg(c) if kind == "mean" else F.stddev_pop(c)
    return F.when(F.count(c).over(frame) == n, stat.over(frame))


def feature_expr(name: str, columns: Sequence[str], w: WindowSpec) -> Column | None:
    """The expression behind a feature name, or None if its base is unknown."""
    if name in columns:
        return F.col(name)
    if (m := _LAG_NAME.fullmatch(name)) and m[1] in columns:
        return lag_expr(m[1], int(m[2]), w)
    if (m := _ROLL_NAME.fullmatch(name)) and m[1] in columns:
        return roll_expr(m[1], int(m[2]), m[3], w)
    return None


def reach(names: Sequence[str]) -> int:
    """How many rows back the named features look."""
    back = 0
    for name in names:
        if m := _LAG_NAME.fullmatch(name):
            back = max(back, int(m[2]))
        elif m := _ROLL_NAME.fullmatch(name):
            back = max(back, int(m[2]))
    return back


def _require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def _with_named(df: DataFrame, spec: SeriesSpec, names: Sequence[str]) -> DataFrame:
    columns = df.columns
    new = [n for n in names if n not in columns]
    stage = lambda w: {n: feature_expr(n, columns, w) for n in new}
    return windowed(df, spec, [stage], back=reach(new)) if new else df


def add_lags(
    df: DataFrame, spec: SeriesSpec, cols: Sequence[str], lags: Sequence[int] = LAGS
) -> DataFrame:
    """``{c}_lag{n}`` for each column and lag; also used for target lags."""
    _require(df, cols)
    return _with_named(df, spec, [f"{c}_lag{n}" for c in cols for n in lags])


def add_rolls(
    df: DataFrame,
    spec: SeriesSpec,
    cols: Sequence[str],
    windows: Sequence[int] = ROLLS,
    kinds: Sequence[str] = ROLL_KINDS,
) -> DataFrame:
    """``{c}_roll{n}_mean|std|delta``; std is the population one."""
    _require(df, cols)
    return _with_named(
        df, spec, [f"{c}_roll{n}_{kind}" for c in cols for n in windows for kind in kinds]
    )


def label_stage(targets: Sequence[str], k: int):
    return lambda w: {f"y_{c}": (F.lead(c, k).over(w) if k else F.col(c)) for c in targets}


def add_labels(
    df: DataFrame,
    spec: SeriesSpec,
    targets: Sequence[str],
    k: int,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """``y_{target}`` = the target ``k`` rows later."""
    if k < 0:
        raise ValueError("k must be >= 0")
    _require(df, targets)
    return windowed(df, spec, [label_stage(targets, k)], ahead=k, extra_keys=extra_keys)


def official_features(
    df: DataFrame,
    spec: SeriesSpec,
    base: Sequence[str],
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    bounds: dict[str, tuple[float, float]] | None = None,
    keep: Sequence[str] | None = None,
    dropna: bool = True,
    targets: Sequence[str] = (),
) -> DataFrame:
    """The exogenous feature table: keys, ts and the features in canonical order.

    ``bounds`` clips, ``keep`` filters columns; lags of a target are refused.
    """
    from gridcast.operators.stats import clip

    _require(df, base)
    names = feature_names(base, lags, rolls)
    out = _with_named(df, spec, names)
    if keep is not None:
        names = [c for c in keep if c in names]
    leaks = [n for n in names if (m := _LAG_NAME.fullmatch(n)) and m[1] in targets]
    if leaks:
        raise ValueError(f"target lags are not allowed here: {leaks}")
    shown = [F.col(n) if not bounds or n not in bounds else clip(F.col(n), *bounds[n]).alias(n) for n in names]
    out = out.select(*spec.keys, spec.ts, *shown)
    return complete_rows(out, names) if dropna else out


def supervised(
    df: DataFrame,
    spec: SeriesSpec,
    base: Sequence[str],
    targets: Sequence[str],
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    k: int = 1,
    target_lags: Sequence[int] = (),
    dropna: bool = True,
) -> DataFrame:
    """X(t) and ``y_{target}`` = y(t+k) from one pass over the series.

    Features look back, labels look ahead; both share one exchange and one sort.
    Only the base columns are shuffled, the features are built after it.
    """
    if k < 0:
        raise ValueError("k must be >= 0")
    _require(df, [*base, *targets])
    names = feature_names(base, lags, rolls) + [f"{c}_lag{n}" for c in targets for n in target_lags]
    columns = df.columns
    new = [n for n in names if n not in columns]

    def stage(w: WindowSpec) -> dict[str, Column]:
        return {n: feature_expr(n, columns, w) for n in new} | label_stage(targets, k)(w)

    source = df.select(*dict.fromkeys([*spec.keys, spec.ts, *base, *targets]))
    out = windowed(source, spec, [stage], back=reach(new), ahead=k)
    labels = [f"y_{c}" for c in targets]
    out = out.select(*spec.keys, spec.ts, *names, *labels)
    return complete_rows(out, [*names, *labels]) if dropna else out


def features_from_list(df: DataFrame, spec: SeriesSpec, names: Sequence[str]) -> DataFrame:
    """Build only the named features; names with an unknown base are skipped.

    Columns that exist already are passed through, and the order is kept.
    """
    columns = df.columns
    known = [
        n
        for n in names
        if n in columns
        or ((m := _LAG_NAME.fullmatch(n) or _ROLL_NAME.fullmatch(n)) and m[1] in columns)
    ]
    return _with_named(df, spec, known).select(*spec.keys, spec.ts, *known)


def time_index(df: DataFrame, spec: SeriesSpec, out: str = "t_idx") -> DataFrame:
    """0-based row number per entity (add the split to the keys for one per split)."""
    return positions(df, spec).drop("__total").withColumnRenamed(POS, out)


def fourier_time(t: Column, n_freqs: int = 16) -> list[Column]:
    """cos then sin of ``2 pi t f``, f log-spaced from 1e-3 to 1e3, in double."""
    freqs = [10.0 ** (-3 + 6 * i / (n_freqs - 1)) if n_freqs > 1 else 1e-3 for i in range(n_freqs)]
    angles = [F.lit(2 * math.pi) * t * F.lit(f) for f in freqs]
    return [F.cos(a).alias(f"t_cos{i}") for i, a in enumerate(angles)] + [
        F.sin(a).alias(f"t_sin{i}") for i, a in enumerate(angles)
    ]


def sinusoidal_time(t: Column, dim: int = 32, max_period: float = 10000.0) -> list[Column]:
    """sin then cos of ``t * max_period^(-i/half)``; an odd ``dim`` is zero-padded."""
    half = dim // 2
    angles = [t * F.lit(math.exp(-math.log(max_period) * i / half)) for i in range(half)]
    cols = [F.sin(a) for a in angles] + [F.cos(a) for a in angles]
    if dim % 2:
        cols.append(F.lit(0.0))
    return [c.alias(f"t_emb{i}") for i, c in enumerate(cols)]


def time_embedding(t: Column, method: str = "fourier", n_freqs: int = 16, dim: int = 32) -> list[Column]:
    if method == "fourier":
        return fourier_time(t, n_freqs)
    if method == "sinusoidal":
        return sinusoidal_time(t, dim)
    raise ValueError(f"unknown time embedding: {method}")
