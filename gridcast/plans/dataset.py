"""The k-ahead training set: features, labels, split, train-only statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.features import LAGS, ROLLS, feature_names, supervised
from gridcast.operators.split import time_split
from gridcast.operators.stats import pooled, scaler_transform, winsor_bounds, winsorize
from gridcast.plans.storage import materialize
from gridcast.spec import SeriesSpec


@dataclass(frozen=True)
class KAhead:
    """``rows``: keys, ts, features, ``y_*`` labels and ``split``; lazy.

    ``bounds`` and ``scaler`` are what was fitted on the training rows.
    """

    rows: DataFrame
    features: list[str]
    targets: list[str]
    bounds: Mapping[str, tuple[float, float]]
    scaler: Mapping[str, tuple[float, float]]
    k: int
    cadence_s: float | None

    @property
    def labels(self) -> list[str]:
        return [f"y_{t}" for t in self.targets]

    def split(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name)

    def counts(self) -> DataFrame:
        """Rows per split, with the sizes of both column lists."""
        return self.rows.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"),
            F.lit(len(self.features)).alias("n_features"),
            F.lit(len(self.targets)).alias("n_targets"),
            F.lit(self.k).alias("k_ahead"),
        )


@dataclass(frozen=True)
class NameDiff:
    """How one ordered list of names departs from another; false if it does not."""

    first: int | None  # first place that holds another name
    absent: tuple[str, ...]
    surplus: tuple[str, ...]
    repeated: tuple[str, ...]

    def __bool__(self) -> bool:
        return self.first is not None

    def __str__(self) -> str:
        parts = [("absent", self.absent), ("surplus", self.surplus), ("repeated", self.repeated)]
        told = [f"{what}: {', '.join(names)}" for what, names in parts if names]
        return f"from place {self.first} on" + "".join(f"; {t}" for t in told)


def compare_names(have: Sequence[str], want: Sequence[str]) -> NameDiff:
    """Compare two lists of names in order."""
    first = next((i for i, (a, b) in enumerate(zip_longest(have, want)) if a != b), None)
    count = Counter(have)
    return NameDiff(
        first,
        tuple(n for n in dict.fromkeys(want) if n not in count),
        tuple(n for n in count if n not in set(want)),
        tuple(n for n, c in count.items() if c > 1),
    )


def prepare_k_ahead(
    df: DataFrame,
    spec: SeriesSpec,
    base: Sequence[str],
    targets: Sequence[str],
    lags: Sequence[int] = LAGS,
    rolls: Sequence[int] = ROLLS,
    k: int = 12,
    train: float = 0.7,
    val: float = 0.15,
    winsor: tuple[float, float] | None = (0.01, 0.99),
    low_variance: float = 1e-8,
    normalize: bool = True,
    expected: Sequence[str] | None = None,
) -> KAhead:
    """Build, split, then fit on train and apply to all splits.

    The complete rows are written once, as the split, the bounds, the variance
    filter, the scaler and the result all read them. Bounds need one pass over
    the training rows; variances and target statistics share another.
    """
    names, labels = feature_names(base, lags, rolls), [f"y_{t}" for t in targets]
    ds = materialize(supervised(df, spec, base, targets, lags, rolls, k))
    # complete rows have gaps, so positions must be counted from here on
    rows = time_split(ds, spec.replace(gap_free=False), train, val)
    on_train = rows.where(F.col("split") == "train")

    bounds: dict[str, tuple[float, float]] = {}
    if winsor is not None:
        bounds = pooled(winsor_bounds(on_train, names, *winsor))
        # bounds of an all-missing column clip nothing
        bounds = {c: b for c, b in bounds.items() if None not in b}
        rows = winsorize(rows, bounds)
        on_train = rows.where(F.col("split") == "train")

    fitted = on_train.agg(
        *[F.var_pop(c).alias(c) for c in names],
        *[F.avg(y).alias(f"{y}__m") for y in labels],
        *[F.stddev_pop(y).alias(f"{y}__s") for y in labels],
    ).first()
    keep = [c for c in names if fitted[c] is not None and fitted[c] >= low_variance]
    if expected is not None and (diff := compare_names(keep, expected)):
        raise ValueError(f"feature columns do not match: {diff}")

    scaler: dict[str, tuple[float, float]] = {}
    if normalize:
        if any(fitted[f"{y}__m"] is None for y in labels):
            raise ValueError("no training rows to fit the targets on")
        scaler = {
            y: (fitted[f"{y}__m"], 1.0 if fitted[f"{y}__s"] < 1e-8 else fitted[f"{y}__s"])
            for y in labels
        }
        rows = scaler_transform(rows, scaler, labels)
    rows = rows.select(*spec.keys, spec.ts, "split", *keep, *labels)
    return KAhead(rows, keep, list(targets), bounds, scaler, k, spec.step_s)


def feature_arrays(ds: KAhead) -> DataFrame:
    """The dataset as float32 arrays: (keys, ts, split, X, y)."""
    other = [c for c in ds.rows.columns if c not in ds.features and c not in ds.labels]
    return ds.rows.select(
        *other,
        F.array(*ds.features).cast("array<float>").alias("X"),
        F.array(*ds.labels).cast("array<float>").alias("y"),
    )
