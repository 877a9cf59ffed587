"""Models as Spark jobs: forest per target, registry, dense-network scoring."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyspark
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.operators.evaluate import to_long
from gridcast.operators.stats import scaler_inverse
from gridcast.plans.dataset import KAhead, compare_names
from gridcast.plans.storage import materialize
from gridcast.sources.sinks import read_if_present

_X = "__x"


def fingerprint(names: Sequence[str]) -> str:
    """SHA-256 of the ordered names joined by ``|``."""
    return hashlib.sha256("|".join(names).encode()).hexdigest()


@dataclass(frozen=True)
class Forest:
    """One forest per target and what scoring needs to know."""

    models: Mapping[str, RandomForestRegressionModel]
    features: list[str]
    targets: list[str]
    scaler: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    bounds: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    k: int = 12
    cadence_s: float | None = 10.0

    @property
    def key(self) -> str:
        return fingerprint(self.features)[:12]


def fit_forest(
    ds: KAhead,
    n_trees: int = 400,
    max_depth: int | None = None,
    min_leaf: int = 1,
    seed: int = 42,
    max_bins: int = 32,
) -> Forest:
    """A random forest per target on the training rows; every split sees all features.

    Trees are at most 30 deep, the limit of Spark's trees. The assembled rows are
    written once for all targets.
    """
    rows = VectorAssembler(inputCols=ds.features, outputCol=_X).transform(ds.split("train"))
    rows = materialize(rows.select(_X, *ds.labels))
    models = {}
    for target in ds.targets:
        label = f"y_{target}"
        models[target] = RandomForestRegressor(
            featuresCol=_X,
            labelCol=label,
            predictionCol=f"p_{target}",
            numTrees=n_trees,
            maxDepth=30 if max_depth is None else max_depth,
            minInstancesPerNode=min_leaf,
            featureSubsetStrategy="all",
            maxBins=max_bins,
            seed=seed,
        ).fit(rows)
    return Forest(models, ds.features, ds.targets, ds.scaler, ds.bounds, ds.k, ds.cadence_s)


def check_compatible(forest: Forest, features: Sequence[str], targets: Sequence[str]) -> None:
    """Ordered feature and target lists must equal those the forest was fitted on."""
    diff = compare_names(features, forest.features)
    if diff:
        raise ValueError(f"features do not match: {diff}")
    if list(targets) != list(forest.targets):
        raise ValueError(f"targets do not match: {list(targets)} != {list(forest.targets)}")


def predict(forest: Forest, rows: DataFrame) -> DataFrame:
    """Add ``p_{target}`` in the scale of the labels; extra columns pass through.

    Every row is kept: one with a missing feature gets a NULL prediction.
    """
    missing = [c for c in forest.features if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    out = VectorAssembler(inputCols=forest.features, outputCol=_X, handleInvalid="keep").transform(rows)
    for model in forest.models.values():
        out = model.transform(out)
    whole = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in forest.features], F.lit(True))
    scores = {f"p_{t}": F.when(whole, F.col(f"p_{t}")) for t in forest.models}
    return out.withColumns(scores).drop(_X)


def score_dataset(forest: Forest, ds: KAhead, keep: Sequence[str]) -> DataFrame:
    """(keep, target, y_true, y_pred) in original units for all splits."""
    out = predict(forest, ds.rows)
    if forest.scaler:
        both = {f"y_{t}": forest.scaler[f"y_{t}"] for t in ds.targets}
        both |= {f"p_{t}": forest.scaler[f"y_{t}"] for t in ds.targets}
        out = scaler_inverse(out, both, list(both))
    return to_long(out, {t: (f"y_{t}", f"p_{t}") for t in ds.targets}, keep)


def top_importance(spark: SparkSession, forest: Forest, k: int = 25) -> DataFrame:
    """(feature, importance), averaged over the targets, the k largest."""
    mean = np.mean([m.featureImportances.toArray() for m in forest.models.values()], axis=0)
    rows = [(f, float(v)) for f, v in zip(forest.features, mean)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)


def registry_row(spark: SparkSession, forest: Forest) -> DataFrame:
    """Metadata of a model as one row of a registry table."""
    pair = "struct<a:double,b:double>"
    row = (
        "forest_per_target",
        f"pyspark {pyspark.__version__}",
        forest.k,
        None if forest.cadence_s is None else float(forest.cadence_s),
        list(forest.features),
        list(forest.targets),
        dict(forest.scaler),
        dict(forest.bounds),
        fingerprint(forest.features),
        fingerprint(forest.targets),
    )
    df = spark.createDataFrame(
        [row],
        "type string, framework string, k_ahead int, cadence_s double, feature_columns array<string>, "
        f"target_columns array<string>, scaler map<string,{pair}>, bounds map<string,{pair}>, "
        "feature_fingerprint string, target_fingerprint string",
    )
    return df.withColumn("created_at", F.current_timestamp())


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """Each model under ``path/models``; the registry row last marks it complete."""
    for i, t in enumerate(forest.targets):
        forest.models[t].write().overwrite().save(f"{path}/models/{i}")
    registry_row(spark, forest).coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")


def load_forest(spark: SparkSession, path: str, allow_missing: bool = False) -> Forest | None:
    """The saved forest; a missing one is an error or, if allowed, None."""
    found = read_if_present(spark, f"{path}/registry")
    if found is None:
        if allow_missing:
            return None
        raise FileNotFoundError(f"no model at {path}")
    row = found.first()
    models = {
        t: RandomForestRegressionModel.load(f"{path}/models/{i}") for i, t in enumerate(row["target_columns"])
    }
    return Forest(
        models,
        list(row["feature_columns"]),
        list(row["target_columns"]),
        {c: tuple(p) for c, p in row["scaler"].items()},
        {c: tuple(p) for c, p in row["bounds"].items()},
        row["k_ahead"],
        row["cadence_s"],
    )


def with_optional_model(rows: DataFrame, forest: Forest | None) -> DataFrame:
    """Predictions if there is a model, else the rows as they are."""
    return rows if forest is None else predict(forest, rows)


def sample_check(forest: Forest, rows: DataFrame, n: int = 8) -> None:
    """Score a few rows: every target must get a number for each of them, also for rows with missing features."""
    cols = [f"p_{t}" for t in forest.targets]
    for r in predict(forest, rows.limit(n)).select(*cols).collect():
        if any(r[c] is None for c in cols):
            raise ValueError("a prediction is missing")


@dataclass(frozen=True)
class Dense:
    """A dense network: layer i maps x to ``x @ weights[i] + biases[i]``."""

    weights: Sequence[np.ndarray]
    biases: Sequence[np.ndarray]
    activation: str = "silu"


def _activate(x: np.ndarray, kind: str) -> np.ndarray:
    if kind == "relu":
        return np.maximum(x, 0.0)
    if kind == "silu":
        return x / (1.0 + np.exp(-x))
    if kind == "gelu":
        erf = np.frompyfunc(math.erf, 1, 1)
        return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)).astype(float))
    raise ValueError(f"unknown activation: {kind}")


def forward(net: Dense, x: np.ndarray) -> np.ndarray:
    """One batch through the network; inference, so there is no dropout."""
    for w, b in zip(net.weights[:-1], net.biases[:-1]):
        x = _activate(x @ w + b, net.activation)
    return x @ net.weights[-1] + net.biases[-1]


def dense_scorer(net: Dense) -> Callable[[Column], Column]:
    """Array of inputs to array of outputs, in Arrow batches.

    Only the input array crosses to Python; the time embedding, where used, is
    appended to it by column expressions.
    """
    if net.activation not in ("relu", "silu", "gelu"):
        raise ValueError(f"unknown activation: {net.activation}")

    @F.pandas_udf("array<double>")
    def score(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(forward(net, np.stack(x.to_numpy()).astype(float))))

    return score


def dense_predictions(
    rows: DataFrame,
    net: Dense,
    features: Sequence[str],
    targets: Sequence[str],
    embedding: Sequence[Column] = (),
) -> DataFrame:
    """Add ``p_{target}``: the network over the features and a time embedding."""
    x = F.array(*[F.col(c).cast("double") for c in features], *embedding)
    out = rows.withColumn("__y", dense_scorer(net)(x))
    return out.withColumns({f"p_{t}": F.col("__y")[i] for i, t in enumerate(targets)}).drop("__y")
