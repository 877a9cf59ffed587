"""Fit, score and compare: the forest against persistence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.operators.evaluate import baseline_metrics, metrics, persistence_series, skill_table
from gridcast.operators.models import Forest, fit_forest, score_dataset
from gridcast.plans.dataset import KAhead
from gridcast.plans.storage import materialize
from gridcast.spec import SeriesSpec


@dataclass(frozen=True)
class Forecast:
    forest: Forest
    predictions: DataFrame
    metrics: DataFrame
    skill: DataFrame


def forecast(ds: KAhead, series: DataFrame, spec: SeriesSpec, **options) -> Forecast:
    """Fit a forest, score all splits, compare the test split with persistence.

    The baseline runs over the raw series. ``options`` go to ``fit_forest``. The
    predictions are written once, as both tables read them.
    """
    forest = fit_forest(ds, **options)
    pred = materialize(score_dataset(forest, ds, [*spec.keys, spec.ts, "split"]))
    base = persistence_series(series, spec, ds.targets, ds.k)
    test = F.col("split") == "test"
    skill = skill_table(metrics(pred.where(test)), baseline_metrics(base.where(test)))
    return Forecast(forest, pred, metrics(pred, ["split"]).orderBy("split", "target"), skill)
