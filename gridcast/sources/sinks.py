"""Writing merged tables, fitted statistics, metric tables and predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_merged(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    formats: Sequence[str] = ("parquet", "csv"),
) -> None:
    """The table under ``path/parquet`` and ``path/csv``.

    The plan of ``df`` runs once: a second format is written from the Parquet table.
    With partition columns the rows are first brought together by them; the
    rebalance splits a partition that holds far more than the others.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    if "parquet" in formats:
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/parquet")
        rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/parquet").select(*df.columns)
    if "csv" in formats:
        rows.write.mode("overwrite").partitionBy(*partition_by).option("header", True).csv(f"{path}/csv")


def write_stats(stats: DataFrame, path: str) -> None:
    """Fitted statistics (bounds, scaler, split, spec) as JSON lines, in parallel: one row per entity may be many."""
    stats.write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table (a few rows) as one CSV file with a header; what computes it stays parallel."""
    metrics.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def dataset_spec(
    spark: SparkSession, rule: str, features: Sequence[str], targets: Sequence[str], notes: Sequence[str] = ()
) -> DataFrame:
    """What a merged table holds, as one row."""
    row = (rule, list(features), list(targets), [f"{t}_z" for t in targets], list(notes))
    return spark.createDataFrame(
        [row],
        "resample_rule string, feature_cols array<string>, target_cols_raw array<string>, "
        "target_cols_normalized array<string>, notes array<string>",
    )


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def content_key(df: DataFrame, columns: Sequence[str]) -> str:
    """Fingerprint of the rows, whatever their order; one pass, combined map-side."""
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(*columns)).alias("x"),
        F.sum(F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(1_000_000_007))).alias("s"),
    ).first()
    return f"{r['n']}-{(r['x'] or 0) & (2**64 - 1):016x}-{r['s'] or 0}"


def cached_predictions(
    rows: DataFrame,
    path: str,
    split: str,
    model_key: str,
    columns: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Predictions of ``score(rows)``, computed once per split, model and content.

    The key is taken from ``columns`` of the rows: entity, time and all features, so
    that neither equal lengths nor equal values at other times share an entry. ``rows`` should be stored:
    sums of doubles that are computed again may differ in the last bit and miss the entry. A note written after the table marks it as complete.
    """
    spark = rows.sparkSession
    place = f"{path}/split={split}/model={model_key}/rows={content_key(rows, columns)}"
    if read_if_present(spark, f"{place}/note") is None:
        score(rows).write.mode("overwrite").parquet(f"{place}/table")
        spark.createDataFrame([(split, model_key)], "split string, model string").write.mode(
            "overwrite"
        ).parquet(f"{place}/note")
    return spark.read.parquet(f"{place}/table")
