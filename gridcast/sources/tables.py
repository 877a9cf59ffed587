"""Reading Parquet and numeric CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.scalars import no_nan


def read_table(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """A Parquet scan of the named columns, with NaN read as NULL."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
        df = df.select(*columns)
    floats = [f for f, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: no_nan(F.col(c).cast("double")) for c in floats}) if floats else df


def read_numeric_csv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A numeric CSV by position: cells that are no numbers (the header too) are NULL.

    The names are given, as files repeat header names or leave them out. Lines
    without any number, such as the header, are dropped.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.csv(path if isinstance(path, str) else list(path), schema=schema, header=False)
    out = raw.select(*[no_nan(F.col(c).try_cast("double")).alias(c) for c in columns])
    return out.dropna(how="all")
