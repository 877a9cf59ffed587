"""Live telemetry: the same parsing and binning on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.spec import SeriesSpec


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as they arrive in a folder; feed them to ``parse_lines``."""
    return spark.readStream.text(path).withColumnRenamed("value", "line")


def stream_means(
    stream: DataFrame, spec: SeriesSpec, cols: Sequence[str], watermark: str = "1 minute"
) -> DataFrame:
    """Mean per bin of a stream; a bin is final once the watermark has passed it.

    Gives the bins that hold rows. State is one partial mean per open bin, so it
    is bounded by the watermark. Later rows are dropped by the watermark.
    """
    length = f"{spec.step_us} microseconds"
    offset = f"{spec.origin_us % spec.step_us} microseconds"
    bins = F.window(spec.ts, length, length, offset)
    return (
        stream.withWatermark(spec.ts, watermark)
        .groupBy(*spec.keys, bins.alias("__w"))
        .agg(*[F.avg(c).alias(c) for c in cols])
        .select(*spec.keys, F.col("__w.start").alias(spec.ts), *cols)
    )
