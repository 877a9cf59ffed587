"""Two raw logs to one merged table: parse, clean, grid, join, normalise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.names import clean_cooler_key, clean_probe_label
from gridcast.functions.scalars import mask_zero
from gridcast.operators.align import join_feeds
from gridcast.operators.clean import drop_dead_channels, drop_duplicate_unit, feature_columns, target_columns
from gridcast.operators.grid import drop_empty_rows, ffill, resample_channels
from gridcast.operators.stats import zscore_full
from gridcast.plans.storage import materialize
from gridcast.sources.dict_lines import parse_lines, sensor_rows
from gridcast.spec import SeriesSpec


def cooler_feed(lines: DataFrame, spec: SeriesSpec, channels: Sequence[str], mode: str = "PERMISSIVE") -> DataFrame:
    """Cooler log to a gap-free grid, one column per channel, filled by one row.

    The parsed rows are written once; the grid reads them twice.
    """
    rows = drop_duplicate_unit(materialize(sensor_rows(parse_lines(lines), clean_cooler_key, mode)))
    wide = resample_channels(rows, spec, {c: c for c in channels}, "channel", "value")
    return ffill(wide, spec.replace(gap_free=True), channels, 1)


def probe_feed(lines: DataFrame, spec: SeriesSpec, channels: Sequence[str], mode: str = "PERMISSIVE") -> DataFrame:
    """Probe log likewise; dead channels are dropped and zero readings are missing."""
    rows = materialize(sensor_rows(parse_lines(lines), clean_probe_label, mode))
    rows = drop_dead_channels(rows, spec.keys)
    rows = rows.withColumn("value", mask_zero(F.col("value")))
    wide = resample_channels(rows, spec, {c: c for c in channels}, "channel", "value")
    return ffill(wide, spec.replace(gap_free=True), channels, 1)


def merge_feeds(
    cooler: DataFrame, probes: DataFrame, spec: SeriesSpec
) -> tuple[DataFrame, list[str], list[str]]:
    """Inner join on time; rows without any target drop out; features filled by one
    more row; targets get ``*_z`` columns. Gives the table, features and targets."""
    merged = join_feeds(cooler, probes, spec.keys, spec.ts)
    names = [c for c in merged.columns if c not in (*spec.keys, spec.ts)]
    features, targets = feature_columns(names), target_columns(names)
    if not features or not targets:
        raise ValueError("no feature or no target columns")
    merged = materialize(drop_empty_rows(merged, targets, "all"))
    merged = ffill(merged, spec.replace(gap_free=False), features, 1)
    return zscore_full(merged, targets, spec.keys), features, targets
