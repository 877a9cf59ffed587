"""Channels and readings: shape, selection, bad values."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.functions.names import FEATURE_PATTERNS, PREFERRED_FEATURES
from gridcast.functions.scalars import mask_zero
from gridcast.plans.chunks import join_facts

TARGET_PATTERN = "^temp_cabin.*_c$"


def to_wide(
    df: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str] | Mapping[str, str],
    channel: str = "channel",
    value: str = "value",
) -> DataFrame:
    """Long to wide, one row per ``keys``; the channels are given, not discovered.

    Conditional aggregates combine before a single shuffle.
    """
    named = dict(channels) if isinstance(channels, Mapping) else {c: c for c in channels}
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(channel) == c, F.col(value))).alias(out) for c, out in named.items()]
    )


def drop_dead_channels(
    df: DataFrame,
    keys: Sequence[str] = (),
    channel: str = "channel",
    value: str = "value",
    unused: str = "unused",
) -> DataFrame:
    """Drop channels named unused and channels that are all zero or missing."""
    groups = [*keys, channel]
    alive = (
        df.groupBy(*groups)
        .agg(F.sum(F.abs(F.coalesce(F.col(value), F.lit(0.0)))).alias("__sum"))
        .where((F.col("__sum") > 0) & ~F.col(channel).contains(unused))
        .drop("__sum")
    )
    return join_facts(df, alive, groups, [value, *[c for c in df.columns if c not in groups]], "left_semi")


def drop_duplicate_unit(
    df: DataFrame,
    duplicate: str = "airflow_cfm",
    twin: str | None = None,
    channel: str = "channel",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Drop the channel in the second unit; with ``twin`` only where that exists.

    Works on wide frames (a column) and on long ones (rows of ``channel``).
    """
    if channel not in df.columns:
        drop = duplicate in df.columns and (twin is None or twin in df.columns)
        return df.drop(duplicate) if drop else df
    if twin is None:
        return df.where(F.col(channel) != duplicate)
    has = df.groupBy(*keys).agg(F.max(F.col(channel) == twin).alias("__twin"))
    spread = [c for c in df.columns if c not in keys]
    return (
        join_facts(df, has, keys, spread)
        .where((F.col(channel) != duplicate) | ~F.col("__twin"))
        .drop("__twin")
    )


def mask_zeros(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero readings become missing."""
    return df.withColumns({c: mask_zero(F.col(c)) for c in cols})


def feature_columns(
    columns: Sequence[str],
    preferred: Sequence[str] = PREFERRED_FEATURES,
    patterns: Sequence[str] = FEATURE_PATTERNS,
) -> list[str]:
    """Preferred columns that exist; if none, those containing a pattern, in its order."""
    exact = [c for c in preferred if c in columns]
    if exact:
        return exact
    return list(dict.fromkeys(c for p in patterns for c in columns if p in c))


def target_columns(columns: Sequence[str], pattern: str = TARGET_PATTERN) -> list[str]:
    return [c for c in columns if re.search(pattern, c)]


def is_feature_channel(
    channel: Column, preferred: Sequence[str] | None = None, patterns: Sequence[str] | None = None
) -> Column:
    """Long-form selection: by name, or by pattern when patterns are given."""
    if patterns is not None:
        return F.regexp_like(channel, F.lit("|".join(re.escape(p) for p in patterns)))
    return channel.isin(*(preferred or PREFERRED_FEATURES))


def is_target_channel(channel: Column, pattern: str = TARGET_PATTERN) -> Column:
    return F.regexp_like(channel, F.lit(pattern))
