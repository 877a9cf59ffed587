"""Contiguous split by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.plans.chunks import POS, TOTAL, join_facts, positions, rows_at_rank
from gridcast.spec import SeriesSpec


def _fractions(train: float, val: float, test: float | None) -> None:
    rest = 1.0 - train - val if test is None else test
    if abs(train + val + rest - 1.0) >= 1e-6 or min(train, val, rest) < -1e-9:
        raise ValueError("fractions must sum to 1")


def _ends(train: float, val: float):
    total = F.col(TOTAL)
    train_end = F.floor(total * F.lit(float(train)))
    return train_end, train_end + F.floor(total * F.lit(float(val)))


def split_cuts(
    df: DataFrame, spec: SeriesSpec, train: float = 0.7, val: float = 0.15, test: float | None = None
) -> DataFrame:
    """Per entity the first timestamp of ``val`` and of ``test``.

    Only keys and timestamps are read. A gap-free series is cut by its first and
    last timestamp; else only the buckets holding a cut are sorted.
    """
    _fractions(train, val, test)
    train_end, val_end = _ends(train, val)
    if spec.gap_free:
        span = df.groupBy(*spec.keys).agg(
            F.min(spec.index()).alias(POS), (F.max(spec.index()) - F.min(spec.index()) + 1).alias(TOTAL)
        )

        def start(end):
            # no row starts a split that lies behind the last one
            return F.when(end < F.col(TOTAL), spec.index_to_ts(F.col(POS) + end))

        return span.select(*spec.keys, start(train_end).alias("val_from"), start(val_end).alias("test_from"))
    hit = rows_at_rank(df.select(*spec.keys, spec.ts), spec, [train_end, val_end])
    return hit.groupBy(*spec.keys).agg(
        F.max(F.when(F.col(POS) == train_end, F.col(spec.ts))).alias("val_from"),
        F.max(F.when(F.col(POS) == val_end, F.col(spec.ts))).alias("test_from"),
    )


def time_split(
    df: DataFrame,
    spec: SeriesSpec,
    train: float = 0.7,
    val: float = 0.15,
    test: float | None = None,
    out: str = "split",
) -> DataFrame:
    """Label rows train / val / test in contiguous blocks of each entity.

    ``train_end = int(n * train)``, ``val_end = train_end + int(n * val)``. Rows
    are labelled by comparing timestamps with the cuts, so wide rows are not
    sorted; timestamps must be unique per entity.
    """
    cuts = split_cuts(df, spec, train, val, test)
    joined = join_facts(df, cuts, spec.keys, [spec.ts], "left")
    ts = F.col(spec.ts)
    label = (
        F.when(F.col("val_from").isNull() | (ts < F.col("val_from")), "train")
        .when(F.col("test_from").isNull() | (ts < F.col("test_from")), "val")
        .otherwise("test")
    )
    return joined.withColumn(out, label).drop("val_from", "test_from")


def time_split_by_row(
    df: DataFrame, spec: SeriesSpec, train: float = 0.7, val: float = 0.15, test: float | None = None
) -> DataFrame:
    """The same split with row numbers: adds ``split`` and ``t_idx`` inside it."""
    _fractions(train, val, test)
    train_end, val_end = _ends(train, val)
    pos = F.col(POS)
    split = F.when(pos < train_end, "train").when(pos < val_end, "val").otherwise("test")
    start = F.when(pos < train_end, F.lit(0)).when(pos < val_end, train_end).otherwise(val_end)
    return (
        positions(df, spec)
        .withColumn("split", split)
        .withColumn("t_idx", pos - start)
        .drop(POS, TOTAL)
    )
