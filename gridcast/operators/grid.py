"""Time grid: timestamps, resampling, gap filling, cadence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.plans.chunks import (
    BUCKET,
    CHUNK,
    HOME,
    POS,
    SALT,
    SALTS,
    TOTAL,
    bucketed,
    by,
    chunk_edges,
    in_parts,
    positions,
    rows_at_rank,
    windowed,
    with_halo,
    with_pos,
)
from gridcast.spec import SeriesSpec, floor_div

TIMESTAMP_NAMES = ("timestamp", "time", "datetime")


def as_timestamp(
    df: DataFrame, out: str = "ts", strict: bool = False, try_first: bool = False
) -> DataFrame:
    """Find the timestamp column by name (any case), parse it, call it ``out``.

    ``try_first`` falls back to the first column. Unparsable values become NULL
    unless ``strict``. Order is left to the windows that need it.
    """
    found = [c for c in df.columns if c.lower() in TIMESTAMP_NAMES]
    if not found and try_first:
        found = df.columns[:1]
    if not found:
        raise ValueError("no timestamp column found")
    name = found[0]
    if dict(df.dtypes)[name] == "string":
        parsed = F.to_timestamp(name) if strict else F.try_to_timestamp(F.col(name))
    else:
        parsed = F.col(name).cast("timestamp")
    return df.select(parsed.alias(out), *[c for c in df.columns if c not in (name, out)])


def resample(
    df: DataFrame,
    spec: SeriesSpec,
    aggregates: Mapping[str, Column],
    span: DataFrame | None = None,
    merged: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Left-labelled bins of ``step_s`` with every bin from first to last row kept.

    ``aggregates`` maps output names to aggregates that skip NULLs; bins without
    rows hold NULL. Only bins with readings are aggregated, so that a task holds
    no more of them than there are readings. Where bins hold few readings, combining them before a
    shuffle would keep a bin for almost each row of a file's row group; so readings are spread first, those of a
    bin by their time over at most ``SALTS`` places, which are combined there and then summed up. Each chunk of a series adds one row
    at its first bin, which names its last one; from there every bin, known by the next
    one of its chunk, is repeated over the gap behind it. Nothing is joined, and a long series is not
    expanded in one task.

    ``merged`` maps output names to aggregates over the columns that ``aggregates`` give for each place: then
    places are summed up chunk by chunk, in all shuffle partitions. Without it Spark brings the places of a bin together, in as
    many tasks as their compressed size asks for.

    ``span`` (keys, lo, hi as grid indexes) saves the pass that finds it.
    """
    keys, n = spec.keys, spec.chunk_rows
    values = list(aggregates if merged is None else merged)
    rows = df.where(F.col(spec.ts).isNotNull()).withColumn(POS, spec.index())
    if span is None:
        span = rows.groupBy(*keys).agg(F.min(POS).alias("lo"), F.max(POS).alias("hi"))
    chunks = span.where(F.col("lo").isNotNull()).withColumn(
        CHUNK, F.explode(F.sequence(floor_div(F.col("lo"), n), floor_div(F.col("hi"), n)))
    )
    starts = chunks.select(
        *keys,
        F.greatest("lo", F.col(CHUNK) * n).alias(POS),
        F.least("hi", F.col(CHUNK) * n + F.lit(n - 1)).alias("__end"),
    )
    salted = rows.withColumn(SALT, F.pmod(F.xxhash64(spec.ts), F.lit(SALTS)).cast("int"))
    spread = in_parts(salted.unionByName(starts, allowMissingColumns=True), [*keys, POS, SALT])
    binned = (
        spread.groupBy(*keys, POS, *([] if merged is None else [SALT]))
        .agg(*[a.alias(c) for c, a in aggregates.items()], F.max("__end").alias("__end"))
        .withColumn(CHUNK, floor_div(F.col(POS), n))
    )
    laid = in_parts(binned, [*keys, CHUNK])
    if merged is not None:
        laid = laid.groupBy(*keys, CHUNK, POS).agg(*[a.alias(c) for c, a in merged.items()], F.max("__end").alias("__end"))
    w = by([*keys, CHUNK]).orderBy(POS)
    laid = laid.withColumns(
        {
            "__end": F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__next": F.lead(POS).over(w),
        }
    )
    # a given span may leave readings out: no bin is added before or behind it
    last = F.when(F.col("__end").isNull(), F.col(POS)).otherwise(
        F.greatest(POS, F.least(F.col("__next") - 1, "__end"))
    )
    bins = laid.select(*keys, POS, *values, F.explode(F.sequence(POS, last)).alias("__bin"))
    here = F.col("__bin") == F.col(POS)
    return bins.select(
        *keys,
        spec.index_to_ts(F.col("__bin")).alias(spec.ts),
        *[F.when(here, F.col(c)).alias(c) for c in values],
    )


def _resample_means(
    df: DataFrame, spec: SeriesSpec, values: Mapping[str, Column], span: DataFrame | None = None
) -> DataFrame:
    """Means of ``values`` per bin: the mean of the one place that has readings, else sums over counts."""
    places, merged = {}, {}
    for i, (out, x) in enumerate(values.items()):
        kind = df.select(x.alias("x")).schema["x"].dataType
        mean = df.select(F.avg(x).alias("x")).schema["x"].dataType
        if not isinstance(kind, T.NumericType):
            return resample(df, spec, {c: F.avg(v) for c, v in values.items()}, span)
        summed = x if isinstance(kind, T.DecimalType) else x.cast("double")
        places |= {f"__m{i}": F.avg(x), f"__s{i}": F.sum(summed), f"__n{i}": F.count(x)}
        several = F.try_divide(F.sum(f"__s{i}"), F.sum(f"__n{i}")).cast(mean)
        merged[out] = F.when(F.count(f"__m{i}") == 1, F.max(f"__m{i}")).otherwise(several)
    return resample(df, spec, places, span, merged)


def resample_mean(
    df: DataFrame, spec: SeriesSpec, cols: Sequence[str], span: DataFrame | None = None
) -> DataFrame:
    """Mean per bin and column; the result is a gap-free series."""
    return _resample_means(df, spec, {c: F.col(c) for c in cols}, span)


def resample_channels(
    df: DataFrame, spec: SeriesSpec, channels: Mapping[str, str], channel: str, value: str
) -> DataFrame:
    """Long readings to a wide grid in one aggregation.

    ``channels`` maps a channel value to its output column.
    """
    return _resample_means(
        df, spec, {out: F.when(F.col(channel) == name, F.col(value)) for name, out in channels.items()}
    )


def ffill_stage(cols: Sequence[str], limit: int) -> Callable[[WindowSpec], dict[str, Column]]:
    return lambda w: {c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in cols}


def ffill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], limit: int = 1) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows."""
    return windowed(df, spec, [ffill_stage(cols, limit)], back=limit)


def interpolate(
    df: DataFrame, spec: SeriesSpec, cols: Sequence[str], limit: int
) -> DataFrame:
    """Linear in time, forward, at most ``limit`` rows into a gap.

    A longer gap is filled for its first ``limit`` rows on the slope of the whole
    gap; after the last value that value repeats; before the first stays NULL.
    The next valid value may be any distance away: it is looked up in the chunk,
    else in the first valid values of the later chunks.
    """
    keys = spec.keys
    at = "__at"
    base = with_pos(df, spec).withColumn(at, spec.micros())
    edges = chunk_edges(
        base.withColumn(CHUNK, floor_div(F.col(POS), spec.chunk_rows)), keys, cols, at
    ).drop(*[f"{c}__before" for c in cols])
    laid = in_parts(with_halo(base, spec.chunk_rows, limit, 0), [*keys, CHUNK])
    w = by([*keys, CHUNK]).orderBy(POS)
    back_to_front = by([*keys, CHUNK]).orderBy(F.desc(POS))
    valid = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("v")))
        for c in cols
    }
    laid = laid.withColumns(
        {f"{c}__p": F.last(valid[c], ignorenulls=True).over(w.rowsBetween(-limit, 0)) for c in cols}
        | {
            f"{c}__n": F.last(valid[c], ignorenulls=True).over(
                back_to_front.rowsBetween(Window.unboundedPreceding, 0)
            )
            for c in cols
        }
    ).where(HOME)
    joined = laid.join(edges, [*keys, CHUNK], "left")

    def filled(c: str) -> Column:
        p = F.col(f"{c}__p")
        n = F.coalesce(F.col(f"{c}__n"), F.col(f"{c}__after"))
        share = (F.col(at) - p["at"]) / (n["at"] - p["at"])
        return (
            F.when(F.col(c).isNotNull() | p.isNull(), F.col(c))
            .when(n.isNull(), p["v"])
            .otherwise(p["v"] + (n["v"] - p["v"]) * share)
        )

    return joined.withColumns({c: filled(c) for c in cols}).select(*df.columns)


def drop_empty_rows(df: DataFrame, cols: Sequence[str], how: str = "all") -> DataFrame:
    """Drop rows where all (or any) of ``cols`` are missing."""
    return complete_rows(df, cols) if how == "any" else df.dropna(how=how, subset=list(cols))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a missing value in ``cols``.

    One condition per column: ``dropna`` makes a single one over all columns,
    whose rewritings under renamed columns the optimizer enumerates (2^n).
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in cols], F.lit(True)))


def resample_and_clean(
    df: DataFrame,
    spec: SeriesSpec,
    cols: Sequence[str],
    strict: bool = False,
    max_ffill_steps: int = 6,
    max_interp_seconds: float = 60,
    cadence_s: float = 10,
) -> DataFrame:
    """Mean per bin, short forward fill, then (unless strict) interpolation.

    The interpolation limit is ``max_interp_seconds / cadence_s`` rows; the
    result has gaps again, as rows without any value are dropped.
    """
    grid = spec.replace(gap_free=True)
    out = ffill(resample_mean(df, spec, cols), grid, cols, max_ffill_steps)
    if not strict:
        out = interpolate(out, grid, cols, int(max_interp_seconds / cadence_s))
    return drop_empty_rows(out, cols)


def resample_with_interpolation(
    df: DataFrame,
    spec: SeriesSpec,
    cols: Sequence[str],
    strict: bool = False,
    max_interp_seconds: float = 30,
    cadence_s: float = 10,
) -> DataFrame:
    """Mean per bin and (unless strict) interpolation; nothing is carried forward."""
    grid = spec.replace(gap_free=True)
    out = resample_mean(df, spec, cols)
    if not strict:
        out = interpolate(out, grid, cols, int(max_interp_seconds / cadence_s))
    return drop_empty_rows(out, cols)


def intervals(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Seconds since the previous row of the entity, for raw (uneven) readings.

    The previous row of a bucket's first row is the last one of the nearest
    earlier bucket, found among one row per bucket.
    """
    keys = spec.keys
    rows, _ = bucketed(df.where(F.col(spec.ts).isNotNull()).select(*keys, spec.ts), spec)
    rows = rows.select(*keys, BUCKET, spec.micros().alias("__us"))
    ends = rows.groupBy(*keys, BUCKET).agg(F.max("__us").alias("__end"))
    before = ends.select(
        *keys, BUCKET, F.lag("__end").over(by(keys).orderBy(BUCKET)).alias("__carry")
    )
    inside = by([*keys, BUCKET]).orderBy("__us")
    prev = F.coalesce(F.lag("__us").over(inside), F.col("__carry"))
    return (
        rows.join(before, [*keys, BUCKET])
        .withColumn("interval_s", (F.col("__us") - prev) / 1e6)
        .where(F.col("interval_s").isNotNull())
        .select(*keys, "interval_s")
    )


def cadence_report(
    df: DataFrame,
    spec: SeriesSpec,
    expected_s: float = 10.0,
    tolerance_s: float = 1.0,
    top: int = 5,
) -> DataFrame:
    """The ``top`` most frequent intervals outside expected ± tolerance.

    ``n_off`` is the number of all such intervals.
    """
    gaps = intervals(df, spec).where(
        ~F.col("interval_s").between(expected_s - tolerance_s, expected_s + tolerance_s)
    )
    # the rollup's total comes first: no single interval is more frequent
    counts = gaps.rollup("interval_s").agg(F.count(F.lit(1)).alias("n"))
    report = counts.orderBy(F.desc("n"), F.asc_nulls_first("interval_s")).limit(top + 1)
    return report.withColumn("n_off", F.max("n").over(Window.partitionBy())).where(
        F.col("interval_s").isNotNull()
    )


def first_rows(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """The first ``n`` rows by time: of each entity, or of the table without keys."""
    if not spec.keys:
        return df.orderBy(spec.ts).limit(n)
    return positions(df, spec, first=n).where(F.col(POS) < n).drop(POS, TOTAL)


def row_at_position(
    df: DataFrame, spec: SeriesSpec, fraction: float, tie: Sequence[str] = ()
) -> DataFrame:
    """The row at ``floor(n * fraction)`` of each entity; 0.5 is the midpoint."""
    rank = F.floor(F.col(TOTAL) * F.lit(float(fraction)))
    return rows_at_rank(df, spec, [rank], tie).drop(POS, TOTAL)
