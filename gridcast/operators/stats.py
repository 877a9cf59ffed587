"""Statistics fitted on training rows and the transforms that use them.

Fits return small tables, one row per (entity,) column. Without keys they are
pooled over all rows; the pooled ones are bounded by the number of columns and
may be turned into literals with ``pooled``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.plans.chunks import join_facts
from gridcast.plans.storage import materialize

_FACTS = "__facts"
_GROUP, _COLUMN, _VALUE, _BITS = "__group", "__column", "__value", "__bits"


def clip(c: Column, low: float | Column, high: float | Column) -> Column:
    """Clip; missing stays missing (``least``/``greatest`` would skip the NULL)."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def long_stats(wide: DataFrame, keys: Sequence[str], name: str, cols: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row per (keys, column) from a one-row-per-key aggregate."""
    rows = [
        F.struct(F.lit(c).alias(name), *[e.alias(f) for f, e in fields.items()])
        for c, fields in cols.items()
    ]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("__s")).select(*keys, "__s.*")


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles: (keys, one array column per column).

    Radix selection: a value becomes an integer of the same order, and each round counts
    one digit of 16 bits among the values that share the digits found so far. Columns are
    turned into rows, so the plan does not grow with their number; counts combine before
    the shuffle, and a group has at most 65,536 of them in a round, however many values.
    The cells are stored once and scanned four times.
    """
    # a struct is never NULL, so groups with a NULL key are joined too
    cells = [
        F.struct(F.struct(F.lit(j).alias("column"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias(_GROUP), F.col(c).cast("double").alias(_VALUE))
        for j, c in enumerate(cols)
    ]
    melted = df.select(F.explode(F.array(*cells)).alias("__cell"))
    stored = materialize(melted.select(f"__cell.{_GROUP}", ordered_bits(F.col(f"__cell.{_VALUE}")).alias(_BITS)))
    found = _selected(stored, qs)
    value = F.transform(F.array_sort("__found"), lambda s: s["value"])
    out = found.groupBy(_GROUP).agg(F.first("__n").alias("__n"), F.collect_list(F.struct("slot", from_ordered_bits(F.col(_BITS)).alias("value"))).alias("__found"))
    out = out.withColumn("__values", value).select(
        *[F.col(f"{_GROUP}.k{i}").alias(k) for i, k in enumerate(keys)],
        F.col(f"{_GROUP}.column").alias(_COLUMN),
        F.when(F.col("__n") > 0, F.array(*[_between(q, i) for i, q in enumerate(qs)])).alias(_VALUE),
    )
    return out.groupBy(*keys).agg(
        *[F.first(F.when(F.col(_COLUMN) == j, F.col(_VALUE)), ignorenulls=True).alias(c) for j, c in enumerate(cols)]
    )


_MANTISSA, _DIGIT = 52, 16


def ordered_bits(x: Column) -> Column:
    """The bits of a double as a signed integer that sorts like it; both zeros are 0, NaN is the largest.

    Spark has no cast for this: the exponent is the floor of log2, put right by one if
    the logarithm was rounded, and division by a power of two is exact.
    """
    a = F.abs(x)
    e = F.floor(F.log2(a))
    e = F.when(_power(e) > a, e - 1).when(_power(e + 1) <= a, e + 1).otherwise(e)
    normal = F.shiftleft((e + 1023).cast("long"), _MANTISSA) + ((a / _power(e) - 1) * 2.0**_MANTISSA).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")  # below the smallest normal number
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0**-1022, small).when(a == float("inf"), 2047 << _MANTISSA).otherwise(normal)
    bits = F.when(F.isnan(x), (2047 << _MANTISSA) + 1).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def from_ordered_bits(bits: Column) -> Column:
    """The double that ``ordered_bits`` made the integer from."""
    a = F.abs(bits)
    code, rest = F.shiftright(a, _MANTISSA), a.bitwiseAND(F.lit((1 << _MANTISSA) - 1)).cast("double")
    normal = (1 + rest / 2.0**_MANTISSA) * _power(code - 1023)
    special = F.when(rest == 0, float("inf")).otherwise(float("nan"))
    x = F.when(code == 2047, special).when(code == 0, rest * 2.0**-1022 / 2.0**_MANTISSA).otherwise(normal)
    return F.when(bits < 0, -x).otherwise(x)


def _between(q: float, i: int) -> Column:
    """The interpolated quantile from the values at the ranks on its two sides."""
    at = (F.col("__n") - 1) * F.lit(float(q))
    low, high = F.get("__values", F.lit(2 * i)), F.get("__values", F.lit(2 * i + 1))
    share = at - F.floor(at)
    return F.when(low == high, low).otherwise((1 - share) * low + share * high)


def _selected(cells: DataFrame, qs: Sequence[float]) -> DataFrame:
    """(group, slot, bits, n): the values at the two ranks around each quantile.

    A group without values keeps one row with n = 0.
    """
    digit = F.shiftright(_BITS, 64 - _DIGIT)
    counts = cells.groupBy(_GROUP, digit.alias("__prefix")).agg(F.count(_BITS).alias("__m"))
    n = F.sum("__m").over(Window.partitionBy(_GROUP))
    ranks = [f((F.col("__n") - 1) * F.lit(float(q))).cast("long") for q in qs for f in (F.floor, F.ceil)]
    wanted = F.array(*[F.struct(F.lit(i).alias("slot"), r.alias("rest")) for i, r in enumerate(ranks)])
    counts = counts.withColumn("__n", n).withColumn("__wanted", wanted)
    empty = counts.where("__n = 0").select(_GROUP, F.lit(0).alias("slot"), F.lit(None).cast("long").alias(_BITS), "__n")
    state = materialize(_holding(counts.where("__n > 0"), [_GROUP]).unionByName(empty.select(_GROUP, F.col(_BITS).alias("__prefix"), "__n", F.lit(None).cast(_WANTED).alias("__wanted"))))
    few = state.limit(_MAX_STATE + 1).count() <= _MAX_STATE  # later rounds hold at most a row for each slot
    for left in (2, 1, 0):
        prefix = F.shiftright(_BITS, (left + 1) * _DIGIT).alias("__prefix")
        found = state.where("__wanted IS NOT NULL")
        rows = cells.select(_GROUP, _BITS, prefix).join(F.broadcast(found) if few else found, [_GROUP, "__prefix"])
        digit = F.shiftright(_BITS, left * _DIGIT)
        counts = rows.groupBy(_GROUP, "__prefix", digit.alias("__next")).agg(
            F.count(F.lit(1)).alias("__m"), F.first("__n").alias("__n"), F.first("__wanted").alias("__wanted")
        )
        state = _holding(counts, [_GROUP, "__prefix"], "__next")
        if left:
            state = materialize(state)
    out = state.select(_GROUP, F.explode("__wanted.slot").alias("slot"), F.col("__prefix").alias(_BITS), "__n")
    return out.unionByName(empty)


_WANTED = "array<struct<slot: int, rest: bigint>>"
_MAX_STATE = 100_000


def _holding(counts: DataFrame, by: Sequence[str], digit: str = "__prefix") -> DataFrame:
    """The digits that hold a wanted rank, with the ranks counted from their first value."""
    before = F.sum("__m").over(Window.partitionBy(*by).orderBy(digit)) - F.col("__m")
    inside = F.filter("__wanted", lambda s: (s["rest"] >= F.col("__before")) & (s["rest"] < F.col("__before") + F.col("__m")))
    rest = F.transform(inside, lambda s: F.struct(s["slot"].alias("slot"), (s["rest"] - F.col("__before")).alias("rest")))
    found = counts.withColumn("__before", before).withColumn("__wanted", rest).where(F.size("__wanted") > 0)
    return found.select(_GROUP, F.col(digit).alias("__prefix"), "__n", "__wanted")


def winsor_bounds(
    train: DataFrame,
    cols: Sequence[str],
    q_low: float = 0.01,
    q_high: float = 0.99,
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, column, low, high) from quantiles of the training rows."""
    q = quantiles(train, cols, [q_low, q_high], keys)
    return long_stats(
        q,
        keys,
        "column",
        {
            c: {
                "low": F.least(F.col(c)[0], F.col(c)[1]),
                "high": F.greatest(F.col(c)[0], F.col(c)[1]),
            }
            for c in cols
        },
    )


def low_variance_table(train: DataFrame, cols: Sequence[str], threshold: float = 1e-8) -> DataFrame:
    """(column, variance, kept): population variance on train; all-missing is not kept."""
    wide = train.agg(*[F.var_pop(c).alias(c) for c in cols])
    return long_stats(
        wide,
        (),
        "column",
        {
            c: {
                "variance": F.col(c),
                "kept": F.coalesce(F.col(c) >= F.lit(threshold), F.lit(False)),
            }
            for c in cols
        },
    )


def keep_columns(train: DataFrame, cols: Sequence[str], threshold: float = 1e-8) -> list[str]:
    kept = {r["column"] for r in low_variance_table(train, cols, threshold).collect() if r["kept"]}
    return [c for c in cols if c in kept]


def scaler_fit(
    train: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str] = (),
    min_std: float = 1e-8,
    only_zero: bool = False,
) -> DataFrame:
    """(keys, column, mean, std): population std, 1.0 where it is (nearly) zero."""
    wide = train.groupBy(*keys).agg(
        *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]
    )

    def std(c: str) -> Column:
        s = F.col(f"{c}__s")
        return F.when((s == 0) if only_zero else (s < min_std), F.lit(1.0)).otherwise(s)

    return long_stats(
        wide, keys, "column", {c: {"mean": F.col(f"{c}__m"), "std": std(c)} for c in cols}
    )


def pooled(stats: DataFrame) -> dict[str, tuple]:
    """column -> its values, for stats without keys (one row per column)."""
    fields = [c for c in stats.columns if c != "column"]
    return {r["column"]: tuple(r[f] for f in fields) for r in stats.collect()}


def _with_facts(df: DataFrame, stats: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    fields = [c for c in stats.columns if c not in (*keys, "column")]
    facts = stats.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct(*fields)))).alias(_FACTS)
    )
    return join_facts(df, facts, keys, cols, "left", width=len(cols) * len(fields))


def _apply(
    df: DataFrame, stats: DataFrame | Mapping[str, tuple], cols: Sequence[str], keys: Sequence[str], make
) -> DataFrame:
    """Rewrite columns with per-column facts, given as literals or as a table."""
    if isinstance(stats, DataFrame):
        fields = [c for c in stats.columns if c not in (*keys, "column")]
        joined = _with_facts(df, stats, keys, cols)
        return joined.withColumns(
            {c: make(c, *[F.col(_FACTS)[c][f] for f in fields]) for c in cols}
        ).drop(_FACTS)
    return df.withColumns({c: make(c, *[F.lit(float(v)) for v in stats[c]]) for c in cols})


def winsorize(
    df: DataFrame,
    bounds: DataFrame | Mapping[str, tuple[float, float]],
    cols: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Clip to the bounds; bounds of absent columns are skipped."""
    if cols is None:
        if isinstance(bounds, DataFrame):
            raise ValueError("name the columns when bounds is a table")
        cols = list(bounds)
    cols = [c for c in cols if c in df.columns]
    return _apply(df, bounds, cols, keys, lambda c, lo, hi: clip(F.col(c), lo, hi))


def _check_known(stats: DataFrame | Mapping[str, tuple], cols: Sequence[str]) -> None:
    if not isinstance(stats, DataFrame):
        missing = [c for c in cols if c not in stats]
        if missing:
            raise KeyError(f"columns not fitted: {missing}")


def scaler_transform(
    df: DataFrame, stats: DataFrame | Mapping[str, tuple], cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """``(y - mean) / std``; a column that was not fitted is an error."""
    _check_known(stats, cols)
    return _apply(df, stats, cols, keys, lambda c, mu, sd: (F.col(c) - mu) / sd)


def scaler_inverse(
    df: DataFrame, stats: DataFrame | Mapping[str, tuple], cols: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """``z * std + mean``."""
    _check_known(stats, cols)
    return _apply(df, stats, cols, keys, lambda c, mu, sd: F.col(c) * sd + mu)


def scaler_inverse_array(z: Column, stats: Mapping[str, tuple], cols: Sequence[str]) -> Column:
    """Array form: element i belongs to ``cols[i]``."""
    pairs = F.array(*[F.struct(F.lit(float(stats[c][0])).alias("m"), F.lit(float(stats[c][1])).alias("s")) for c in cols])
    return F.zip_with(z, pairs, lambda v, p: v * p["s"] + p["m"])


def zscore_full(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``{c}_z`` from the mean and std of all rows of the entity.

    It sees test rows too; training uses ``scaler_fit`` on train rows instead.
    """
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"__s_{c}") for c in cols]
    )
    joined = join_facts(df, stats, keys, cols)
    scale = {c: F.when(F.col(f"__s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"__s_{c}")) for c in cols}
    return joined.withColumns(
        {f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / scale[c] for c in cols}
    ).drop(*[f"__{x}_{c}" for c in cols for x in "ms"])
