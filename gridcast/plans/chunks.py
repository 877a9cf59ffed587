"""Window work on long series without ever putting one series into one task.

``partitionBy(entity)`` breaks down when an entity holds a large share of the
rows. Everything here cuts a series into chunks of bounded length instead:

* ``windowed``      bounded look-back / look-ahead: rows near a chunk edge are
                    copied into the neighbour chunk (halo), one exchange and one
                    sort by (keys, chunk), copies dropped at the end
* ``find_buckets``  time ranges with a bounded number of rows; crowded ones are cut
                    further
* ``positions``     exact row numbers: bucket counts, prefix sum over the counts,
                    row_number inside a bucket
* ``rows_at_rank``  rows at given ranks; only buckets holding a rank are sorted
* ``chunk_edges``   nearest valid value before / after a chunk, at any distance
* ``running_sum``   chunk totals, prefix sum over totals, sum inside the chunk

Sums over the per-chunk summaries have a second level (``prefix_sums``). Other windows over
them do run per entity; they see one row per chunk (time span / chunk span), not one per reading.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridcast.plans.storage import materialize
from gridcast.spec import SeriesSpec, floor_div

POS, CHUNK, BUCKET, HOME = "__pos", "__chunk", "__bucket", "__home"
OFFSET, TOTAL = "__offset", "__total"
SALT = "__salt"
#: Places that the rows of one entity, or one bin, are spread over.
SALTS = 32

Stage = Callable[[WindowSpec], Mapping[str, Column]]


def by(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def in_parts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows brought together by ``keys`` in all of the session's shuffle partitions.

    Grid rows compress to a tenth of what a sort of them takes; partitions merged by their compressed
    size, as for any other exchange, would hold too many.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def salted_join(
    df: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    known_small: bool = False,
) -> DataFrame:
    """Join one-row-per-entity facts to many rows per entity.

    A hot entity is spread over ``salts`` groups by the hash of the ``spread``
    columns. ``known_small`` says that the size of ``small`` has been checked; otherwise both sides are
    shuffled, as the planner would judge ``small`` by its compressed file, without the copies.
    """
    left = df.withColumn(SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = F.broadcast(right) if known_small else right.hint("merge")
    return left.join(right, [*keys, SALT], how).drop(SALT)


#: Values of facts that are broadcast: the driver holds them three times, with up to 60 bytes for each.
MAX_CELLS = 500_000


def few_facts(stored: DataFrame, width: int, max_cells: int = MAX_CELLS) -> bool:
    """Whether stored facts of ``width`` values a row are few enough to be broadcast."""
    most = max_cells // width
    return stored.limit(most + 1).count() <= most


def join_facts(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    width: int | None = None,
    max_cells: int = MAX_CELLS,
    stored: bool = False,
) -> DataFrame:
    """Join fitted facts (one row per entity) to the rows they belong to.

    The facts are written once (unless ``stored``) and counted. Up to ``max_cells`` values (rows
    times ``width``) they are broadcast, so the rows are not shuffled at all;
    beyond that a salted join takes over.
    """
    facts = facts if stored else materialize(facts)
    if not few_facts(facts, width or len(facts.columns), max_cells):
        return salted_join(df, facts, keys, spread, how)
    if keys:
        return df.join(F.broadcast(facts), list(keys), how)
    return salted_join(df, facts, keys, spread, how, known_small=True)


@dataclass(frozen=True)
class Buckets:
    """Time (or value) ranges of one entity that hold a bounded number of rows.

    ``hot`` lists, level by level, the ranges that held too many rows and were
    cut into finer ones; ``counts`` has the rows of every range that remains.
    """

    keys: tuple[str, ...]
    at: str
    widths: tuple[float, ...]
    hot: tuple[DataFrame, ...]
    counts: DataFrame

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``__bucket``: the start of the range a row lies in."""
        out = df.withColumn(BUCKET, _range_start(F.col(self.at), self.widths[0]))
        for hot, width in zip(self.hot, self.widths[1:]):
            flagged = hot.withColumn("__hot", F.lit(True))
            out = join_facts(out, flagged, [*self.keys, BUCKET], [self.at], "left", stored=True)
            out = out.withColumn(
                BUCKET, F.when(F.col("__hot"), _finer(F.col(self.at), width)).otherwise(F.col(BUCKET))
            ).drop("__hot")
        return out


def _range_start(x: Column, width: float) -> Column:
    if isinstance(width, int):
        return x - F.pmod(x, F.lit(width))
    return F.floor(x / F.lit(width)) * F.lit(width)


def _finer(at: Column, width: float) -> Column:
    # counted from the start of the coarse range, so the finer ones nest in it
    return F.col(BUCKET) + _range_start(at - F.col(BUCKET), width)


def find_buckets(
    df: DataFrame, keys: Sequence[str], at: str, width: float, max_rows: int
) -> Buckets:
    """Cut each entity into ranges of ``width``, and crowded ones further.

    One count combined map-side per level; the next level reads only the rows of
    ranges above ``max_rows``, and most data needs no second level. What cannot
    be cut are rows that share one value of ``at``.
    """
    rows = df.where(F.col(at).isNotNull()).select(*keys, at)
    rows = rows.withColumn(BUCKET, _range_start(F.col(at), width))
    widths, hot, counts = [width], [], []
    while True:
        level = materialize(rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n")))
        crowded = level.where(F.col("__n") > max_rows)
        if widths[-1] == 1 or len(widths) == 10 or not crowded.take(1):
            counts.append(level)
            break
        counts.append(level.where(F.col("__n") <= max_rows))
        hot.append(crowded.drop("__n"))
        last = widths[-1]
        widths.append(-(-last // 64) if isinstance(last, int) else last / 64)
        rows = join_facts(rows, hot[-1], [*keys, BUCKET], [at], "left_semi", stored=True)
        rows = rows.withColumn(BUCKET, _finer(F.col(at), widths[-1]))
    return Buckets(tuple(keys), at, tuple(widths), tuple(hot), reduce(DataFrame.unionByName, counts))


def bucketed(df: DataFrame, spec: SeriesSpec) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__bucket``, and the bucket counts."""
    timed = df.withColumn("__at", spec.micros())
    buckets = find_buckets(timed, spec.keys, "__at", spec.bucket_us, spec.max_bucket_rows)
    return buckets.assign(timed).drop("__at"), buckets.counts


#: Summaries (buckets, chunks) of one entity whose sums are formed together.
BLOCK = 4096


def prefix_sums(
    rows: DataFrame, keys: Sequence[str], at: str, span: int, sums: Mapping[str, str], totals: Mapping[str, str] | None = None
) -> DataFrame:
    """For each name in ``sums`` the sum of a column over the earlier rows of the entity, in two levels.

    ``at`` orders the rows; values of one ``span`` make a block. A window sees the rows of a
    block, and another one the sums of the blocks, so that not even all summaries of an entity, or
    of a table without keys, meet in one task. ``totals`` are sums over all rows of the entity.
    """
    cols = sorted({*sums.values(), *(totals or {}).values()})
    rows = rows.withColumn("__block", floor_div(F.col(at), span))
    blocks = rows.groupBy(*keys, "__block").agg(*[F.sum(c).alias(f"__b_{c}") for c in cols])
    earlier = Window.unboundedPreceding, -1
    before = by(keys).orderBy("__block").rowsBetween(*earlier)
    zero = F.lit(0)
    blocks = blocks.select(
        *keys,
        "__block",
        *[F.coalesce(F.sum(f"__b_{c}").over(before), zero).alias(f"__p_{c}") for c in sorted({*sums.values()})],
        *[F.sum(f"__b_{c}").over(by(keys)).alias(n) for n, c in (totals or {}).items()],
    )
    inside = by([*keys, "__block"]).orderBy(at).rowsBetween(*earlier)
    out = rows.join(blocks, [*keys, "__block"]).withColumns(
        {n: F.col(f"__p_{c}") + F.coalesce(F.sum(c).over(inside), zero) for n, c in sums.items()}
    )
    return out.drop("__block", *[f"__p_{c}" for c in {*sums.values()}])


def _offsets(counts: DataFrame, spec: SeriesSpec) -> DataFrame:
    return prefix_sums(counts, spec.keys, BUCKET, min(BLOCK * spec.bucket_us, 1 << 62), {OFFSET: "__n"}, {TOTAL: "__n"})


def positions(
    df: DataFrame, spec: SeriesSpec, tie: Sequence[str] = (), first: int | None = None
) -> DataFrame:
    """Add ``__pos`` (0-based row number per entity) and ``__total`` (its rows).

    ``tie`` orders rows that share a timestamp. With ``first`` only the buckets
    that hold the first rows are read on, as a caller asks for no others. Rows without a timestamp have no
    position and are left out.
    """
    keys = spec.keys
    rows, counts = bucketed(df, spec)
    offsets = _offsets(counts, spec).drop("__n")
    if first is not None:
        offsets = offsets.where(F.col(OFFSET) < first)
    inside = by([*keys, BUCKET]).orderBy(spec.ts, *tie)
    return (
        rows.join(offsets, [*keys, BUCKET])
        .withColumn(POS, F.row_number().over(inside) - 1 + F.col(OFFSET))
        .drop(BUCKET, OFFSET)
    )


def rows_at_rank(
    df: DataFrame,
    spec: SeriesSpec,
    ranks: Sequence[Column],
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows at the given 0-based ranks (expressions over ``__total``) per entity."""
    keys = spec.keys
    rows, counts = bucketed(df, spec)
    wanted = _offsets(counts, spec).withColumn("__ranks", F.array(*[r.cast("long") for r in ranks]))
    holding = wanted.where(
        F.exists("__ranks", lambda r: (r >= F.col(OFFSET)) & (r < F.col(OFFSET) + F.col("__n")))
    ).drop("__n")
    inside = by([*keys, BUCKET]).orderBy(spec.ts, *tie)
    return (
        rows.join(holding, [*keys, BUCKET])
        .withColumn(POS, F.row_number().over(inside) - 1 + F.col(OFFSET))
        .where(F.array_contains("__ranks", F.col(POS)))
        .drop(BUCKET, OFFSET, "__ranks")
    )


def with_pos(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``__pos``: the grid index when the series has no gaps, else counted."""
    if spec.gap_free:
        return df.withColumn(POS, spec.index())
    return positions(df, spec).drop(TOTAL)


def with_halo(df: DataFrame, chunk_rows: int, back: int, ahead: int) -> DataFrame:
    """Copy each row to every chunk whose windows can see it; needs ``__pos``."""
    home = floor_div(F.col(POS), chunk_rows)
    if not back and not ahead:
        return df.withColumn(CHUNK, home).withColumn(HOME, F.lit(True))
    first = floor_div(F.col(POS) - F.lit(ahead), chunk_rows)
    last = floor_div(F.col(POS) + F.lit(back), chunk_rows)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        HOME, F.col(CHUNK) == home
    )


def windowed(
    df: DataFrame,
    spec: SeriesSpec,
    stages: Sequence[Stage],
    back: int = 0,
    ahead: int = 0,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Run window stages that look at most ``back`` rows back and ``ahead`` on.

    The reach is summed over the stages by the caller. All stages share one
    exchange and one sort; the values equal those of an unchunked window.
    """
    keys = [*spec.keys, *extra_keys]
    laid = df if POS in df.columns else with_pos(df, spec)
    kept_pos = POS in df.columns
    laid = in_parts(with_halo(laid, spec.chunk_rows, back, ahead), [*keys, CHUNK])
    w = by([*keys, CHUNK]).orderBy(POS)
    for stage in stages:
        laid = laid.withColumns(dict(stage(w)))
    out = laid.where(HOME).drop(CHUNK, HOME)
    return out if kept_pos else out.drop(POS)


def chunk_edges(df: DataFrame, keys: Sequence[str], cols: Sequence[str], at: str) -> DataFrame:
    """Per chunk: nearest valid (at, value) before and after it, for each column.

    Needs ``__chunk`` and ``__pos``. Gives ``{c}__before`` and ``{c}__after``.
    """
    first = [
        F.min_by(F.struct(F.col(at).alias("at"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"{c}__f")
        for c in cols
    ]
    last = [
        F.max_by(F.struct(F.col(at).alias("at"), F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"{c}__l")
        for c in cols
    ]
    earlier = Window.unboundedPreceding, -1
    before = by(keys).orderBy(CHUNK).rowsBetween(*earlier)
    # read backwards: a frame that grows is updated row by row, one that shrinks
    # towards the end is computed anew for every row
    after = by(keys).orderBy(F.desc(CHUNK)).rowsBetween(*earlier)
    return df.groupBy(*keys, CHUNK).agg(*first, *last).select(
        *keys,
        CHUNK,
        *[F.last(f"{c}__l", ignorenulls=True).over(before).alias(f"{c}__before") for c in cols],
        *[F.last(f"{c}__f", ignorenulls=True).over(after).alias(f"{c}__after") for c in cols],
    )


def running_sum(
    df: DataFrame,
    spec: SeriesSpec,
    sums: Mapping[str, str],
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Running sum per entity of each column in ``sums`` (new name -> column)."""
    keys = [*spec.keys, *extra_keys]
    laid = df if POS in df.columns else with_pos(df, spec)
    laid = laid.withColumn(CHUNK, floor_div(F.col(POS), spec.chunk_rows))
    totals = laid.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    carry = prefix_sums(totals, keys, CHUNK, BLOCK, {f"__c_{n}": f"__t_{n}" for n in sums}).select(*keys, CHUNK, *[f"__c_{n}" for n in sums])
    inside = by([*keys, CHUNK]).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(carry, [*keys, CHUNK]).withColumns(
        {n: F.sum(c).over(inside) + F.col(f"__c_{n}") for n, c in sums.items()}
    )
    out = out.drop(CHUNK, *[f"__c_{n}" for n in sums])
    return out if POS in df.columns else out.drop(POS)
