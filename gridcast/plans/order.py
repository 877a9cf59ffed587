"""Row numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.plans.storage import materialize

PART_BITS = 33  # what monotonically_increasing_id leaves for the rows of a partition


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based place of each row of a stored frame in the given order.

    Rows are dealt out by ranges of the order and sorted inside them. The row id of
    Spark then is the range and the place in it, and the sizes of the ranges (one
    row for each shuffle partition) are summed up. Rows that are equal in the order
    are kept apart by their place in the stored frame, so that many of them do not
    meet in one range. One exchange, written once.
    """
    rows = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    laid = materialize(laid.withColumn("__at", F.monotonically_increasing_id()))
    starts = range_starts(laid, "__at", F.count(F.lit(1)))
    place = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    out = laid.withColumn("__part", F.shiftright("__at", PART_BITS)).join(starts, "__part").withColumn(name, place)
    return out.drop("__part", "__at", "__base")


def range_starts(laid: DataFrame, at: str, size: Column) -> DataFrame:
    """(__part, __base): what the ranges before each one hold together.

    ``at`` is the row id that Spark gave the rows of a stored frame; there is one
    range for each partition that wrote it, so the result is small and broadcast.
    """
    sizes = laid.groupBy(F.shiftright(at, PART_BITS).alias("__part")).agg(size.alias("n")).collect()
    before, starts = 0, []
    for row in sorted(sizes):
        starts.append((row["__part"], before))
        before += row["n"]
    return F.broadcast(laid.sparkSession.createDataFrame(starts, "__part long, __base long"))
