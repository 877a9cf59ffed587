"""Helpers shared by the operators: row keys, Arrow passes, connected components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from gridcast.plans.storage import materialize

KEY = ("__a", "__b")


def row_key(ident: Column, text: Column) -> list[Column]:
    """A 128-bit key of a row; equal rows share it, nulls are allowed."""
    absent = F.isnull(text)
    return [F.xxhash64(ident, text, absent).alias("__a"), F.xxhash64(absent, text, ident).alias("__b")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and row key; only these columns are taken on, so no other name can clash."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    return docs.select(ident.alias("__id"), text.alias("__text"), *row_key(ident, text))


def hash_share(hashes: Column, wanted: int, of: int) -> Column:
    """True for about ``wanted`` of ``of`` rows (all, if there are fewer), by their hashes alone.

    Unlike a top-k, no task gathers candidates of all others.
    """
    return F.pmod(hashes, F.lit(1 << 31)) < int((1 << 31) * min(1.0, wanted / max(of, 1)))


#: Bytes of rows that cross to Python at once, in sessions that keep Spark's own setting of 64 MB.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches be bounded by bytes: texts are of any length, and an executor holds several batches."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) in ("67108864b", "64MB"):
        conf.set(_BATCH_SETTING, BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system: a Python worker is used again by later stages, and
    allocators keep what the largest batch so far has taken."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def arrow_pass(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = step(batch)
            del batch
            if out is not None and out.num_rows:
                yield out
            del out
            give_back()

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, step: Callable[..., pa.Array], args: list[Column], fields: str) -> DataFrame:
    """Add the fields of a struct that ``step`` computes from Arrow arrays of ``args``.

    Only the arguments cross to Python and only the fields come back; the other
    columns of the row, long texts among them, stay in the JVM. The function runs once
    a row, also where a later filter asks for a field.
    """
    small_batches(df)
    schema = T.StructType.fromDDL(fields)
    names = [f"c{i}" for i in range(len(df.columns))]

    def tidy(*arrays: pa.Array) -> pa.Array:
        out = step(*arrays)
        give_back()
        return out

    found = F.arrow_udf(tidy, schema).asNondeterministic()(*args).alias("found")
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], found)
    return out.select(*names, *[F.col("found")[f] for f in schema.names]).toDF(*df.columns, *schema.names)


def first_of_each(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it occurs again in the array, and whether it is the first such."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    again, first = np.zeros(len(values), bool), np.ones(len(values), bool)
    again[order[1:]] = same
    first[order[1:]] = ~same
    again[order[:-1]] |= same
    return again, first


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node.

    After a given number of ``rounds`` it stops: nodes with equal roots are connected then,
    but a component may still have several roots.

    Alternating large-star and small-star rounds; each round is written to the
    shared folder, and only a count and a checksum come to the driver. The number
    of rounds is logarithmic in the size of the largest component.
    """
    bigger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now, mark = _stored(edges.where("u <> v").select(bigger, smaller).distinct())
    while mark[0] and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = mark
        now, mark = _stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if mark == last:
            break
    if rounds == 0:  # a node may still have several smaller ones, and a root one of its own
        star = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        tops = star.select(F.col("root").alias("node"), "root").distinct().join(star.select("node"), "node", "left_anti")
        return star.unionByName(tops)
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, with their number and a checksum that the same job counts."""
    seen = Observation()
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    now = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), mark))
    return now, (seen.get["n"], seen.get["mark"])


def run_pass(
    df: DataFrame, keys: list[str], step: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``step`` to groups of rows with equal (integer) keys, many groups at a time.

    ``step`` gets a table of whole groups and their row splits. Groups must be small:
    callers cut them into units of bounded size, as only such a unit is held at once.
    """
    small_batches(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            splits = _splits(rest, keys)
            if len(splits) > 2:  # the last group may go on in the next batch
                out = step(rest.slice(0, splits[-2]).combine_chunks(), splits[:-1])
                rest = rest.slice(splits[-2])
                if out is not None and out.num_rows:
                    yield out
                del out
                give_back()
        if rest is not None:
            out = step(rest.combine_chunks(), _splits(rest, keys))
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _splits(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for key in keys:
        values = table.column(key).to_numpy()
        change |= values[1:] != values[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


FILTER_BITS = 23


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter over two columns of 64-bit hashes: 2**23 bits, however many keys.

    It spares a shuffle most of the rows that a join would drop; the join itself
    still follows, so a filter that many keys have filled only saves less.
    """
    places = keys.select(F.explode(F.array(*[F.shiftrightunsigned(c, 64 - FILTER_BITS) for c in keys.columns])).alias("at"))
    words = places.groupBy(F.expr("cast(at div 32 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    rows = words.toArrow()
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a column of the filter."""
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
