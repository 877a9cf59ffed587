"""Best-fit packing of tokenised documents into training sequences.

Documents are tokenised and cut into pieces in one pass. Packing is a vector
best-fit in decreasing order of length: a sequence has capacities in tokens, in
documents and in attention cost (the sum of squared lengths), and a piece goes to
the sequence with the smallest weighted norm of what would remain, among those
that hold it under every constraint. Pieces of one length are alike, so the
packing is worked out on the histogram of lengths, which has at most one entry for
each length however many documents there are: sequences with equal contents form a
group, and whole ranges of pieces go to ranges of sequences. Spark then numbers
the pieces of each length and looks up their range.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.frames import give_back, small_batches
from gridcast.llm.tokens import encoder
from gridcast.plans.storage import materialize

#: Pieces a worker remembers: fewer than it could, as other stages of a pipeline leave less room.
REMEMBERED = 50_000
#: Rows of one (length, bucket) group when pieces are numbered.
BUCKET_ROWS = 200_000
#: A plan of more ranges is joined by a shuffle.
MAX_BROADCAST = 200_000


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str, text_col: str, length: int, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): every document's ids and ``end_id``, cut at ``length``."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, REMEMBERED).encode
        for batch in batches:
            done = 0
            for found, splits in encode(batch.column("text")):
                ids = np.insert(found, splits[1:], np.uint32(end_id)).astype("<u4")
                bounds = splits + np.arange(len(splits))
                n = np.diff(bounds)
                parts = -(-n // length)
                row = np.repeat(np.arange(len(n)), parts)
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = bounds[row] + part * length
                size = np.minimum(length, n[row] - part * length)
                view = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist())]
                cols = [
                    batch.column("id").take(pa.array(done + row)),
                    pa.array(part.astype(np.int32)),
                    pa.array(part * length),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:  # the pieces of a slice follow each other without gaps
                    edges = np.append(first, len(ids)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(edges, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])
                done += len(n)
            give_back()

    schema = T.StructType([rows.schema["id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    small_batches(rows)
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and what a remainder of each counts in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.05)


@dataclass
class Group:
    """Sequences first .. first + count - 1, all filled alike."""

    tokens: int
    documents: int
    attention: int
    first: int
    count: int

    def add(self, length: int, times: int = 1) -> None:
        self.tokens -= length * times
        self.documents -= times
        self.attention -= length * length * times


def best_fit(histogram: Mapping[int, int], cap: Capacity) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranges (length, from, to, sequence of the first, offset), and the number of sequences.

    Pieces ``from .. to - 1`` of a length, in any fixed numbering, go to consecutive
    sequences at the same offset.
    """
    if histogram and (cap.documents < 1 or cap.tokens < max(histogram) or cap.attention < max(histogram) ** 2):
        raise ValueError("a sequence must hold the longest piece alone")
    plan: list[tuple[int, int, int, int, int]] = []
    groups: list[Group] = []
    used = 0
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    for length in sorted(histogram, reverse=True):
        n, at = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        while at < n:
            best = _choose(groups, need, caps, weights)
            if best is None:
                most = min(cap.tokens // length, cap.documents, cap.attention // length**2)
                at, used = _open(plan, groups, cap, length, at, n, most, used)
                continue
            group = groups[best]
            taken = min(n - at, group.count)
            plan.append((length, at, at + taken, group.first, cap.tokens - group.tokens))
            if taken < group.count:
                groups.append(replace(group, first=group.first + taken, count=group.count - taken))
                group.count = taken
            group.add(length)
            at += taken
        groups = [g for g in groups if g.tokens > 0 and g.documents > 0 and g.attention > 0]
    return plan, used


def _choose(groups: list[Group], need: np.ndarray, caps: np.ndarray, weights: np.ndarray) -> int | None:
    """The group with the smallest weighted norm of the remainder, if any has room."""
    if not groups:
        return None
    rest = np.array([(g.tokens, g.documents, g.attention) for g in groups], float) - need
    norm = (weights * (rest / caps) ** 2).sum(1)
    norm[(rest < 0).any(1)] = np.inf
    best = int(norm.argmin())
    return best if np.isfinite(norm[best]) else None


def _open(plan: list, groups: list[Group], cap: Capacity, length: int, at: int, n: int, most: int, used: int) -> tuple[int, int]:
    """New sequences for all that is left of a length: full ones, and one with the rest."""
    for bins, times in (((n - at) // most, most), (1, (n - at) % most)):
        if bins and times:
            for i in range(times):
                plan.append((length, at, at + bins, used, i * length))
                at += bins
            group = Group(cap.tokens, cap.documents, cap.attention, used, bins)
            group.add(length, times)
            groups.append(group)
            used += bins
    return at, used


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: Capacity = Capacity(),
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity.tokens`` tokens.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one
    row per piece: a document is its ids and ``end_id``; only a longer one is cut, into
    full pieces and a last one. Sequences are numbered from 0 and filled from offset 0
    without gaps. A null or empty text is ``end_id`` alone; repeated rows are packed
    each; a null id is kept; other columns are ignored; an empty table gives none.
    The tokenizer is a file of the ``tokenizers`` library.
    """
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, capacity.tokens, end_id, with_ids))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit(histogram, capacity)
    numbered = _numbered(cut, -(-sum(histogram.values()) // BUCKET_ROWS) or 1)
    schema = "length long, low long, high long, sequence long, offset long"
    ranges = docs.sparkSession.createDataFrame(plan, schema)
    if len(plan) <= MAX_BROADCAST:
        ranges = F.broadcast(ranges)
    ranges = ranges.withColumnRenamed("length", "l")
    out = numbered.join(ranges, (F.col("length") == F.col("l")) & (F.col("n") >= F.col("low")) & (F.col("n") < F.col("high")))
    named = out.withColumn("sequence_id", F.col("sequence") + F.col("n") - F.col("low"))
    kept = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return named.select(F.col("id").alias(id_col), *kept)


def _numbered(cut: DataFrame, buckets: int) -> DataFrame:
    """Add ``n``: the number of each piece among those of its length, from 0.

    Lengths are dealt out to buckets, so that a length that a third of all pieces
    have is not numbered in one task; prefix sums of the bucket sizes join them.
    """
    order = ["id", "piece", "ids_crc32"]
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    return rows.join(sizes, ["length", "bucket"]).withColumn("n", F.row_number().over(inside) - 1 + F.col("base"))
