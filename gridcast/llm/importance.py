"""Importance resampling towards a target: hashed n-gram counts, Gumbel noise, top share.

Every document gets the mean log ratio of target and corpus frequencies over its
n-grams. The n-grams of a slice of texts are interned in an open-addressed table
(``intern.py``), each slot holds the bucket of its n-gram and how often the slice
has it, and the slot numbers of the occurrences then gather the gains. Only the
counts by bucket come to the driver; a fixed noise by id turns the ranking into a
draw without replacement, and the highest scores are numbered over range
partitions, so no task sees all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import words as W
from gridcast.llm.frames import arrow_pass, give_back, small_batches
from gridcast.llm.intern import Interned, intern, padded
from gridcast.plans.order import numbered
from gridcast.plans.storage import materialize

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Resampling:
    """Runs of ``low`` to ``high`` words in ``buckets`` buckets; ``percent`` of the
    documents of at least ``least_words`` words are drawn, with noise by ``seed``."""

    low: int = 1
    high: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


@dataclass
class Grams:
    """Interned n-grams of a slice of texts; ``splits`` bounds the occurrences of each n by row."""

    table: Interned
    bucket: np.ndarray
    splits: list[np.ndarray]
    words: np.ndarray

    def row_sums(self, value: np.ndarray) -> np.ndarray:
        """For each row the sum of a value per bucket over its occurrences."""
        total = np.zeros(len(self.table.slot) + 1, np.int64)
        np.cumsum(value[self.bucket][self.table.slot], out=total[1:])
        return sum(total[s[1:]] - total[s[:-1]] for s in self.splits)

    def row_sizes(self) -> np.ndarray:
        return sum(np.diff(s) for s in self.splits)


def grams(texts: pa.Array, how: Resampling) -> Grams:
    """The n-grams of the rows of a slice, as lower-case words joined by one space."""
    ws = W.split(texts, W.PLAIN)
    counts = ws.counts
    if how.high > 1:
        ws = W.split(W.join_words(ws, np.ones(len(ws.start), bool)), W.PLAIN)
    data = padded(LOWER[ws.data])
    last = np.repeat(ws.splits[1:], ws.counts)
    start, end, splits, done = [], [], [], 0
    for n in range(how.low, how.high + 1):
        first = np.flatnonzero(np.arange(len(last)) + n <= last)
        start.append(ws.start[first])
        end.append(ws.end[first + n - 1])
        splits.append(done + np.searchsorted(first, ws.splits))
        done += len(first)
    start, end = np.concatenate(start), np.concatenate(end)
    table = intern(data, start, end - start)
    view = memoryview(data)
    crc = [zlib.crc32(view[a:b]) for a, b in zip(table.start.tolist(), (table.start + table.length).tolist())]
    return Grams(table, np.array(crc, np.int64) % how.buckets, splits, counts)


def bucket_counts(docs: DataFrame, how: Resampling) -> np.ndarray:
    """How many n-grams of all rows (column ``text``) each bucket holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for batch in batches:
            for _, texts in W.slices(batch.column("text")):
                g = grams(texts, how)
                np.add.at(total, g.bucket, g.table.count)
            give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    small_batches(docs)
    parts = docs.select("text").mapInArrow(run, "bucket long, n long")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # one row for each bucket at most
    out = np.zeros(how.buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target and source share of each bucket, floored."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratios = ((target + 1.0) * of_source / ((source + 1.0) * of_target)).tolist()
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _noise(ident: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel variable, floored, by the hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, how: Resampling) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row of (id, text)."""
    gains = bucket_gains(bucket_counts(docs, how), bucket_counts(target, how))
    held = docs.sparkSession.sparkContext.broadcast(gains)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, sizes, sums = [], [], []
        for _, texts in W.slices(batch.column("text")):
            g = grams(texts, how)
            n_words.append(g.words)
            sizes.append(g.row_sizes())
            sums.append(g.row_sums(held.value))
        sizes, sums = np.concatenate(sizes), np.concatenate(sums)
        weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
        columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in (np.concatenate(n_words), sizes, weight))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "weight"])

    schema = T.StructType([docs.schema["id"]]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    weighed = arrow_pass(docs.select("id", "text"), step, schema)
    return weighed.withColumn("score", F.col("weight") + _noise(F.col("id"), how.seed))


def resample(
    docs: DataFrame,
    target: DataFrame,
    how: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Draw a share of the documents, those like the target texts more often.

    Returns (id, n_words, n_features, weight, score, rank), one row per row of
    ``docs``; rank counts the drawn documents from 1 by falling score, ties by rising
    id (null ids first, their noise is that of an empty id), and is null for the rest.
    Words are runs of 0-9, a-z (A-Z lower-cased) and of characters above 0x7F. A null
    or empty text has no n-grams and weight 0; documents of fewer than ``least_words``
    words are weighed, not drawn; repeated rows are drawn each; without target texts,
    or without documents, the smoothed counts still give a finite gain; other columns
    are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = target.select(F.col(f"`{target_text_col}`").cast("string").alias("text"))
    scored = materialize(weigh(rows, texts, how))
    able = F.col("n_words") >= how.least_words
    # one row for each integer between the least and the highest score: some ten thousand, however many documents
    by_score = scored.where(able).groupBy("score").count().toArrow().sort_by([("score", "descending")])
    counts = np.cumsum(by_score.column("count").to_numpy())
    wanted = how.percent * int(counts[-1]) // 100 if len(counts) else 0
    rank = F.lit(None).cast("long")
    if wanted:
        least = by_score.column("score")[int(np.searchsorted(counts, wanted))].as_py()
        near = able & (F.col("score") >= least)
        place = F.col("place") + 1
        top = numbered(scored.where(near), [F.desc("score"), F.asc_nulls_first("id")], "place")
        top = top.withColumn("rank", F.when(place <= wanted, place)).drop("place")
        out = scored.where(~near).withColumn("rank", rank).unionByName(top)
    else:
        out = scored.withColumn("rank", rank)
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
