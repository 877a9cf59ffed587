"""Benchmark contamination: words of documents inside a window of a benchmark item.

Prefix-filtered containment join: the words of the benchmark are ordered by how
often they occur in the whole corpus, rare ones first. A document that holds a
window holds its rarest word, so that one word is the prefix of the window (the
whole window must be contained). Every occurrence of a prefix word proposes the
places where its windows would start; the bounds of position and length drop
those that would begin before the text or end behind it, and hashes of all words
of the window verify the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.frames import give_back, small_batches

#: Windows of one broadcast index (48 bytes each). A larger benchmark is dealt out
#: to several indexes by item, and the documents are searched once for each.
MAX_WINDOWS = 1_000_000


@dataclass
class Index:
    """Distinct windows sorted by their rarest word."""

    word: np.ndarray  # hash of the rarest word
    offset: np.ndarray  # its place in the window
    length: np.ndarray
    hash: np.ndarray
    check: np.ndarray  # a second, independent hash
    items: list[list]  # ids of the items that hold the window

    def find(self, ws: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in the rows of a slice."""
        h = ws.hashes()
        low = np.searchsorted(self.word, h, "left")
        n = np.zeros(len(h), np.int64)
        held = np.flatnonzero(low < len(self.word))
        held = held[self.word[low[held]] == h[held]]
        n[held] = np.searchsorted(self.word, h[held], "right") - low[held]
        place = np.repeat(held, n[held])
        window = np.repeat(low[held], n[held]) + np.arange(len(place)) - np.repeat(np.cumsum(n[held]) - n[held], n[held])
        start = place - self.offset[window]
        row = np.searchsorted(ws.splits, place, "right") - 1
        fits = (start >= ws.splits[row]) & (start + self.length[window] <= ws.splits[row + 1])
        start, window = start[fits], window[fits]
        end = start + self.length[window]
        same = ws.spans(h, start, end) == self.hash[window]
        start, window, end = start[same], window[same], end[same]
        if len(start):
            same = ws.spans(ws.hashes(1), start, end, 1) == self.check[window]
            start, window = start[same], window[same]
        return start, window


def _item_windows(ids: list, texts: list[str], size: int) -> list[tuple]:
    """(id, word hashes, window hash, second hash) of all windows of the items."""
    out = []
    for first_row, part in W.slices(pa.array(texts, pa.large_string())):
        ws = W.split(part, W.PLAIN)
        h, g = ws.hashes(), ws.hashes(1)
        for r in range(len(part)):
            a, b = int(ws.splits[r]), int(ws.splits[r + 1])
            n = min(size, b - a)
            starts = np.arange(a, b - n + 1) if n else np.zeros(0, np.int64)
            spans = ws.spans(h, starts, starts + n), ws.spans(g, starts, starts + n, 1)
            out += [(ids[first_row + r], h[s : s + n], x, y) for s, x, y in zip(starts, *spans)]
    return out


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the (sorted) vocabulary occurs in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = held.value, np.zeros(len(held.value), np.int64)
        for batch in batches:
            for _, texts in W.slices(batch.column("text")):
                h = W.split(texts, W.PLAIN).hashes()
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
            give_back()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    if not len(vocabulary):
        return {}
    small_batches(docs)
    sums = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(vocabulary[sums.column("at").to_numpy()].tolist(), sums.column("n").to_numpy().tolist()))


def build_index(items: list[tuple], docs: DataFrame, size: int) -> Index:
    """Index of the windows of (id, text) items, by counts over all ``docs`` (column text)."""
    windows = _item_windows([i for i, _ in items], [t or "" for _, t in items], size)
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w[1] for w in windows]]))
    counts = word_counts(docs, vocabulary)
    distinct: dict[tuple[int, int], tuple] = {}
    for item, h, x, y in windows:
        entry = distinct.get((int(x), int(y)))
        if entry is None:
            # rarest first; equal counts by hash, so that the order is the same in all windows
            at = min(range(len(h)), key=lambda i: (counts.get(int(h[i]), 0), int(h[i]), i))
            entry = distinct[(int(x), int(y))] = (int(h[at]), at, len(h), int(x), int(y), set())
        if item is not None:
            entry[5].add(item)
    rows = sorted(distinct.values(), key=lambda e: e[:5])
    cols = [np.array([r[i] for r in rows], t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.uint64, np.uint64))]
    return Index(*cols, [sorted(r[5], key=str) for r in rows])


NEW = ("n_words", "hit_words", "items")


FIELDS = "n_words bigint, hit_words array<bigint>, items array<string>"


def _hits(index):
    """Number of words, words hit and items found of each text, for one index."""

    def step(column: pa.Array) -> pa.Array:
        n_words, hits, items = [], [], []
        for _, texts in W.slices(column):
            ws = W.split(texts, W.PLAIN)
            start, window = index.value.find(ws)
            row = np.searchsorted(ws.splits, start, "right") - 1
            length = index.value.length[window]
            edge = np.bincount(start, minlength=len(ws.start) + 1) - np.bincount(start + length, minlength=len(ws.start) + 1)
            place = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            counts = np.bincount(np.searchsorted(ws.splits, place, "right") - 1, minlength=len(texts))
            hits += np.split(place - np.repeat(ws.splits[:-1], counts), np.cumsum(counts)[:-1])
            of_row: list[set] = [set() for _ in range(len(texts))]
            for r, w in sorted({*zip(row.tolist(), window.tolist())}):
                of_row[r].update(map(str, index.value.items[w]))
            items += [sorted(s) for s in of_row]
            n_words += ws.counts.tolist()
        arrays = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
        give_back()
        return pa.StructArray.from_arrays(arrays, names=list(NEW))

    return step


def _item_parts(benchmark: DataFrame, size: int, most: int) -> list[DataFrame]:
    """The items, dealt out so that each part has at most about ``most`` windows."""
    windows = F.greatest(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))), F.lit(0))
    total = benchmark.agg(F.sum(windows)).first()[0] or 0
    parts = -(-int(total) // most)
    if parts <= 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(2 * parts))
    return [benchmark.where(part == i) for i in range(2 * parts)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Words of each document that lie in an occurrence of a window of an item.

    Words are runs of 0-9, a-z (A-Z lower-cased) and of characters above 0x7F.
    Windows are ``size`` consecutive words of an item, or the whole of a shorter
    one. Adds (n_words, hit_words, items, contaminated) to the columns of ``docs``
    (those named like the new ones are replaced), one row per input row: the sorted
    numbers of the words hit, and the ids of the items with an occurring window,
    sorted as strings. A null or empty text has no words and is
    hit by nothing; an item without words has no window; an item without an id
    hits words but is not listed; equal items are listed once under each id;
    repeated rows give repeated results.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    benchmark = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    names = [c for c in docs.columns if c not in (*NEW, "contaminated")]
    found = []
    for part in _item_parts(benchmark, size, max_windows):
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], texts, size))
        text = F.col(f"`{text_col}`").cast("string")
        found.append(F.arrow_udf(_hits(index), FIELDS).asNondeterministic()(text))
    small_batches(docs)
    parts = [f"f{i}" for i in range(len(found))]
    kept = [f"c{i}" for i in range(len(names))]
    out = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], *[f.alias(p) for f, p in zip(found, parts)])
    words, items = (F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)[c] for p in parts])))) for c in NEW[1:])
    out = out.select(*kept, F.col(parts[0])["n_words"], words, items).toDF(*names, *NEW)
    return out.withColumn("contaminated", F.size("hit_words") > 0)
