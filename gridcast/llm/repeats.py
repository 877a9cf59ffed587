"""Words inside runs that occur more than once, found through anchors.

An operator chooses anchors: places of a text such that any two equal runs of
``window`` words hold one at the same distance of at most ``reach`` words from their
starts. So equal runs share an equal anchor, the ``window - reach`` words from its
place on. Only anchors are hashed, shuffled and sorted, with a hash of their
context: the words that any window around the anchor can reach. Where the whole
context occurs twice, all these windows do. Only around equal anchors whose contexts
differ, at the ends of a match, are single windows compared, by 128-bit hashes of
all their words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import words as W
from gridcast.llm.frames import KEY, arrow_pass, first_of_each, keyed
from gridcast.plans.storage import materialize

#: Gives the (sorted) word numbers of the anchors in a slice, from its words and their hashes.
Choice = Callable[[W.Words, np.ndarray], np.ndarray]


def _rows(keys: list[np.ndarray], a: np.ndarray, b: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows (k0, k1, a, b, at) where ``at`` is 2 * place + known.

    ``known``: the key occurs again in this batch. All but the first such row get
    the row key instead, so a run that a third of the corpus shares reaches the
    shuffle once per batch, not once per document.
    """
    joint = W.mix(keys[0].view(np.uint64) ^ W.mix(keys[1].astype(np.int64).view(np.uint64)))
    again, first = first_of_each(joint)
    lone = again & ~first
    k0 = np.where(lone, a, keys[0].view(np.int64))
    k1 = np.where(lone, b.astype(keys[1].dtype), keys[1])
    cols = [k0, k1, a, b, (2 * at + again).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["k0", "k1", *KEY, "at"])


def _anchors(window: int, reach: int, choose: Choice):
    """Anchors with a name of their context: all windows around them, cut at the ends of the text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in KEY)
        parts = []
        for first_row, texts in W.slices(batch.column("__text")):
            ws = W.split(texts, W.EXACT)
            h, other = ws.hashes(), ws.hashes(1)
            place = choose(ws, h)
            row = np.searchsorted(ws.splits, place, "right") - 1
            pos = place - ws.splits[row]
            anchor = ws.spans(h, place, place + window - reach)
            left = np.minimum(pos, reach)
            right = np.minimum(ws.counts[row] - pos, window)
            around = ws.spans(other, place - left, place + right, 1)
            around = W.mix(around + (left * (window + 1) + right).astype(np.uint64))
            parts.append((anchor, around.view(np.int64), row + first_row, pos))
        if not parts:
            return None
        anchor, around, row, pos = (np.concatenate(x) for x in zip(*parts))
        return _rows([anchor, around], a[row], b[row], pos)

    return step


def _judged(anchors: DataFrame) -> DataFrame:
    """By document: anchors whose windows are all repeated, and those to look at closely.

    ``code`` is 4 * place + 2 * closed + look. An anchor is closed if its whole
    context occurs again. If a group of equal anchors has a member that is not,
    one member of each context of the group shows its windows.
    """
    group, context = Window.partitionBy("k0"), Window.partitionBy("k0", "k1")
    known = F.col("at").bitwiseAND(F.lit(1)) == 1
    # dealt by the shorter key, which serves both windows
    rows = anchors.repartition("k0").withColumns(
        {"closed": known | (F.count(F.lit(1)).over(context) > 1), "first": F.row_number().over(context.orderBy("__a", "__b", "at")) == 1}
    ).withColumns({"open": F.max(~F.col("closed")).over(group), "n": F.count(F.lit(1)).over(group)})
    look = (~F.col("closed") & (F.col("n") > 1)) | (F.col("closed") & F.col("first") & F.col("open"))
    code = F.expr("4 * (at div 2)") + F.when(F.col("closed"), 2).otherwise(0) + F.when(look, 1).otherwise(0)
    judged = rows.withColumn("code", code.cast("int")).where("code % 4 > 0")
    return judged.groupBy(*KEY).agg(F.collect_set("code").alias("codes"))


def _spread(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    edge = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def _lists(batch: pa.RecordBatch, name: str, first_row: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the slice, value) of the lists of the rows of a slice."""
    lists = batch.column(name).slice(first_row, n_rows)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(n_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(window: int, reach: int):
    """The windows around the anchors to look at."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in KEY)
        parts = []
        for first_row, texts in W.slices(batch.column("__text")):
            row, code = _lists(batch, "codes", first_row, len(texts))
            row, code = row[code % 2 == 1], code[code % 2 == 1]
            if not len(row):
                continue
            ws = W.split(texts, W.EXACT)
            place = ws.splits[row] + code // 4
            near = _spread(np.maximum(place - reach, ws.splits[row]), place + 1, len(ws.start))
            first, h = ws.windows(window, ws.hashes())
            other = ws.windows(window, ws.hashes(1), 1)[1]
            take = near[first]
            first = first[take]
            row = np.searchsorted(ws.splits, first, "right") - 1
            parts.append((h[take], other[take].view(np.int64), row + first_row, first - ws.splits[row]))
        if not parts:
            return None
        h, other, row, pos = (np.concatenate(x) for x in zip(*parts))
        return _rows([h, other], a[row], b[row], pos)

    return step


def _runs(ws: W.Words, gone: np.ndarray) -> pa.ListArray:
    """By row, the ranges of words that are gone."""
    before = np.zeros(len(gone) + 1, bool)
    before[1:] = gone
    before[ws.splits] = False
    after = np.zeros(len(gone) + 1, bool)
    after[:-1] = gone
    after[ws.splits] = False
    start, end = np.flatnonzero(gone & ~before[:-1]), np.flatnonzero(gone & ~after[1:]) + 1
    row = np.searchsorted(ws.splits, start, "right") - 1
    base = ws.splits[row]
    pairs = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ws.counts) + 1)).astype(np.int32)), pairs)


def _cut(window: int, reach: int):
    def covered(batch: pa.RecordBatch, first_row: int, ws: W.Words) -> np.ndarray:
        row, code = _lists(batch, "codes", first_row, len(ws.counts))
        row, place = row[code // 2 % 2 == 1], code[code // 2 % 2 == 1] // 4
        low = ws.splits[row] + np.maximum(place - reach, 0)
        high = ws.splits[row] + np.minimum(place + window, ws.counts[row])
        again, start = _lists(batch, "starts", first_row, len(ws.counts))
        start = start + ws.splits[again]
        return _spread(np.concatenate([low, start]), np.concatenate([high, start + window]), len(ws.start))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        totals, removed, kept, runs = [], [], [], []
        for first_row, texts in W.slices(batch.column("__text")):
            ws = W.split(texts, W.EXACT)
            gone = covered(batch, first_row, ws)
            before = np.concatenate([[0], np.cumsum(gone)])
            totals.append(ws.counts)
            removed.append(before[ws.splits[1:]] - before[ws.splits[:-1]])
            kept.append(W.join_words(ws, ~gone))
            runs.append(_runs(ws, gone))
        if not kept:
            return None
        columns = [
            batch.column("__id"),
            pa.array(np.concatenate(totals).astype(np.int64)),
            pa.array(np.concatenate(removed).astype(np.int64)),
            pa.concat_arrays(kept).cast(pa.string()),
            pa.concat_arrays(runs),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["__id", "n_words", "n_removed", "kept_text", "runs"])

    return step


RUNS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))


def cut_repeats(docs: DataFrame, id_col: str, text_col: str, window: int, reach: int, choose: Choice) -> DataFrame:
    """(id, n_words, n_removed, kept_text, runs): each text without the words of repeated windows."""
    rows = keyed(docs, id_col, text_col)
    anchors = arrow_pass(rows.select("__text", *KEY), _anchors(window, reach, choose), "k0 long, k1 long, __a long, __b long, at int")
    judged = materialize(_judged(anchors))
    # both joins below read the same exchange of the texts by key
    near = rows.join(judged.where(F.exists("codes", lambda c: c % 2 == 1)), list(KEY))
    found = arrow_pass(near.select("__id", "__text", *KEY, "codes"), _windows(window, reach), "k0 long, k1 long, __a long, __b long, at int")
    w = Window.partitionBy("k0", "k1")
    again = found.withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1 or at % 2 = 1")
    starts = again.groupBy(*KEY).agg(F.collect_set(F.expr("at div 2")).alias("starts"))
    marked = rows.join(judged, list(KEY), "left").join(starts, list(KEY), "left").select("__id", "__text", "codes", "starts")
    schema = T.StructType([rows.schema["__id"]]).add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("runs", RUNS)
    return arrow_pass(marked, _cut(window, reach), schema).withColumnRenamed("__id", id_col)
