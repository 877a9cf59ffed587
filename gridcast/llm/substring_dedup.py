"""Removal of word runs that occur more than once in a corpus, by difference-cover anchors.

A cover ``D`` of the residues modulo a period ``v`` has, for any two positions i and
j, a shift ``d < v`` with both ``i + d`` and ``j + d`` in ``D`` (modulo v). So if a
window of ``w`` words starts at i in one document and at j in another, both hold the
same run of ``w - v + 1`` words at cover positions: an anchor that is aligned in
both. About a quarter of the positions are anchors; ``repeats`` sorts them and
extends what is equal.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from gridcast.llm import words as W
from gridcast.llm.repeats import Choice, cut_repeats


@lru_cache(maxsize=32)
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences give every residue; holds 0 and 1."""
    if period < 4:
        return tuple(range(min(period, 2)))
    size = 2
    while True:
        for rest in combinations(range(2, period), size - 2):
            cover = (0, 1, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
        size += 1


def aligned_places(window: int, period: int) -> Choice:
    """Cover positions, counted from the start of each document, with a whole anchor behind them."""
    length = window - period + 1
    aligned = np.zeros(period, bool)
    aligned[list(difference_cover(period))] = True

    def choose(ws: W.Words, h: np.ndarray) -> np.ndarray:
        counts = ws.counts
        pos = np.arange(len(h)) - np.repeat(ws.splits[:-1], counts)
        n = np.repeat(counts, counts)
        return np.flatnonzero(aligned[pos % period] & (n >= window) & (pos + length <= n))

    return choose


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, period: int | None = None
) -> DataFrame:
    """Remove every word covered by a run of ``window`` words that starts elsewhere too.

    Words are runs without ASCII white space, unchanged. Windows are judged on the
    input. Returns (id, n_words, n_removed, kept_text, runs), one row per input row: the
    kept words joined by one space, and the ranges of words removed. A null or empty
    text has no words and gives an empty string; a document of fewer than ``window``
    words keeps all of them; a repeated row counts as another document, so long copies
    lose all their words; a null id is kept as it is. Other columns are ignored. An
    empty table gives none.

    ``period`` is the period of the difference cover (at most ``window``): the larger,
    the fewer and shorter anchors. It does not change the result.
    """
    period = period or max(1, min(21, window * 3 // 5))
    return cut_repeats(docs, id_col, text_col, window, period - 1, aligned_places(window, period))
