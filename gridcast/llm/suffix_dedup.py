"""Removal of repeated passages, by hashes at minimisers.

Hashing replaces the sparse suffix array that this operator was to use: no suffix is
sorted by its words and no neighbours are compared. Only anchors at minimiser
positions are retained:
the places whose ``gram`` words have the smallest hash among ``spread`` places in a
row. The content alone selects them, so a passage that occurs twice has the same
ones at the same distances. Equal anchors meet by hash, and the words around them
that a passage can reach are compared by hash too (``repeats``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gridcast.llm import words as W
from gridcast.llm.repeats import Choice, cut_repeats


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of each ``width`` values in a row (for all full windows)."""
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        done += step
    return at


def minimisers(window: int, spread: int, gram: int) -> Choice:
    """The minimiser of the first ``spread`` places of every full window of a document."""

    def choose(ws: W.Words, h: np.ndarray) -> np.ndarray:
        last = np.repeat(ws.splits[1:], ws.counts)
        starts = np.flatnonzero(np.arange(len(h)) + window <= last)
        if not len(starts):
            return starts
        grams = W.mix(ws.spans(h, np.arange(len(h)), np.minimum(np.arange(len(h)) + gram, len(h))))
        return np.unique(sliding_argmin(grams, spread)[starts])

    return choose


def remove_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 50,
    spread: int = 16,
    gram: int = 3,
) -> DataFrame:
    """Remove every passage of at least ``least_words`` words that occurs elsewhere too.

    Words are runs without ASCII white space, unchanged; passages are judged on the
    input, in the same document as well. Returns (id, n_words, n_removed, kept_text,
    runs), one row per input row: the kept words joined by one space, and the ranges of
    words removed. A null or empty text has no words and gives an empty string; a
    document of fewer than ``least_words`` words keeps all of them; a repeated row
    counts as another document; a null id is kept as it is. Other columns are ignored.
    An empty table gives none. ``spread`` and ``gram`` do not change the result.
    """
    if spread + gram - 1 > least_words:
        raise ValueError("the places of a minimiser must lie in one passage")
    return cut_repeats(docs, id_col, text_col, least_words, spread - 1, minimisers(least_words, spread, gram))
