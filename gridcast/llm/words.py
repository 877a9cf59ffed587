"""Words of whole texts as arrays, computed on Arrow text buffers.

A batch of texts is one byte buffer with row offsets. Words are found with a
table over byte values (both word definitions below are ASCII rules, so UTF-8
bytes above 0x7F always belong to words) and hashed by prefix sums of a
polynomial, so no Python loop runs over words. Rows are cut into slices of
about half a megabyte, so that the temporary arrays stay small; a longer text makes
a slice of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = (1 << 19) - 2  # so that tables of powers have 2**19 entries
BLANKS = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Power:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (self._series(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _series(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


BYTE_POWER = (Power(0x9E3779B97F4A7C15), Power(0xD6E8FEB86659FD93))
WORD_POWER = (Power(0xC2B2AE3D27D4EB4F), Power(0xA0761D6478BD642F))


@dataclass(frozen=True)
class Splitter:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    is_word: np.ndarray
    lower: bool

    @lru_cache(maxsize=8)  # noqa: B019 - two module-level instances
    def values(self, seed: int) -> np.ndarray:
        codes = np.arange(256, dtype=np.uint64)
        if self.lower:
            codes[65:91] += np.uint64(32)
        return mix(codes + np.uint64(1 + 1000 * seed))

    def __hash__(self) -> int:
        return id(self)


def _not_blank() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(BLANKS)] = False
    return table


def _alphanumeric() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


#: ``[^\x20\x09-\x0D]+`` as written, and with A-Z lower-cased.
EXACT = Splitter(_not_blank(), False)
FOLDED = Splitter(_not_blank(), True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
PLAIN = Splitter(_alphanumeric(), True)


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data`` and, by row, ``splits``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    splits: np.ndarray
    splitter: Splitter

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.splits)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.splits) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        up, down = BYTE_POWER[seed].to(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(self.splitter.values(seed)[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def spans(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of word ranges of any length, comparable with ``windows``."""
        n = len(hashes)
        up, down = WORD_POWER[seed].to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start])

    def windows(self, length: int, hashes: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of ``length`` words inside one row."""
        last = np.repeat(self.splits[1:], self.counts)
        first = np.flatnonzero(np.arange(len(hashes)) + length <= last)
        return first, self.spans(hashes, first, first + length, seed)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with at most ``limit`` bytes of text or a single row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first, done = 0, 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield first, texts.slice(first, last - first)
        done, first = int(ends[last - 1]), last


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a null-free large_string array."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array, splitter: Splitter) -> Words:
    """Words of the rows of a null-free large_string array (see ``slices``)."""
    data, offsets = buffer(texts)
    inside = splitter.is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), splitter)


def join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space."""
    flags = np.zeros(len(words.data) + 2, np.int8)
    rows = words.rows()[keep]
    start, end = words.start[keep], words.end[keep]
    joined = np.zeros(len(rows), bool)
    joined[:-1] = rows[1:] == rows[:-1]
    flags[start] += 1
    flags[end + joined] -= 1
    taken = np.cumsum(flags[:-2], dtype=np.int8).astype(bool)
    out = words.data.copy()
    out[end[joined]] = 32
    before = np.zeros(len(out) + 1, np.int64)
    np.cumsum(taken, out=before[1:])
    return pa.LargeStringArray.from_buffers(
        len(words.offsets) - 1, pa.py_buffer(before[words.offsets].astype(np.int64)), pa.py_buffer(out[taken])
    )


def fingerprints(*parts: np.ndarray) -> pa.Array:
    """16-byte binary values from two columns of 64-bit hashes."""
    pairs = np.ascontiguousarray(np.stack(parts, 1).astype(">u8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(pairs), [None, pa.py_buffer(pairs)]).cast(pa.binary())
