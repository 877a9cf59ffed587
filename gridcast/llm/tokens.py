"""Token ids of whole texts, a slice of an Arrow batch at a time.

For a tokenizer that drops white space and splits letters, digits and marks before
its merges, a text can be cut at those borders without changing its ids. The pieces
of a slice are interned (``intern.py``), only the distinct ones are looked up, only
those not seen lately go to the tokenizer, and the ids of all occurrences are gathered. Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from gridcast.llm import words as W
from gridcast.llm.intern import intern, padded

#: Pieces remembered by a Python worker: two generations of this many (about 200 bytes each), unless asked for fewer.
REMEMBERED = 150_000
#: Longer pieces are not remembered.
LONGEST = 64
#: Bytes of text encoded at once.
SLICE = 1 << 19

# The steps before the merges that make the cuts below exact.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

BLANK, LETTER, DIGIT, MARK, WHOLE = range(5)


def _classes() -> np.ndarray:
    """The class of each byte; runs with a byte of class WHOLE are not cut."""
    table = np.full(256, MARK, np.uint8)
    table[list(W.BLANKS)] = BLANK
    table[0x41:0x5B] = table[0x61:0x7B] = LETTER
    table[0x30:0x3A] = DIGIT
    table[0x80:] = WHOLE  # but for the letters from U+00C0 to U+00FF, see ``pieces``
    table[[0x27, 0x7C]] = WHOLE  # apostrophes of contractions, bars of special tokens
    return table


CLASS = _classes()
#: Pieces that normalizing does not change: lower-case letters up to U+00FF, a digit, printable marks.
SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{}~]+")


def cuts_exactly(spec: dict) -> bool:
    """Whether the tokenizer's ids do not change when texts are cut by ``pieces``."""
    steps = (spec.get("normalizer") or {}).get("normalizers")
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = before[0].get("pattern") == {"Regex": SPLIT} and before[0].get("behavior") == "Removed" and before[0].get("invert")
    bytes_only = len(before) == 2 and before[1].get("type") == "ByteLevel" and not before[1].get("add_prefix_space")
    whole = all("|" in t["content"] for t in spec.get("added_tokens") or [])
    return bool(steps == NORMALIZER and split and bytes_only and whole and not spec.get("post_processor") and not spec.get("truncation"))


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded lower-case bytes, start, end, splits by row) of the pieces of a slice."""
    data, offsets = W.buffer(texts)
    data, kind = padded(data), CLASS[padded(data)]
    kind[len(data) - 8 :] = BLANK
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    data[np.flatnonzero((data >= 0x41) & (data <= 0x5A))] += 32
    data[lead[data[lead + 1] <= 0x9E] + 1] += 32
    edge = np.ones(len(data), bool)  # a piece or blank begins here
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    run = np.ones(len(data), bool)
    run[1:] = (kind[1:] == BLANK) != (kind[:-1] == BLANK)
    run[offsets] = True
    heads = np.flatnonzero(run)
    whole = np.maximum.reduceat(kind, heads) == WHOLE
    edge &= ~np.repeat(whole, np.diff(np.append(heads, len(data))))
    edge |= run
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    held = kind[start] != BLANK
    start, end = start[held], end[held]
    return data, start, end, np.searchsorted(start, offsets)


class Encoder:
    """Ids of texts by a tokenizer file, without special tokens of its own."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_pieces = cuts_exactly(json.load(f))
        self.merges = self.tokenizer.model.tokenize
        if self.by_pieces:  # how the letters from U+00DF to U+00FF are written for the merges
            spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.letters = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, splits by row) of each slice of the rows, null texts as empty ones."""
        for _, part in W.slices(texts, SLICE):
            yield self._slice(part) if self.by_pieces else self._whole(part)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        splits = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.array([i for x in ids for i in x], np.uint32), splits

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, start, end, splits = pieces(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(splits), np.int64)
        table = intern(data, start, end - start)
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(table.start.tolist(), (table.start + table.length).tolist())]
        found = self._look_up(keys)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        n = sizes[table.slot]
        before = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[table.slot] - before[:-1], n) + np.arange(before[-1])
        return flat[at], before[splits]

    def _look_up(self, keys: list[bytes]) -> list[bytes]:
        recent, older = self.recent, self.older
        found = list(map(recent.get, keys))
        for i in [i for i, value in enumerate(found) if value is None]:
            key = keys[i]
            found[i] = value = older.get(key) or self._ask(key)
            if len(key) <= LONGEST:
                recent[key] = value
        if len(recent) > self.remembered:
            self.recent, self.older = {}, recent
        return found

    def _ask(self, key: bytes) -> bytes:
        """Ids of a piece, by the merges alone where the steps before them are known to do nothing more."""
        text = key.decode()
        if key.isalpha():  # of ASCII letters, which the merges take as they are
            ids = [t.id for t in self.merges(text)]
            return struct.pack(f"<{len(ids)}I", *ids)
        if SIMPLE.fullmatch(key):
            ids = [t.id for t in self.merges(text.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, remembered)
