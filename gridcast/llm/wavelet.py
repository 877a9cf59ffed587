"""A wavelet matrix over token ids, kept in one compressed file.

Level by level, from the highest bit, the matrix stores one bit of every id and
then moves ids with a zero before those with a one, keeping their order. The bits
of a level with a directory of running counts answer rank (how many ones before a
place) and select (where the k-th one is), and these lead from a place to its id,
from an id to its number of occurrences, and from an occurrence back to its place.
All methods take and return arrays.

File: the four letters ``WMX1``, the sizes of the head and of its parts, a JSON
head, then the zstd-compressed bit planes and row bounds. Directories are counted
anew while a file is opened.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MAGIC = b"WMX1"
CODEC = pa.Codec("zstd", compression_level=1)
BITS = 64


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, packed: np.ndarray, n: int):
        words = np.zeros(-(-n // BITS) + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.n, self.packed, self.words = n, packed, words
        self.before = np.zeros(len(words) + 1, np.int64)  # ones in all words before
        np.cumsum(np.bitwise_count(words), out=self.before[1:], dtype=np.int64)

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        return cls(np.packbits(bits, bitorder="little"), len(bits))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        part = self.words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at >> 6] + np.bitwise_count(part)

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """The place of the k-th one (or zero), from 0."""
        before = self.before if bit else np.arange(len(self.before)) * BITS - self.before
        word = np.searchsorted(before, k, "right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        seen = np.cumsum(bits, axis=1, dtype=np.int64)
        return word * BITS + (seen <= (k - before[word])[:, None]).sum(1)


@dataclass
class WaveletMatrix:
    """Ids of consecutive rows; ``splits`` bounds the rows."""

    n: int
    planes: list[Plane]
    zeros: list[int]
    splits: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, splits: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        now = ids.astype(np.uint16 if top < 1 << 16 else np.uint32)
        planes, zeros = [], []
        for level in range(max(top.bit_length(), 1))[::-1]:
            ones = (now >> now.dtype.type(level)) & now.dtype.type(1) == 1
            planes.append(Plane.of(ones))
            low = now[np.flatnonzero(~ones)]  # by places: masks of mixed bits take five times as long
            zeros.append(len(low))
            now = np.concatenate([low, now[np.flatnonzero(ones)]])
        return cls(len(ids), planes, zeros, np.asarray(splits, np.int64))

    def to_bytes(self) -> bytes:
        parts = [p.packed.tobytes() for p in self.planes]
        parts.append(np.diff(self.splits).astype("<u4").tobytes())
        packed = [CODEC.compress(p, asbytes=True) for p in parts]
        head = {"n": self.n, "rows": len(self.splits) - 1, "zeros": self.zeros, "raw": [len(p) for p in parts], "sizes": [len(p) for p in packed]}
        raw = json.dumps(head).encode()
        return b"".join([MAGIC, struct.pack("<I", len(raw)), raw, *packed])

    @classmethod
    def from_bytes(cls, file: bytes | memoryview) -> WaveletMatrix:
        if bytes(file[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack("<I", file[4:8])
        head, at, parts = json.loads(bytes(file[8 : 8 + size])), 8 + size, []
        for raw, packed in zip(head["raw"], head["sizes"]):
            plain = CODEC.decompress(file[at : at + packed], raw) if raw else b""
            parts.append(np.frombuffer(plain, np.uint8))
            at += packed
        counts = parts[-1].view("<u4").astype(np.int64)
        splits = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return cls(head["n"], [Plane(p, head["n"]) for p in parts[:-1]], head["zeros"], splits)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the given places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for plane, zeros in zip(self.planes, self.zeros):
            one, ones = plane.get(at), plane.rank(at)
            out = (out << np.uint32(1)) | one
            at = np.where(one, zeros + ones, at - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """The places of a token on the last level, of its occurrences from ``low`` to ``high``."""
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([low, high])
        for i, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            ones = plane.rank(ends)
            ends = zeros + ones if token >> (len(self.planes) - 1 - i) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often the token stands in the places ``low`` to ``high - 1``."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrences(self, token: int) -> np.ndarray:
        """All places of the token, rising."""
        low, high = self._range(token, 0, self.n)
        at = np.arange(low, high)
        for i in range(len(self.planes))[::-1]:
            one = bool(token >> (len(self.planes) - 1 - i) & 1)
            at = self.planes[i].select(at - (self.zeros[i] if one else 0), one)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the moves of each level from the last one on."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for i, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            ones = plane.bits()
            back = np.empty_like(now)
            back[np.flatnonzero(~ones)] = now[:zeros]
            back[np.flatnonzero(ones)] = now[zeros:] | now.dtype.type(1 << i)
            now = back
        return now
