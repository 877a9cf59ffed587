"""An open-addressed table in NumPy arrays that interns byte runs of one buffer.

Keys are xxhash64 values; a run goes to the slot of an equal key only after its
bytes have been compared with those of the run that opened the slot, so two runs
never share a slot by chance. Probing is linear, and all runs that are still
without a slot take their next step together, so no Python loop runs over runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

# Fixed values of the public xxHash specification (XXH64).
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)
#: Runs from this length on are hashed by the library, one at a time.
STRIPE = 32
#: Longer runs are compared one at a time.
LONG = 256


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes, followed by zeros, so that eight bytes can be read at every place."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """The integer that begins at each byte of a padded buffer."""
    kind = np.dtype(kind)
    return np.ndarray((len(data) - kind.itemsize + 1,), kind, data, strides=(1,))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the runs of a padded buffer."""
    wide, half = _lanes(data, "<u8"), _lanes(data, "<u4")
    h = length.astype(np.uint64) + P5
    at = start.copy()
    for _ in range(STRIPE // 8 - 1):
        some = np.flatnonzero(at + 8 <= start + length)
        if not len(some):
            break
        lane = _turn(wide[at[some]] * P2, 31) * P1
        h[some] = _turn(h[some] ^ lane, 27) * P1 + P4
        at[some] += 8
    some = np.flatnonzero(at + 4 <= start + length)
    h[some] = _turn(h[some] ^ (half[at[some]].astype(np.uint64) * P1), 23) * P2 + P3
    at[some] += 4
    for _ in range(3):
        some = np.flatnonzero(at < start + length)
        h[some] = _turn(h[some] ^ (data[at[some]].astype(np.uint64) * P5), 11) * P1
        at[some] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    view = memoryview(data)
    for i in np.flatnonzero(length >= STRIPE).tolist():
        h[i] = xxhash.xxh64_intdigest(view[start[i] : start[i] + length[i]])
    return h


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the runs at ``a`` and ``b`` of a padded buffer hold equal bytes."""
    wide = _lanes(data, "<u8")
    equal = np.ones(len(a), bool)
    left = np.flatnonzero((length > 0) & (length <= LONG) & (a != b))
    done = 0
    while len(left):
        tail = np.minimum(length[left] - done, 8)
        differ = (wide[a[left] + done] ^ wide[b[left] + done]) << ((8 - tail) * 8).astype(np.uint64)
        equal[left[differ != 0]] = False
        done += 8
        left = left[(differ == 0) & (length[left] > done)]
    for i in np.flatnonzero((length > LONG) & (a != b)).tolist():
        equal[i] = np.array_equal(data[a[i] : a[i] + length[i]], data[b[i] : b[i] + length[i]])
    return equal


@dataclass
class Interned:
    """Slots of the distinct runs: where one of each stands, and how many there are.

    ``slot`` has the slot of every run, so a value held by slot is given to all
    occurrences by one gather.
    """

    start: np.ndarray
    length: np.ndarray
    count: np.ndarray
    slot: np.ndarray


def intern(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Interned:
    """Intern the runs of a padded buffer; slots are numbered from 0 in table order."""
    n = len(start)
    key = xxh64(data, start, length)
    size = 1 << max(2 * n, 8).bit_length()
    mask = np.uint64(size - 1)
    owner = np.full(size, -1, np.int64)
    place = (key & mask).astype(np.int64)
    left = np.arange(n)
    while len(left):
        at = place[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]
        held = owner[at]
        same = (key[held] == key[left]) & (length[held] == length[left])
        some = np.flatnonzero(same)
        same[some] = same_bytes(data, start[held[some]], start[left[some]], length[left[some]])
        left = left[~same]
        place[left] = (place[left] + 1) & (size - 1)
    used = np.flatnonzero(owner >= 0)
    number = np.zeros(size, np.int64)
    number[used] = np.arange(len(used))
    slot = number[place]
    first = owner[used]
    return Interned(start[first], length[first], np.bincount(slot, minlength=len(used)), slot)
