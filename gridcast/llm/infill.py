"""Fill-in-the-middle rearrangement of documents with a piece table.

A document is a list of descriptors (buffer, start, end) over two buffers that are
never written: the texts of an Arrow slice, and the sentinels. Cutting splits a
descriptor in two, an arrangement is a permutation of descriptors, and a digest
streams over them; no text is copied until the arranged text itself is asked for.
The way back reads an arranged text as a piece table of its own, cut at the
sentinels, and applies the inverse permutation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import words as W
from gridcast.llm.frames import arrow_pass

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
#: Arrangements: the sentinels and the parts of a text (prefix 0, middle 1, suffix 2) in the order of the output.
FORMS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}


@dataclass(frozen=True)
class Infill:
    """``percent`` of the documents are rearranged, ``spm_percent`` of those suffix first."""

    seed: int = 42
    percent: int = 50
    spm_percent: int = 80


@dataclass(frozen=True)
class Piece:
    """Bytes ``start`` to ``end`` of a buffer that is never written."""

    buffer: memoryview
    start: int
    end: int

    def cut(self, *places: int) -> list[Piece]:
        """The pieces between rising places of the buffer."""
        edges = [self.start, *places, self.end]
        return [Piece(self.buffer, a, b) for a, b in zip(edges, edges[1:])]

    def view(self) -> memoryview:
        return self.buffer[self.start : self.end]


_SENTINEL = {s: Piece(memoryview(SENTINELS), SENTINELS.index(s), SENTINELS.index(s) + len(s)) for s in (PREFIX, SUFFIX, MIDDLE)}


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of a form, each after its sentinel."""
    return [p for sentinel, part in FORMS[form] for p in (_SENTINEL[sentinel], parts[part])]


def restore(text: bytes, form: str) -> list[Piece]:
    """Descriptors over an arranged text that stand for the text it was made from.

    The original holds no sentinel and a sentinel begins with its only ``<``, so the
    first of each in the order of the form is the one that was put there.
    """
    whole = Piece(memoryview(text), 0, len(text))
    if form not in FORMS:
        return [whole]
    found, at = [], 0
    for sentinel, _ in FORMS[form]:
        at = text.index(sentinel, at)
        found += [at, at + len(sentinel)]
        at += len(sentinel)
    laid = whole.cut(*found)[2::2]
    back = np.argsort([part for _, part in FORMS[form]])
    return [laid[i] for i in back]


def text_of(pieces: Iterable[Piece]) -> bytes:
    return b"".join(p.view() for p in pieces)


def digest(pieces: Iterable[Piece]) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p.view())
    return h.hexdigest()


def units(ws: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(ends, splits): where the units of each row end, in bytes.

    A unit is a word with the white space before it, or the white space behind the last word.
    """
    last = np.full(len(ws.counts), -1, np.int64)
    some = ws.counts > 0
    last[some] = ws.end[ws.splits[1:][some] - 1]
    tail = np.flatnonzero((last < ws.offsets[1:]) & (np.diff(ws.offsets) > 0))
    ends = np.insert(ws.end, ws.splits[1:][tail], ws.offsets[1:][tail])
    counts = ws.counts.copy()
    counts[tail] += 1
    return ends, np.concatenate([[0], np.cumsum(counts)])


def _choices(ident: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers from the hash of the id."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


NEW = ("n_units", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _rearranged(how: Infill, with_text: bool):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
        rows: list[tuple] = []
        for first, texts in W.slices(batch.column("text")):
            ws = W.split(texts, W.EXACT)
            ends, splits = units(ws)
            buffer = memoryview(ws.data)
            chars = np.zeros(len(ws.data) + 1, np.int64)
            np.cumsum((ws.data & 0xC0) != 0x80, out=chars[1:])
            for r in range(len(texts)):
                k, n = first + r, int(splits[r + 1] - splits[r])
                whole = Piece(buffer, int(ws.offsets[r]), int(ws.offsets[r + 1]))
                raw = bytes(whole.view())
                plain = not raw or any(s in raw for s in _SENTINEL) or h[2][k] % 100 >= how.percent
                form = "plain" if plain else "spm" if h[3][k] % 100 < how.spm_percent else "psm"
                if plain:
                    out, sizes = [whole], (None, None)
                else:
                    places = sorted((int(h[0][k]) % (n + 1), int(h[1][k]) % (n + 1)))
                    at = [int(ends[splits[r] + p - 1]) if p else whole.start for p in places]
                    out = arrange(whole.cut(*at), form)
                    sizes = int(chars[at[0]] - chars[whole.start]), int(chars[at[1]] - chars[at[0]])
                text = text_of(out)
                rows.append((n, form, *sizes, digest(out), digest(restore(text, form)), text if with_text else b""))
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))]
        if with_text:
            arrays.append(pa.array([t.decode() for t in columns[-1]], pa.string()))
        return pa.RecordBatch.from_arrays(arrays, names=["id", *NEW, "output"][: len(arrays)])

    return lambda batch: step(batch) if batch.num_rows else None


def rearrange(
    docs: DataFrame, how: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = True
) -> DataFrame:
    """Cut documents at two places drawn by their id, and lay the parts out for infilling.

    Returns (id, n_units, form, prefix_chars, middle_chars, output_sha256,
    restored_sha256[, output]), one row per row of ``docs``. The restored text is read
    back from the output and its form. A null text counts as empty; an empty text, and
    one that holds a sentinel, stays plain (with null lengths); one of white space only
    is a single unit; a null id draws as an empty one; repeated rows give repeated
    results; other columns are ignored; an empty table gives none.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(ident.alias("id"), text.alias("text"), *_choices(ident, how.seed))
    schema = T.StructType([rows.schema["id"]]).add("n_units", "long").add("form", "string")
    schema = schema.add("prefix_chars", "long").add("middle_chars", "long").add("output_sha256", "string").add("restored_sha256", "string")
    if with_text:
        schema = schema.add("output", "string")
    return arrow_pass(rows, _rearranged(how, with_text), schema).withColumnRenamed("id", id_col)


def original(df: DataFrame, text_col: str = "output", form_col: str = "form", name: str = "text") -> DataFrame:
    """Add ``name``: the texts that the arranged texts were made from (null for null)."""
    kept = df.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{form_col}`").alias("f"), F.struct(*df.columns).alias("row"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column("t").to_pylist(), batch.column("f").to_pylist())
        back = [None if t is None else text_of(restore(t.encode(), f)).decode() for t, f in pairs]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(back, pa.string())], names=["row", "back"])

    schema = T.StructType([kept.schema["row"]]).add("back", "string")
    out = arrow_pass(kept.select("row", "t", "f"), step, schema)
    names = [c for c in df.columns if c != name]
    return out.select(*[F.col("row")[c].alias(c) for c in names], F.col("back").alias(name))
