"""Licence notices and identifiers in texts.

One Aho-Corasick automaton finds the notice phrases, as whole words, and the
identifier tag. A tag is followed by an expression of licence identifiers with
AND, OR and WITH; a shunting-yard parser turns it into postfix order and
evaluates it to the labels it names and to whether a set of accepted families
satisfies it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.frames import arrow_pass

#: Phrases of the contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "all rights reserved": "proprietary",
}
#: Identifier prefixes and the family each belongs to; the longest prefix decides.
FAMILIES = {
    "agpl": "agpl",
    "apache": "apache",
    "bsd": "bsd",
    "bsl": "bsl",
    "cc-by": "cc-by",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc0": "cc0",
    "epl": "epl",
    "gfdl": "gfdl",
    "gpl": "gpl",
    "isc": "isc",
    "lgpl": "lgpl",
    "mit": "mit",
    "mpl": "mpl",
    "unlicense": "unlicense",
}
ACCEPTED = frozenset({"apache", "bsd", "bsl", "cc-by", "cc0", "isc", "mit", "unlicense"})
TAG = "spdx license identifier"
RANK = {"or": 1, "and": 2, "with": 3}
SYMBOL = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
SPACE = re.compile(r"[ \t]*")


@dataclass(frozen=True)
class Verdict:
    labels: frozenset[str]
    accepted: bool


def family(identifier: str) -> str | None:
    """The family of an identifier, by its longest known prefix of whole parts."""
    name = identifier.lower().rstrip("+")
    while name:
        if name in FAMILIES:
            return FAMILIES[name]
        name = name.rpartition("-")[0]
    return None


def symbols(text: str, start: int) -> list[str]:
    """The longest run from ``start`` on that can be read as one expression on one line."""
    out, depth, operand = [], 0, True
    at = SPACE.match(text, start).end()
    while found := SYMBOL.match(text, at):
        word = found[0]
        word = word.lower() if word.lower() in RANK else word
        if word == "(" or word not in RANK and word != ")":
            if not operand:
                break
            depth += word == "("
            operand = word == "("
        elif operand or word == ")" and not depth:
            break
        else:
            depth -= word == ")"
            operand = word != ")"
        out.append(word)
        at = SPACE.match(text, found.end()).end()
    while out and (out[-1] in RANK or out[-1] == "("):
        out.pop()
    opened = out.count("(") - out.count(")")
    return out + [")"] * opened if out else out


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: WITH binds closer than AND, AND closer than OR."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        elif token in RANK:
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(tokens: list[str], accepted: frozenset[str] = ACCEPTED) -> Verdict | None:
    """Labels of an expression and whether the accepted families satisfy it."""
    stack: list[Verdict] = []
    for token in postfix(tokens):
        if token not in RANK:
            label = family(token)
            stack.append(Verdict(frozenset([label] if label else []), label in accepted))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception adds no licence and never forbids
            stack.append(left)
        else:
            fine = left.accepted and right.accepted if token == "and" else left.accepted or right.accepted
            stack.append(Verdict(left.labels | right.labels, fine))
    return stack[0] if stack else None


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.add_word(f" {TAG} ", (TAG, None))
    a.make_automaton()
    return a


def _folded(ws: W.Words, splits_end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-cased words with a space before and behind each; row offsets."""
    inside = np.zeros(len(ws.data) + 1, np.int8)
    inside[ws.start] += 1
    inside[ws.end] -= 1
    word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    lower = ws.data.copy()
    upper = (lower >= 65) & (lower <= 90)
    lower[upper] += 32
    lengths = ws.end - ws.start
    # every word gives its bytes and one space, every row a space in front
    rows = ws.rows()
    out = np.full(int(lengths.sum()) + len(lengths) + len(splits_end), 32, np.uint8)
    before = np.cumsum(lengths + 1) - (lengths + 1) + rows + 1
    place = np.repeat(before - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    out[place] = lower[word]
    sizes = np.bincount(rows, lengths + 1, len(splits_end)).astype(np.int64) + 1
    return out.tobytes(), np.concatenate([[0], np.cumsum(sizes)])


def scan(texts: pa.Array) -> list[tuple]:
    """(n_words, n_base, first, last, base labels, labels, accepted, score) of each row."""
    out = []
    machine = automaton()
    for first_row, part in W.slices(texts):
        ws = W.split(part, W.PLAIN)
        joined, offsets = _folded(ws, ws.splits[1:])
        whole = joined.decode("latin-1")
        counts = ws.counts
        for r in range(len(part)):
            out.append(_scan_row(machine, whole[offsets[r] : offsets[r + 1]], int(counts[r]), part, ws, r))
    return out


def _scan_row(machine, row: str, n_words: int, part: pa.Array, ws: W.Words, r: int) -> tuple:
    starts, base, more, tags = [], set(), {}, []
    seen = spaces = 0
    for end, (phrase, label) in machine.iter(row):
        begin = end - len(phrase) - 1
        # matches come by their ends, so a longer one may begin before the last
        spaces += row.count(" ", seen, begin) if begin >= seen else -row.count(" ", begin, seen)
        seen = begin
        if label is None:
            tags.append(spaces + TAG.count(" ") + 1)
        elif phrase in BASE_PHRASES:
            starts.append(spaces)
            base.add(label)
            more[label] = True
        else:
            more[label] = True
    accepted: bool | None = None
    if tags:
        text = part[r].as_py().encode()
        for word in tags:
            verdict = _tag_verdict(text, ws, r, word)
            if verdict is not None:
                more.update(dict.fromkeys(verdict.labels, True))
                accepted = verdict.accepted if accepted is None else accepted and verdict.accepted
    if more and accepted is None:
        accepted = all(x in ACCEPTED for x in more)
    # a tag is sure evidence, base phrases strong, other notices weaker; each adds to the rest
    doubt = 1.0
    doubt *= 0.02 if tags else 1.0
    doubt *= 0.2 ** len(base)
    doubt *= 0.4 ** len(set(more) - base)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(more)), accepted, round(1.0 - doubt, 6)


def _tag_verdict(text: bytes, ws: W.Words, r: int, word: int) -> Verdict | None:
    """The expression behind a tag, whose last word is number ``word`` - 1 of the row."""
    at = int(ws.end[ws.splits[r] + word - 1] - ws.offsets[r])
    rest = text[at : text.find(b"\n", at) if b"\n" in text[at:] else len(text)].decode("utf-8", "replace")
    colon = re.match(r"[ \t]*:", rest)
    return evaluate(symbols(rest, colon.end())) if colon else None


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, accepted boolean, score double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]


def _step(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = scan(batch.column("text"))
    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays([batch.column("id"), *cols], names=["id", *_NAMES])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence evidence of each text.

    Words are runs of 0-9, a-z (A-Z lower-cased) and of characters above 0x7F.
    Returns (id, n_words, n_base, first_word, last_word, base_labels, labels,
    accepted, score), one row per input row: places of the base phrases, their
    smallest and largest first word, labels of the base phrases and of all
    evidence, whether the accepted families satisfy all tags (or, without tags, all
    notices; null without evidence), and the strength of the evidence from 0 to 1.
    A null or empty text has no words, no labels and the score 0; a tag without a
    readable expression adds no label; repeated rows give repeated results. Other
    columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_pass(rows, _step, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
