"""Personal data in texts: spans, their scores, and masked texts.

Regular expressions propose spans; checks of the digits (Luhn, modulo 97, ranges
and lengths) confirm them; words near a span move its score. The four base kinds
are kept whenever their check holds; the other kinds need a score of at least
``least_score``, which a checksum or a context word gives them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm.frames import arrow_pass

BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match ends where a run of digits ends, so none can begin inside one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country; without an entry, any length may hold.
_COUNTRIES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
IBAN_LENGTH = {c: n for n, some in _COUNTRIES.items() for c in some.split()}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)(?<![a-z0-9_])(?:password|passwd|secret|token|api_?key)[\x20]?[=:][\x20]?[\"']?[^\s\"']{6,}+")
NOT_DIGIT = re.compile("[^0-9]+")

#: Words that raise the score of a kind when they stand near a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "access_key": ("aws", "key", "access"),
    "secret": ("login", "key", "secret"),
}
#: Words that lower it: examples and numbers of other things.
AGAINST = ("example", "sample", "dummy", "version", "isbn")
REACH = 60
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each starts where the characters of a local part end leftwards.

    The pattern itself would try every start before an @ anew, which is quadratic
    in the length of a run; this looks back from each @ once.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        begin = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Longest matches that hold, each ending at a group; what follows an IBAN may look like more groups."""
    found = IBAN.search(text)
    while found:
        begin, span = found.start(), found[0]
        ends = [len(span), *(i for i in range(len(span) - 1, 0, -1) if span[i] == " ")]
        end = next((begin + n for n in ends if _is_iban(span[:n])), None)
        if end:
            yield begin, end
        found = IBAN.search(text, end or begin + 1)


def _is_iban(span: str) -> bool:
    n = len(span) - span.count(" ")
    return n == IBAN_LENGTH.get(span[:2], max(n, 15)) and mod97(span)


def _byte(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _is_card(span: str) -> bool:
    digits = NOT_DIGIT.sub("", span)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(span: str) -> bool:
    return 8 <= len(NOT_DIGIT.sub("", span)) <= 15


def _is_ssn(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    check: Callable[[str], bool]
    score: float


def _by(pattern: re.Pattern, *needed: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Spans of a pattern; ``needed``: lower-case strings of which each match has one."""

    def find(text: str) -> Iterator[tuple[int, int]]:
        if needed:
            lower = text.lower()
            if not any(x in lower for x in needed):
                return iter(())
        return (m.span() for m in pattern.finditer(text))

    return find


KINDS = (
    Kind("email", emails, lambda s: True, 0.9),
    Kind("ip", _by(IP), lambda s: all(map(_byte, s.split("."))), 0.6),
    Kind("card", _by(CARD), _is_card, 0.8),
    Kind("phone", _by(PHONE), _is_phone, 0.7),
    Kind("iban", ibans, lambda s: True, 0.9),
    Kind("ssn", _by(SSN), _is_ssn, 0.4),
    Kind("access_key", _by(ACCESS_KEY, "akia"), lambda s: True, 0.7),
    Kind("secret", _by(SECRET, "passw", "secret", "token", "api"), lambda s: any(c.isdigit() for c in s), 0.6),
)


def context_score(kind: Kind, text: str, start: int, end: int) -> float:
    near = set(WORD.findall(text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH // 2].lower()))
    score = kind.score + 0.2 * any(w in near for w in CONTEXT[kind.name]) - 0.3 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(text: str, least_score: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind and then by start."""
    out = []
    for kind in KINDS:
        for start, end in kind.find(text):
            if kind.check(text[start:end]):
                score = context_score(kind, text, start, end)
                if kind.name in BASE_KINDS or score >= least_score:
                    out.append((kind.name, start, end, score))
    return out


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, one name for all."""
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPAN_TYPE = T.ArrayType(
    T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")
)


def detect(docs: DataFrame, text_col: str = "text", least_score: float = 0.5, masked: bool = True) -> DataFrame:
    """Add ``pii_spans`` (kind, start, end, score) and, if asked for, ``pii_masked``.

    Spans are in code points, end exclusive, ordered by kind (email, ip, card,
    phone, iban, ssn, access_key, secret) and start; spans of different kinds may
    overlap. A null text has no spans and a null masked text; an empty one no spans
    and stays empty. Texts are read whole, rows one by one, so repeated rows give
    repeated results; all other columns are kept (columns named like the new ones
    are replaced).
    """
    kept = [c for c in docs.columns if c not in ("pii_spans", "pii_masked")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, texts = [], []
        for value in batch.column("text"):
            text = value.as_py()
            found = find_spans(text, least_score) if text else []
            spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in found])
            if masked:
                texts.append(mask(text, found) if found else text)
        cols = [batch.column(f"c{i}") for i in range(len(kept))] + [pa.array(spans, SPANS)]
        names = [f"c{i}" for i in range(len(kept))] + ["pii_spans"]
        if masked:
            cols, names = [*cols, pa.array(texts, pa.string())], [*names, "pii_masked"]
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("pii_spans", SPAN_TYPE)
    new = ["pii_spans"] + ["pii_masked"] * masked
    if masked:
        schema = schema.add("pii_masked", T.StringType())
    return arrow_pass(rows, step, schema).toDF(*kept, *new)
