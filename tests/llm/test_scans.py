"""Personal data, licences and packing against plain re-implementations."""

import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridcast.llm import licenses, packing, pii
from tests.llm import data

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(number):
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(number[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("@.+-_ 1a()5%é\n", max_size=40), st.text("1234.  0-25", max_size=60)))
def test_base_spans(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_checks_and_context():
    text = "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32; ssn 123-45-6789, 123-45-6789 000-12-3456"
    found = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in found if k == "iban"] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert [k for k, *_ in found].count("ssn") == 2
    assert pii.find_spans("a 123-45-6789") == []  # no word near it, so the score is too low
    near, far = pii.find_spans("call +49 30 1234567")[0], pii.find_spans("+49 30 1234567")[0]
    assert near[3] > far[3]


def test_ends_of_spans():
    for value in ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "NO93 8601 1117 947"):
        for after in ("", " BIC COBADEFFXXX", " 4711 0815", " X"):
            text = f"to {value}{after}"
            assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text) if k == "iban"] == [("iban", value)]
    both = "AB12 CDEF 1234 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 END"
    assert [both[a:b] for k, a, b, _ in pii.find_spans(both) if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    for n in (200, 201, 5000):
        text = "token=" + "a1" * n + " end"
        assert pii.mask(text, pii.find_spans(text)) == "[secret] end"


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + "(" * 300_000, "a@" * 150_000):
        pii.find_spans(text)


def test_detect(spark):
    rows = data.rows(["mail a.b@c.de now +1 (234) 567-8901", None, "", "x" * 50_000 + " 4111 1111 1111 1111", "a@b.c", "a@b.c"])
    got = pii.detect(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["pii_masked"] == "mail [email] now [phone]"
    assert by[2]["pii_masked"] is None and by[2]["pii_spans"] == []
    assert by[3]["pii_masked"] == "" and by[4]["pii_masked"].endswith(" [card]")
    assert by[5]["pii_spans"] == by[6]["pii_spans"] and by[1]["__a"] == 0
    assert pii.detect(spark.createDataFrame([], data.SCHEMA)).count() == 0


def expected_licenses(text):
    w = data.PLAIN_WORD.findall((text or "").translate(data.LOWER))
    starts, base, more = [], set(), set()
    for phrases, held in ((licenses.BASE_PHRASES, base), (licenses.MORE_PHRASES, more)):
        for phrase, label in phrases.items():
            p = phrase.split(" ")
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            held.update([label] if found else [])
            starts += found if phrases is licenses.BASE_PHRASES else []
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def test_licenses(spark):
    rng = random.Random(1)
    words = "gnu general public license apache cc by nc mit bsd 2 clause the all rights reserved é".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))).replace("é ", "É, ") for _ in range(60)]
    texts += [None, "", "...", "GNU  General\nPublic-License", "cc by" * 3, "mit license " * 5000, "mit license", "mit license"]
    rows = data.rows(texts)
    got = licenses.scan_licenses(spark.createDataFrame(rows, data.SCHEMA)).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {r[0]: expected_licenses(r[1]) for r in rows}
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) for r in got)
    assert licenses.scan_licenses(spark.createDataFrame([], data.SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "text, labels, accepted",
    [
        ("SPDX-License-Identifier: MIT", "mit", True),
        ("// spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0 */", "apache,gpl", True),
        ("SPDX-License-Identifier: (MIT AND GPL-3.0-or-later)\nMIT", "gpl,mit", False),
        ("SPDX-License-Identifier: MIT OR GPL-2.0+ AND LGPL-2.1", "gpl,lgpl,mit", True),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0) AND LGPL-2.1", "gpl,lgpl,mit", False),
        ("SPDX-License-Identifier: ((BSD-3-Clause", "bsd", True),
        ("SPDX-License-Identifier: AND )", "", None),
        ("SPDX-License-Identifier", "", None),
    ],
)
def test_expressions(spark, text, labels, accepted):
    import pyarrow as pa

    row = licenses.scan(pa.array([text]))[0]
    assert (row[5], row[6]) == (labels, accepted)


def brute_value(tokens):
    """Recursive evaluation, to compare the shunting-yard parser with."""

    def either(i):
        left, i = both(i)
        while i < len(tokens) and tokens[i] == "or":
            right, i = both(i + 1)
            left = left or right
        return left, i

    def both(i):
        left, i = one(i)
        while i < len(tokens) and tokens[i] == "and":
            right, i = one(i + 1)
            left = left and right
        return left, i

    def one(i):
        if tokens[i] == "(":
            value, i = either(i + 1)
            return value, i + 1
        value, i = licenses.family(tokens[i]) in licenses.ACCEPTED, i + 1
        return (value, i + 2) if i < len(tokens) and tokens[i] == "with" else (value, i)

    return either(0)[0]


def test_shunting_yard():
    rng = random.Random(2)

    def make(depth):
        kind = rng.random()
        if depth and kind < 0.6:
            return make(depth - 1) + [rng.choice(["and", "or"])] + make(depth - 1)
        if depth and kind < 0.8:
            return ["(", *make(depth - 1), ")"]
        return [rng.choice(["MIT", "GPL-2.0", "Apache-2.0", "LGPL-3.0"])] + rng.choice([[], [], ["with", "X-exception"]])

    for _ in range(500):
        tokens = make(5)
        assert licenses.evaluate(licenses.symbols(" ".join(tokens), 0)).accepted == brute_value(tokens)


@pytest.mark.parametrize("cap,longest", [
    (packing.Capacity(), 2048), (packing.Capacity(documents=3), 2048), (packing.Capacity(64, 64, 64 * 64), 64),
    (packing.Capacity(2048, 2048, 300**2), 300), (packing.Capacity(2048, 7, 200**2, (1.0, 0.0, 1.0)), 200),
])
def test_best_fit(cap, longest):
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(3.5, 1, 5000).astype(int) + 1, longest)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan, used = packing.best_fit(histogram, cap)
    content = {}
    for length in histogram:
        ranges = sorted((low, high) for n, low, high, *_ in plan if n == length)
        assert [r[0] for r in ranges] == [0, *[r[1] for r in ranges[:-1]]] and ranges[-1][1] == histogram[length]
    for length, low, high, first, offset in plan:
        for k in range(high - low):
            content.setdefault(first + k, []).append((offset, length))
    assert sorted(content) == list(range(used))
    for held in content.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= cap.tokens and len(held) <= cap.documents
        assert sum(n * n for _, n in held) <= cap.attention
    if cap.documents >= cap.tokens and cap.attention >= cap.tokens**2:
        assert used <= 1.02 * -(-lengths.sum() // cap.tokens) + 1
    if longest == 300:  # here attention decides: no more sequences than it asks for, and more than the tokens would
        least = -(-int((lengths**2).sum()) // cap.attention)
        assert lengths.sum() / cap.tokens < least <= used <= 1.05 * least + 1


def test_pack(spark):
    rows = data.awkward()
    got = packing.pack(spark.createDataFrame(rows, data.SCHEMA), TOKENIZER, capacity=packing.Capacity(64, 64, 64 * 64), with_ids=True).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = []
    for r in rows:
        ids = [*plain.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k // 64, k, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["ids"])) for r in got)
    filled = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in filled.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 64
    assert packing.pack(spark.createDataFrame([], data.SCHEMA), TOKENIZER).count() == 0


def test_numbering_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    rows = data.rows([data.prose(5, i % 4) for i in range(40)])
    got = packing.pack(spark.createDataFrame(rows, data.SCHEMA), TOKENIZER, capacity=packing.Capacity(64, 64, 64 * 64)).collect()
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(got) == len(places) == 40


def test_a_piece_that_no_sequence_holds():
    for cap in (packing.Capacity(64, 64, 40**2), packing.Capacity(40), packing.Capacity(documents=0)):
        with pytest.raises(ValueError, match="longest piece"):
            packing.best_fit({41: 3}, cap)
    assert packing.best_fit({}, packing.Capacity(documents=0)) == ([], 0)
