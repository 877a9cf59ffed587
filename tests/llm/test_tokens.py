"""Resampling, infilling and token files against plain re-implementations."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridcast.llm import importance, infill, token_files, tokens
from gridcast.llm.intern import intern, padded, xxh64
from gridcast.llm.wavelet import WaveletMatrix
from gridcast.plans.storage import scratch_path
from tests.llm import data

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(TOKENIZER)


def digest_numbers(key):
    h = hashlib.sha256(key.encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def test_intern():
    rng = np.random.default_rng(1)
    raw = padded(rng.integers(97, 99, 5000).astype(np.uint8))
    length = np.concatenate([rng.integers(0, 40, 3000), rng.integers(250, 270, 20), [0, 31, 32, 33, 256, 257]])
    start = rng.integers(0, 5000 - 300, len(length))
    runs = [raw[a : a + n].tobytes() for a, n in zip(start, length)]
    assert xxh64(raw, start, length).tolist() == [xxhash.xxh64_intdigest(r) for r in runs]
    table = intern(raw, start, length)
    held = [raw[a : a + n].tobytes() for a, n in zip(table.start, table.length)]
    assert [held[s] for s in table.slot] == runs and len(set(held)) == len(held)
    assert Counter(runs) == dict(zip(held, table.count.tolist()))
    assert len(intern(padded(np.zeros(0, np.uint8)), np.zeros(0, np.int64), np.zeros(0, np.int64)).start) == 0


def test_equal_keys_are_told_apart(monkeypatch):
    raw = padded(np.frombuffer(b"abacadaeaf" * 3, np.uint8))
    start, length = np.arange(0, 28, 2), np.full(14, 2)
    monkeypatch.setattr("gridcast.llm.intern.xxh64", lambda d, s, n: np.full(len(s), 7, np.uint64))
    table = intern(raw, start, length)
    assert len(table.start) == 5 and sorted(table.count.tolist()) == [2, 3, 3, 3, 3]


def plain_resampling(docs, target, how):
    def grams(text):
        w = data.PLAIN_WORD.findall((text or "").translate(data.LOWER))
        return [" ".join(w[i : i + n]) for n in range(how.low, how.high + 1) for i in range(len(w) - n + 1)], len(w)

    def bucket(g):
        return zlib.crc32(g.encode()) % how.buckets

    source, goal = (Counter(bucket(g) for t in texts for g in grams(t)[0]) for texts in ([r[1] for r in docs], target))
    s, t = sum(source.values()) + how.buckets, sum(goal.values()) + how.buckets
    out = []
    for ident, text, *_ in docs:
        g, n = grams(text)
        gains = [math.floor(1000 * math.log((goal[b] + 1) * s / ((source[b] + 1) * t))) for b in map(bucket, g)]
        weight = sum(gains) // len(g) if g else 0
        h = digest_numbers(f"{how.seed}:{'' if ident is None else ident}")[0]
        out.append([ident, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= how.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: how.percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("how", [importance.Resampling(high=1), importance.Resampling(1, 3, 500, 3, 60, 7), importance.Resampling(2, 2, 11, 0, 100, 1)])
def test_resample(spark, how):
    rows = data.awkward()
    target = [("two\nlines CHANGED one", 1), (None, 2), ("日本 語 b", 3)]
    got = importance.resample(spark.createDataFrame(rows, data.SCHEMA).repartition(3), spark.createDataFrame(target, "text string, n int"), how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resampling(rows, [t for t, _ in target], how)


def test_resample_nothing(spark):
    none, some = spark.createDataFrame([], data.SCHEMA), spark.createDataFrame(data.awkward(), data.SCHEMA)
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none).count() == len(data.awkward())
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.weight, r["rank"]) for r in importance.resample(blank, some).collect()] == [(0, None)] * 2


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(ident, text, how):
    text, key = text or "", f"{how.seed}:{'' if ident is None else ident}"
    u, (a, b, c, d) = UNIT.findall(text), digest_numbers(key)
    lo, hi = sorted((a % (len(u) + 1), b % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:lo], u[lo:hi], u[hi:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= how.percent:
        return len(u), "plain", None, None, text
    if d % 100 < how.spm_percent:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("how", [infill.Infill(), infill.Infill(5, 100, 50), infill.Infill(6, 100, 0), infill.Infill(1, 0, 50)])
def test_rearrange(spark, how):
    extra = ["<", "a <P> b", "<<P", "x<S", "> y", "<M>", " lead and trail \n", "é 語 x  ", "P> <", "a\x0bb\x1cc"]
    rows = data.awkward() + data.rows(extra * 4, 500)
    got = infill.rearrange(spark.createDataFrame(rows, data.SCHEMA).repartition(3), how)
    want = []
    for ident, text, *_ in rows:
        n, form, prefix, middle, out = plain_infill(ident, text, how)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text or "")]
        want.append((ident, n, form, prefix, middle, *sha, out))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    back = infill.original(got, name="n_units").select("doc_id", "n_units").collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_rearrange_nothing(spark):
    assert infill.rearrange(spark.createDataFrame([], data.SCHEMA)).count() == 0


AWKWARD = ["a", "B", "é", "É", "ß", "×", "÷", "ÿ", "1", "²", "ª", "'", "'s", "'re", "|", "<|endoftext|>", "<|", " ", "\n", "\x85", "\x1c", "\x00", ".", "!!",
           "日本", "İ", "Σ", "ς", "é", "́", "ﬁ", "한", "😀", "_", "Я", "١", "Ⅷ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(AWKWARD), max_size=12).map("".join), st.text(max_size=12)), min_size=1, max_size=4))
def test_encoder(texts):
    ids, splits = next(tokens.encoder(TOKENIZER).encode(pa.array(texts)))
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(splits, splits[1:])] == want


def test_encoder_forgets_and_falls_back():
    enc = tokens.Encoder(TOKENIZER, 5)
    texts = [data.prose(300, 1), "", data.prose(300, 2), data.prose(300, 1)]
    want = [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(3):
        ids, splits = next(enc.encode(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(splits, splits[1:])] == want
    other = public_tokenizers.path("byte_bpe_50k.json")
    enc = tokens.Encoder(other)
    ids, splits = next(enc.encode(pa.array(["Two  words\n", None, "It's"])))
    assert not enc.by_pieces
    assert [ids[a:b].tolist() for a, b in zip(splits, splits[1:])] == [Tokenizer.from_file(other).encode(t).ids for t in ("Two  words\n", "", "It's")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=200), st.integers(1, 70_000))
def test_wavelet_matrix(ids, most):
    ids = np.array([i % most for i in ids], np.uint32)
    splits = np.unique(np.concatenate([[0], np.arange(0, len(ids), 7), [len(ids)]]))
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, splits).to_bytes())
    assert m.decode().tolist() == ids.tolist() and m.splits.tolist() == splits.tolist()
    assert m.access(np.arange(len(ids))).tolist() == ids.tolist()
    for t in {*ids[:5].tolist(), 0, 3, 1 << 18}:
        assert m.occurrences(t).tolist() == np.flatnonzero(ids == t).tolist()
        assert m.count(t) == (ids == t).sum() and m.count(t, 2, max(2, len(ids) - 3)) == (ids[2 : max(2, len(ids) - 3)] == t).sum()


@pytest.mark.parametrize("shard_tokens", [1, 100, 1 << 20])
def test_token_files(spark, shard_tokens):
    rows = data.awkward() + [(4, "b", None, None, 0, 0, None, 0, None, 0)] * 30
    path = scratch_path(spark, "tokens")
    docs = spark.createDataFrame(rows, data.SCHEMA).repartition(5)
    token_files.write_tokens(docs, path, TOKENIZER, shard_tokens=shard_tokens)
    got = token_files.read_documents(spark, path, with_ids=True).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], tuple(PLAIN.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    corpus = [t for r in got for t in r.ids]
    starts = np.cumsum([0, *(len(r.ids) for r in got)])[:-1].tolist()
    assert [r.start for r in got] == starts and [r.n_tokens for r in got] == [len(r.ids) for r in got]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got]
    few = [1, corpus[0], corpus[len(corpus) // 2], 49_000]
    assert {r.token: r.n for r in token_files.count_tokens(spark, path, sorted(set(few))).collect()} == {t: corpus.count(t) for t in set(few)}
    found = sorted((r.token, r.place, r.offset) for r in token_files.find_tokens(spark, path, [few[1], 49_000]).collect())
    assert [(t, p) for t, p, _ in found] == [(few[1], i) for i, t in enumerate(corpus) if t == few[1]]
    assert all(p - o in starts for _, p, o in found)
    places = [0, 5, len(corpus) - 1]
    assert sorted(map(tuple, token_files.tokens_at(spark, path, places).collect())) == [(p, corpus[p]) for p in places]


def test_token_files_of_nothing(spark):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], data.SCHEMA), path, TOKENIZER)
    assert token_files.read_documents(spark, path).count() == 0


def test_pieces_of_plain_letters_go_straight_to_the_merges():
    from public_tokenizers import path

    from gridcast.llm.tokens import Encoder

    e = Encoder(path("word_bpe_49k.json"))
    e.letters = None  # the table of other letters; using it fails now
    for word in ("a", "hello", "zzqxv" * 9):
        ids = e.tokenizer.encode(word, add_special_tokens=False).ids
        assert e._ask(word.encode()) == b"".join(i.to_bytes(4, "little") for i in ids)
