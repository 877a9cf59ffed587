"""Substring and suffix-array dedup, the n-gram join and decontamination against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import decontaminate
from gridcast.llm.ngram_join import near_duplicates
from gridcast.llm.substring_dedup import difference_cover, remove_repeats
from gridcast.llm.suffix_dedup import remove_passages, sliding_argmin
from tests.llm import data


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(data.awkward(), data.SCHEMA)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("period", [1, 2, 3, 4, 7, 13, 21, 31])
def test_difference_cover(period):
    cover = difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_sliding_argmin():
    x = np.random.default_rng(0).integers(0, 5, 200)
    for width in (1, 2, 3, 8, 16, 21):
        want = [i + int(np.argmin(x[i : i + width])) for i in range(200 - width + 1)]
        assert sliding_argmin(x, width).tolist() == want


def expected_cut(rows, window):
    out = []
    for (ident, text, *_), (words, gone) in zip(rows, data.covered([r[1] for r in rows], window)):
        out.append((ident, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=key)


@pytest.mark.parametrize(
    "window, operator",
    [
        (35, lambda d: remove_repeats(d, window=35)),
        (12, lambda d: remove_repeats(d, window=12, period=7)),
        (50, lambda d: remove_passages(d, least_words=50)),
        (20, lambda d: remove_passages(d, least_words=20, spread=8)),
    ],
)
def test_cut(awkward, window, operator):
    got = operator(awkward).cache()
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(rows, key=key) == expected_cut(data.awkward(), window)
    for r in got.select("n_removed", "runs").collect():
        assert r["n_removed"] == sum(x["end"] - x["start"] for x in r["runs"])


@pytest.mark.parametrize(
    "window, operator, ids, far, n",
    [(35, remove_repeats, (810, 54639), 45, 70), (50, remove_passages, (99041, 147643), 60, 90)],
)
def test_contexts_alike(spark, window, operator, ids, far, n):
    """Two contexts of one anchor that agree in the last 32 bits of the hash of seed 0 but not in their words."""
    texts = []
    for i in ids:
        words = [f"w{k}" for k in range(n)]
        words[10], words[far] = f"x{i}", f"y{i}"
        texts.append(" ".join(words))
    rows = data.rows(texts)
    got = operator(spark.createDataFrame(rows, data.SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    want = expected_cut(rows, window)
    assert [r[2] for r in want] == [0, 0]
    assert sorted((tuple(r) for r in got), key=key) == want


def test_cut_empty(spark):
    none = spark.createDataFrame([], data.SCHEMA)
    assert remove_repeats(none).count() == 0
    assert remove_passages(none).count() == 0


def expected_components(rows, percent):
    sets = [data.shingles(r[1], 4) for r in rows]
    roots = data.joined(len(rows), data.jaccard_links(sets, percent))
    groups = {}
    for r, root in zip(rows, roots):
        groups.setdefault(root, []).append(r[0])
    least = {root: min((x for x in ids if x is not None), default=None) for root, ids in groups.items()}
    return sorted(((r[0], len(s), least[root]) for r, s, root in zip(rows, sets, roots)), key=key), len(groups)


def test_ngram_join(awkward):
    want, n_groups = expected_components(data.awkward(), 85)
    got = near_duplicates(awkward).cache()
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == want
    firsts = got.where("is_first AND n_shingles > 0").select("__a", "__b").distinct().count()
    assert firsts + got.where("n_shingles = 0").count() == n_groups


def test_ngram_join_crowd(spark, monkeypatch):
    """A large group of near copies, most of them apart, takes the blocks; blocks of any size agree."""
    rng = np.random.default_rng(5)
    base = data.prose(90, 8).split(" ")
    texts = []
    for i in range(90):
        words = list(base)
        for k in rng.choice(90, int(rng.integers(0, 6)), replace=False):
            words[k] = f"w{i}x{k}"
        texts.append(" ".join(words))
    rows = data.rows(texts)
    want, _ = expected_components(rows, 85)
    from gridcast.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CROWD", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = near_duplicates(spark.createDataFrame(rows, data.SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=key) == want


def test_ngram_join_empty(spark):
    assert near_duplicates(spark.createDataFrame([], data.SCHEMA)).count() == 0


def items():
    docs = [r[1] for r in data.awkward()]
    words = data.PLAIN_WORD.findall(docs[0])
    return [
        (1, " ".join(words[5:30]).upper(), "x"), (2, "one, TWO; three!", "x"), (3, None, "x"), (4, "...", "x"), (None, " ".join(words[40:52]), "x"),
        (10, " ".join(words[100:109]), "x"), (2, " ".join(words[60:75]), "x"), (7, "never seen words", "x"), (8, "a a a a a a a a a a a", "x"),
    ]


def expected_hits(rows, bench, size):
    windows = []
    for ident, text, _ in bench:
        w = data.PLAIN_WORD.findall((text or "").translate(data.LOWER))
        if w:
            n = min(size, len(w))
            windows += [(ident, w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for r in rows:
        w = data.PLAIN_WORD.findall((r[1] or "").translate(data.LOWER))
        hit, found = set(), set()
        for ident, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i] == x[0] and w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(ident)
        out.append((r[0], len(w), sorted(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=key)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_decontamination(spark, awkward, most):
    bench = spark.createDataFrame(items(), "item_id long, text string, n_words string")
    got = decontaminate.find_contamination(awkward, bench, max_windows=most)
    assert got.columns[: len(awkward.columns)] == awkward.columns
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "hit_words", "items").collect()]
    assert sorted(rows, key=key) == expected_hits(data.awkward(), items(), 10)
    assert got.where(F.col("contaminated") != (F.size("hit_words") > 0)).count() == 0


def test_decontamination_empty(spark, awkward):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(awkward, bench).where("contaminated").count() == 0
    none = spark.createDataFrame([], data.SCHEMA)
    full = spark.createDataFrame(items(), "item_id long, text string, x string")
    assert decontaminate.find_contamination(none, full).count() == 0
