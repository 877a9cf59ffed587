"""Each stage of the pipeline on its own input, and the whole of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridcast.llm import pii
from tests.llm import data

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_near_duplicate(spark, given_docs):
    rows = given_docs.orderBy("doc_id").collect()
    sets = [data.shingles(r["text"], 5) for r in rows]
    roots = data.joined(len(rows), data.jaccard_links(sets, 80))
    got = cp.near_duplicate(spark, given_docs, SF)
    assert tuple(got.columns) == cp.COLUMNS
    assert ids(got) == [rows[i]["doc_id"] for i in range(len(rows)) if roots[i] == i]


def test_near_duplicate_awkward(spark):
    got = cp.near_duplicate(spark, spark.createDataFrame(data.awkward(), data.SCHEMA), SF).collect()
    rows = data.awkward()
    sets = [data.shingles(r[1], 5) for r in rows]
    groups = len(set(data.joined(len(rows), data.jaccard_links(sets, 80))))
    assert len(got) == groups
    assert sum(not (r["text"] or "").strip() for r in got) == sum(not s for s in sets)


def test_near_duplicate_between(spark):
    """Copies with a fifth of the text appended: 0.8 of their runs of five words are shared, not 0.85 of those of four."""
    texts = [data.prose(200, 1), data.prose(200, 1) + " " + data.prose(45, 2), data.prose(200, 3), data.prose(200, 3) + " " + data.prose(60, 4)]
    texts += [data.prose(200, 5), data.prose(200, 5) + " " + data.prose(20, 6)]
    sets = [data.shingles(t, 5) for t in texts]
    roots = data.joined(len(texts), data.jaccard_links(sets, 80))
    assert roots == [0, 0, 2, 3, 4, 4]
    got = cp.near_duplicate(spark, spark.createDataFrame(data.rows(texts), data.SCHEMA), SF)
    assert ids(got) == [i + 1 for i in range(len(texts)) if roots[i] == i]


def test_decontamination(spark, given_docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = set()
    for r in bench:
        w = data.PLAIN_WORD.findall(r["text"].translate(data.LOWER))
        windows.update(" ".join(w[i : i + 10]) for i in range(max(len(w) - 9, 1)))
    clean = []
    for r in given_docs.collect():
        w = data.PLAIN_WORD.findall(r["text"].translate(data.LOWER))
        if not any(" ".join(w[i : i + 10]) in windows for i in range(len(w))):
            clean.append(r["doc_id"])
    assert ids(cp.decontamination(spark, given_docs, SF)) == sorted(clean)


def test_pii(spark, given_docs):
    texts = {r["doc_id"]: r for r in given_docs.collect()}
    for r in cp.pii(spark, given_docs, SF).collect():
        old = texts[r["doc_id"]]["text"]
        assert r["text"] == pii.mask(old, pii.find_spans(old)) and r["n_chars"] == len(r["text"])


def awkward(spark):
    """Nulls, blanks, repeated rows, clashing columns; and one row with personal data, twice."""
    return spark.createDataFrame(data.awkward() + data.rows(["mail a.b@c.de now"] * 2, 900), data.SCHEMA)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_quality_awkward(spark):
    """The labels are for other ids, so nothing is known and all rows stay; empty tables stay empty."""
    docs = awkward(spark).withColumn("doc_id", -F.col("doc_id"))
    got = cp.quality(spark, docs, SF)
    assert tuple(got.columns) == cp.COLUMNS and rows_of(got) == rows_of(docs.select(*cp.COLUMNS))
    assert cp.quality(spark, docs.limit(0), SF).count() == 0


def test_decontamination_awkward(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    hit = spark.createDataFrame(data.rows([f"x {item.upper()}", item, item], 700), data.SCHEMA)
    got = cp.decontamination(spark, awkward(spark).unionByName(hit), SF)
    assert tuple(got.columns) == cp.COLUMNS and rows_of(got) == rows_of(awkward(spark).select(*cp.COLUMNS))
    assert cp.decontamination(spark, hit.limit(0), SF).count() == 0


def test_pii_awkward(spark):
    docs = awkward(spark)
    got = cp.pii(spark, docs, SF)
    plain = {r["doc_id"]: r["text"] for r in got.where("doc_id >= 900").collect()}
    assert plain == {900: "mail [email] now", 901: "mail [email] now"}
    same = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.where("doc_id < 900 OR doc_id IS NULL").collect()]
    kept = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in got.where("doc_id < 900 OR doc_id IS NULL").collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, same)) and tuple(got.columns) == cp.COLUMNS
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.collect())
    assert cp.pii(spark, docs.limit(0), SF).count() == 0


def test_packing_awkward(spark):
    docs = awkward(spark)
    got = cp.packing(spark, docs, SF).collect()
    assert len({r["doc_id"] for r in got}) == docs.select("doc_id").distinct().count()
    assert sum(r["start"] == 0 for r in got) == docs.count()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in filled.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(held[-1]) <= 2048
    assert cp.packing(spark, docs.limit(0), SF).count() == 0


def test_quality(spark, given_docs):
    got = cp.quality(spark, given_docs, SF)
    kept = set(ids(got))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [(r["doc_id"] in kept) == (r["quality"] == 1 and r["toxic"] == 0) for r in labels]
    assert np.mean(right) > 0.85  # 80 labels only


def test_whole(spark):
    got = cp.run(spark, SF)
    assert got.count() > 0 and [n for n, _ in cp.STAGES] == ["quality", "near_duplicate", "decontamination", "pii", "packing"]
    assert got.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").where("n > 2048").count() == 0
