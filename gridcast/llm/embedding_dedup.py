"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length one, so a cosine is a distance. Each of several
tables projects them on random Gaussian directions, shifts and quantises the
projections and buckets vectors with the same numbers; near vectors share a
bucket in some table with high probability. Vectors of a bucket are compared by
their exact cosine. Equal vectors are one class and are compared once; buckets are
cut into blocks of bounded size, and each pair of blocks is a unit of work of its
own, so a crowded bucket is spread over many tasks and no pair leaves its unit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import words as W
from gridcast.llm.frames import arrow_pass, components, run_pass
from gridcast.plans.storage import materialize

BLOCK = 256
CLASS = ("c0", "c1")


@dataclass(frozen=True)
class Hashing:
    """``tables`` of ``projections`` quantised to ``width``.

    At the defaults two unit vectors with a cosine of 0.93 share a projection's
    number with probability 0.85 and a bucket of some table with 0.998; at a cosine
    of 0.97, 0.99999. Unrelated ones share a bucket with about 0.05.
    """

    tables: int = 16
    projections: int = 7
    width: float = 2.0
    seed: int = 7


@lru_cache(maxsize=8)
def _directions(hashing: Hashing, size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([hashing.seed, size])
    n = hashing.tables * hashing.projections
    return rng.standard_normal((size, n)), rng.uniform(0, hashing.width, n)


def buckets(unit: np.ndarray, hashing: Hashing) -> np.ndarray:
    """One 64-bit bucket name per vector and table."""
    directions, shift = _directions(hashing, unit.shape[1])
    cells = np.floor((unit @ directions + shift) / hashing.width).astype(np.int64).view(np.uint64)
    cells = cells.reshape(len(unit), hashing.tables, hashing.projections)
    names = np.zeros(cells.shape[:2], np.uint64) + np.arange(hashing.tables, dtype=np.uint64)
    for k in range(hashing.projections):
        names = W.mix(names * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return names


def _usable(lists: pa.ListArray) -> np.ndarray:
    """Rows that are vectors of finite numbers and not zero."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null: NaN
    rows = np.repeat(np.arange(len(lists)), sizes)
    wrong = np.bincount(rows, ~np.isfinite(flat), len(lists)) > 0
    some = np.bincount(rows, np.isfinite(flat) & (flat != 0), len(lists)) > 0
    return some & ~wrong


def _by_size(lists: pa.ListArray, rows: np.ndarray):
    """(rows, matrix) for each vector size among the rows."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[rows]):
        these = rows[sizes[rows] == size]
        flat = lists.take(pa.array(these)).flatten().to_numpy(zero_copy_only=False).astype(float)
        yield these, flat.reshape(len(these), int(size)) + 0.0


def unit_vectors(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _names(label: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    bits = np.ascontiguousarray(x).view(np.uint64)
    out = []
    for seed in (1, 2):
        place = W.mix(np.arange(x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(seed)) | np.uint64(1)
        total = (W.mix(bits ^ place) * place).sum(1, dtype=np.uint64)
        out.append(W.mix(total ^ W.mix(label.view(np.uint64) + np.uint64(seed * 1000 + x.shape[1]))).view(np.int64))
    return out


def _listed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The class of each row; null if it links with nothing."""
    lists, label = batch.column("vec"), batch.column("lab")
    good = _usable(lists) & ~label.is_null().to_numpy(zero_copy_only=False)
    labels = label.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    names = np.zeros((2, len(good)), np.int64)
    for rows, x in _by_size(lists, np.flatnonzero(good)):
        names[:, rows] = _names(labels[rows], x)
    cols = [pa.array(n, mask=~good) for n in names]
    return pa.RecordBatch.from_arrays([batch.column("id"), lists, *cols, label], names=["id", "vec", *CLASS, "lab"])


def _bucketed(hashing: Hashing):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, labels = batch.column("vec"), batch.column("lab").to_numpy(zero_copy_only=False).astype(np.int64)
        names = np.zeros((batch.num_rows, hashing.tables), np.uint64)
        for rows, x in _by_size(lists, np.arange(batch.num_rows)):
            own = W.mix(labels[rows].view(np.uint64) * np.uint64(31) + np.uint64(x.shape[1]))
            names[rows] = W.mix(buckets(unit_vectors(x), hashing) ^ own[:, None])
        flat = pa.array(names.view(np.int64).reshape(-1))
        offsets = pa.array(np.arange(0, names.size + 1, hashing.tables, dtype=np.int32))
        cols = [batch.column(c) for c in (*CLASS, "vec", "n")]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, flat)], names=[*CLASS, "vec", "n", "names"])

    return step


def _compare(cosine: float):
    """Links of one unit: those whose first common bucket is the unit's."""

    def step(table: pa.Table, splits: np.ndarray) -> pa.RecordBatch | None:
        batch = table.to_batches()[0]
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in CLASS]
        side, at, weight, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "t", "n", "inside"))
        lists, names = batch.column("vec"), batch.column("names")
        tables = len(names[0])
        names = names.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, tables)
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(splits[:-1], splits[1:]):
            here = np.arange(a, b)
            size = len(lists[int(a)])
            x = unit_vectors(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b - a, size))
            if inside[a]:
                i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
                i, j = i + a, j + a
            else:
                lower = side[here] == side[here].min()
                left, right = here[lower], here[~lower]
                i, j = np.nonzero(x[left - a] @ x[right - a].T >= cosine)
                i, j = left[i], right[j]
            first = (names[i] == names[j]).argmax(1) == at[a]
            i, j = i[first], j[first]
            if len(i):
                found.append((i, j))
        if not found:
            return None
        i, j = (np.concatenate(x) for x in zip(*found))
        links = np.bincount(i, weight[j], batch.num_rows) + np.bincount(j, weight[i], batch.num_rows)
        parent = _parents(i, j, batch.num_rows)
        rows = np.flatnonzero(links)
        cols = [_class_struct(own, rows), _class_struct(own, parent[rows]), pa.array(links[rows].astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=["u", "v", "n"])

    return step


def _class_struct(own: list[np.ndarray], rows: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c[rows]) for c in own], names=list(CLASS))


def _parents(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row that each row is joined with, by rounds of halving paths."""
    parent = np.arange(n)
    while True:
        low = np.minimum(parent[i], parent[j])
        new = parent.copy()
        for ends in (i, j, parent[i], parent[j]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == parent).all():
            return parent
        parent = new


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.93,
    hashing: Hashing = Hashing(),
) -> DataFrame:
    """Link vectors of one label whose cosine (in double precision) is at least ``cosine``.

    Returns (id, n_links, component_id, kept), one row per input row: other rows
    linked directly, the smallest id of the component, and whether the row has that
    id. Rows with a null label or vector, a zero vector or one with a null or
    non-finite component link with nothing; so do vectors of different sizes. Equal
    vectors link, repeated rows too. Null ids take part but name no component that
    has another id. Labels are integers. Other columns are ignored.
    """
    rows = vectors.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{vec_col}`").alias("vec"),
        F.col(f"`{label_col}`").cast("long").alias("lab"),
    )
    schema = T.StructType([rows.schema["id"], rows.schema["vec"]]).add("c0", "long").add("c1", "long").add("lab", "long")
    listed = materialize(arrow_pass(rows, _listed, schema))
    classes = listed.where("c0 IS NOT NULL").groupBy(*CLASS).agg(
        F.first("vec").alias("vec"), F.first("lab").alias("lab"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least")
    )
    shape = T.StructType([schema["c0"], schema["c1"], schema["vec"]]).add("n", "long").add("names", T.ArrayType(T.LongType()))
    named = materialize(arrow_pass(classes.select(*CLASS, "vec", "lab", "n"), _bucketed(hashing), shape))
    places = named.select(*CLASS, F.posexplode("names").alias("t", "k"))
    crowds = places.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = places.join(crowds, "k").withColumn("blocks", F.expr(f"(m + {BLOCK - 1}) div {BLOCK}"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(*CLASS, "k"), F.col("blocks")))
    # with one block, the unit of the block and itself; else every pair of blocks
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = units.select(*CLASS, "t", "block", (F.col("block") == F.col("other")).alias("inside"), F.xxhash64("k", low, high).alias("k0"), F.xxhash64(high, low, "k").alias("k1"))
    found = materialize(
        run_pass(units.join(named, list(CLASS)), ["k0", "k1"], _compare(cosine), "u struct<c0: long, c1: long>, v struct<c0: long, c1: long>, n long")
    )
    links = found.groupBy(F.col("u.c0").alias("c0"), F.col("u.c1").alias("c1")).agg(F.sum("n").alias("links"))
    roots = components(found.select("u", "v"))
    sizes = listed.where("c0 IS NOT NULL").groupBy(*CLASS).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    known = sizes.withColumn("node", F.struct(*CLASS)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = known.join(least, "root").join(links, list(CLASS), "left").select(
        *CLASS, "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    out = listed.where("c0 IS NOT NULL").join(facts, list(CLASS)).select("id", "n_links", "component_id")
    alone = listed.where("c0 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_col)
