"""Document quality by co-training a content view and a metadata view.

Two logistic models see different sides of a document: the content model the
presence of telling words and the style of the text (shares of capitals, symbols,
repeated words and lines), the metadata model language, source and size. Over some
rounds each labels the documents of an unlabelled pool that it is sure of, after
calibration on held-out labels, and hands them to the other. The calibrated views
are then combined to one score for every document.

Both are fitted on the driver on a bounded sample of rows (``Training``); everything
else covers all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcast.llm import words as W
from gridcast.llm.frames import arrow_pass, hash_share, with_fields
from gridcast.plans.storage import materialize

LINE_BREAK = 10
#: Logits beyond this say no more: the tails would otherwise decide the calibration.
SURE = 8.0
#: Bytes of the word beginnings that count as terms, beside whole words.
BEGINNINGS = (4, 5)
MAX_SIZE_CLASS = 40


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit.

    About ``labelled`` labelled ids and ``pool`` others, chosen by the hash of the id,
    of at most ``sample_chars`` characters each; the
    ``vocabulary`` terms that tell the classes apart best, each in at least
    ``least_rows`` sampled documents and with a chi-square that about one of all
    candidate terms has by chance.
    """

    labelled: int = 16000
    pool: int = 4000
    sample_chars: int = 200_000
    vocabulary: int = 2048
    least_rows: int = 5
    categories: int = 64
    rounds: int = 3
    sure: float = 0.97
    threshold: float = 0.5


STYLE = ("capitals", "digits", "marks", "bars", "symbols", "same_word", "same_line", "word_length", "no_words")


def _share(ws: W.Words, inside: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(inside)])
    return (total[ws.offsets[1:]] - total[ws.offsets[:-1]]) / np.maximum(per, 1)


def style(texts: pa.Array) -> np.ndarray:
    """The style columns of each row of a slice."""
    ws = W.split(texts, W.EXACT)
    d, n = ws.data, ws.counts
    letters = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    n_letters = _share(ws, letters, np.ones(len(n)))
    h = ws.hashes()
    row = ws.rows()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    marks = np.bincount(row, (d[ws.end - 1] == 33), len(n)) if len(h) else np.zeros(len(n))
    bars = np.bincount(row, (d[ws.start] == 124) & (ws.end - ws.start == 1), len(n)) if len(h) else np.zeros(len(n))
    symbols = np.bincount(row, np.isin(d[ws.end - 1], (35, 36, 37, 38, 42)), len(n)) if len(h) else np.zeros(len(n))
    some = np.maximum(n, 1)
    return np.stack(
        [
            _share(ws, (d >= 65) & (d <= 90), n_letters),
            _share(ws, (d >= 48) & (d <= 57), np.diff(ws.offsets)),
            marks / some,
            bars / some,
            symbols / some,
            np.bincount(row, same, len(n)) / some,
            _same_lines(ws),
            np.minimum(np.diff(ws.offsets) / some, 50) / 10,
            (n == 0).astype(float),
        ],
        1,
    )


def _same_lines(ws: W.Words) -> np.ndarray:
    """Share of lines that equal another line of the row."""
    breaks = np.flatnonzero(ws.data == LINE_BREAK)
    ends = np.unique(np.concatenate([breaks, ws.offsets[1:]]))
    starts = np.unique(np.concatenate([breaks + 1, ws.offsets[:-1]]))
    starts = starts[starts < len(ws.data)]
    ends = ends[ends > 0]
    if not len(starts):
        return np.zeros(len(ws.counts))
    ends = ends[np.searchsorted(ends, starts)]
    up, down = W.BYTE_POWER[0].to(len(ws.data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.EXACT.values(0)[ws.data] * up[:-1])])
    line = W.mix((total[ends] - total[starts]) * down[starts])
    row = np.searchsorted(ws.offsets, starts, "right") - 1
    line, row = line[ends > starts], row[ends > starts]
    by = np.lexsort((line, row))
    again = np.zeros(len(line), bool)
    again[1:] = (line[by][1:] == line[by][:-1]) & (row[by][1:] == row[by][:-1])
    lines = np.bincount(row, minlength=len(ws.counts))
    return np.bincount(row[by], again, len(ws.counts)) / np.maximum(lines, 1)


def terms(ws: W.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the words and of the beginnings of longer words."""
    up, down = W.BYTE_POWER[0].to(len(ws.data) + 1)
    total = np.zeros(len(ws.data) + 1, np.uint64)
    np.cumsum(ws.splitter.values(0)[ws.data] * up[:-1], out=total[1:])
    rows, out = ws.rows(), []
    for k in (0, *BEGINNINGS):
        long = slice(None) if not k else ws.end - ws.start > k
        start = ws.start[long]
        end = ws.end[long] if not k else start + k
        out.append((rows[long], W.mix((total[end] - total[start]) * down[start] + np.uint64(k))))
    return out


def present(texts: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each term of the vocabulary that a row of a slice holds."""
    ws = W.split(texts, W.PLAIN)
    if not len(vocabulary) or not len(ws.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = []
    for row, h in terms(ws):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        held = vocabulary[at] == h
        pairs.append(row[held] * len(vocabulary) + at[held])
    every = np.unique(np.concatenate(pairs))
    return every // len(vocabulary), every % len(vocabulary)


def _cells(batch_columns: list[pa.Array], categories: list[list[str]], sizes: np.ndarray) -> np.ndarray:
    """Column numbers of the metadata of each row: one per metadata column and one for the size."""
    out, base = [], 0
    for values, known in zip(batch_columns, categories):
        index = {v: i for i, v in enumerate(known)}
        out.append(base + np.array([index.get(str(v.as_py()), len(known)) for v in values], np.int64))
        base += len(known) + 1
    size = np.minimum(np.log2(sizes + 1.0).astype(np.int64) * 2, MAX_SIZE_CLASS)
    return np.stack([*out, base + size], 1)


@dataclass
class Logistic:
    """L2-regularised logistic regression on 0/1 columns and some real ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    a: float = 1.0  # calibration: a * (clipped) logit + b
    b: float = 0.0

    def logits(self, n: int, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = np.bincount(row, self.weights[col], n) if len(row) else np.zeros(n)
        raw = z + ((dense - self.mean) / self.scale) @ self.dense + self.bias
        return self.a * np.clip(raw, -SURE, SURE) + self.b


@dataclass
class View:
    """Rows of one view: 0/1 cells and dense columns."""

    n: int
    row: np.ndarray
    col: np.ndarray
    dense: np.ndarray
    width: int

    def take(self, rows: np.ndarray) -> View:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.row] >= 0
        return View(len(rows), place[self.row[kept]], self.col[kept], self.dense[rows], self.width)

    def logits(self, model: Logistic) -> np.ndarray:
        return model.logits(self.n, self.row, self.col, self.dense)


def _log_odds(view: View, y: np.ndarray) -> np.ndarray:
    """Smoothed naive-Bayes weight of each 0/1 column."""
    up, down = np.bincount(view.col, y[view.row], view.width), np.bincount(view.col, 1 - y[view.row], view.width)
    return np.log((up + 0.5) / (y.sum() + 1)) - np.log((down + 0.5) / (len(y) - y.sum() + 1))


def fit_logistic(view: View, y: np.ndarray, spread: float = 3.0, steps: int = 30) -> Logistic:
    """Newton steps (by conjugate gradients) from naive-Bayes weights; deterministic.

    A Gaussian prior of that ``spread`` around them (around 0 for dense columns)
    lets rare columns keep their say.
    """
    mean, scale = view.dense.mean(0), view.dense.std(0) + 1e-6
    dense = np.column_stack([(view.dense - mean) / scale, np.ones(view.n)])
    k, penalty = view.width, np.full(view.width + dense.shape[1], spread**-2)
    penalty[-1] = 1e-6  # the bias is free
    prior = np.concatenate([_log_odds(view, y), np.zeros(dense.shape[1])])

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(view.row, v[view.col], view.n) + dense @ v[k:]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(view.col, r[view.row], k), dense.T @ r])

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.5 * (penalty * (v - prior) ** 2).sum())

    theta = prior.copy()
    z = times(theta)
    for _ in range(steps):
        p = _sigmoid(z)
        gradient = back(p - y) + penalty * (theta - prior)
        weight = p * (1 - p) + 1e-9
        step = _conjugate(lambda v: back(weight * times(v)) + penalty * v, gradient)
        rate, now = 1.0, loss(theta, z)
        while rate > 1e-4 and loss(theta - rate * step, times(theta - rate * step)) > now:
            rate /= 2
        theta = theta - rate * step
        z = times(theta)
        if now - loss(theta, z) < 1e-5 * max(now, 1.0):
            break
    return Logistic(theta[:k], theta[k:-1], float(theta[-1]), mean, scale)


def _conjugate(product, right: np.ndarray, steps: int = 50) -> np.ndarray:
    """Solve a positive definite system given by its product with a vector."""
    x, r = np.zeros_like(right), right.copy()
    d, size = r.copy(), r @ r
    first = size
    for _ in range(steps):
        if size <= 1e-8 * first or size == 0:
            break
        hd = product(d)
        rate = size / (d @ hd)
        x, r = x + rate * d, r - rate * hd
        size, last = r @ r, size
        d = r + size / last * d
    return x


def calibrate(model: Logistic, z: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows, drawn to the prior by smoothed targets and a small penalty."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * z).sum() + 1e-2 * a, (p - target).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    a = max(a, 0.0)  # a view that points the wrong way says nothing
    if a == 0.0:
        b = float(np.log((up + 1) / (down + 1)))
    model.a, model.b = float(a), float(b)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def co_train(views: tuple[View, View], y: np.ndarray, settings: Training) -> tuple[Logistic, Logistic]:
    """Fit both views; ``y`` is 1, 0 or -1 for the rows of the pool."""
    labelled = np.flatnonzero(y >= 0)
    held = labelled[::4]  # for calibration
    train = np.setdiff1d(labelled, held)
    pool = np.flatnonzero(y < 0)
    known = [(train, y[train]), (train, y[train])]
    models: list[Logistic] = []
    for _ in range(settings.rounds):
        models = [fit_logistic(v.take(rows), labels) for v, (rows, labels) in zip(views, known)]
        for view, model in zip(views, models):
            calibrate(model, view.take(held).logits(model), y[held])
        if not len(pool):
            break
        gifts = []
        for view, model in zip(views, models):
            p = _sigmoid(view.take(pool).logits(model))
            sure = (p >= settings.sure) | (p <= 1 - settings.sure)
            gifts.append((pool[sure], (p[sure] >= 0.5).astype(float)))
        known = [
            (np.concatenate([train, other[0]]), np.concatenate([y[train], other[1]])) for other in reversed(gifts)
        ]
    return models[0], models[1]


@dataclass
class Scorer:
    """What every task needs to score documents; its size is bounded by ``Training``."""

    vocabulary: np.ndarray
    categories: list[list[str]]
    content: Logistic
    metadata: Logistic
    prior: float

    def scores(self, texts: pa.Array, meta: list[pa.Array]) -> np.ndarray:
        """(content, metadata, combined) score of each row."""
        parts = []
        sizes = np.zeros(len(texts))
        for first, part in W.slices(texts):
            row, col = present(part, self.vocabulary)
            parts.append(self.content.logits(len(part), row, col, style(part)))
            sizes[first : first + len(part)] = np.diff(W.buffer(part)[1])
        content = np.concatenate(parts) if parts else np.zeros(0)
        cells = _cells(meta, self.categories, sizes)
        metadata = self.metadata.logits(len(sizes), np.repeat(np.arange(len(sizes)), cells.shape[1]), cells.reshape(-1), np.zeros((len(sizes), 1)))
        return np.stack([_sigmoid(content), _sigmoid(metadata), _sigmoid(content + metadata - self.prior)], 1)


def _sample(docs: DataFrame, labels: DataFrame, settings: Training, meta: list[str]) -> DataFrame:
    """Labelled rows and pool; of near copies with one label (equal min-hashes of shingles), one."""
    short = F.length("text") <= settings.sample_chars
    key = F.xxhash64("id")
    some = materialize(labels.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y")))
    known = some.count()
    chosen = some.where(hash_share(key, settings.labelled, known))
    others = docs.where(hash_share(key, settings.pool, docs.count() - known)).where(short & F.col("id").isNotNull())
    pool = others.select("id").distinct().join(some, "id", "left_anti")
    ids = materialize(chosen.unionByName(pool.withColumn("y", F.lit(-1))))
    rows = docs.where(short).join(F.broadcast(ids), "id")  # about labelled + pool ids

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs = np.zeros((3, batch.num_rows), np.uint64)
        for first, texts in W.slices(batch.column("text")):
            ws = W.split(texts, W.PLAIN)
            h = ws.hashes()
            ahead = np.minimum(np.arange(len(h)) + 5, np.repeat(ws.splits[1:], ws.counts))
            grams = ws.spans(h, np.arange(len(h)), ahead)
            some = np.flatnonzero(ws.counts)
            for k in range(3):
                if len(some):
                    signs[k, first + some] = np.minimum.reduceat(W.mix(grams + np.uint64(k + 1)), ws.splits[:-1][some])
        cols = [*(batch.column(c) for c in batch.schema.names), *(pa.array(s.view(np.int64)) for s in signs)]
        return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "m0", "m1", "m2"])

    schema = rows.schema
    for k in range(3):
        schema = T.StructType(list(schema.fields)).add(f"m{k}", "long")
    found = arrow_pass(rows, step, schema)
    for k in range(3):
        every = F.struct(*[F.col(c) for c in found.columns])
        found = found.groupBy("y", f"m{k}").agg(F.min_by(every, F.struct(F.xxhash64("id"), "id", F.xxhash64("text"))).alias("r")).select("r.*")
    return materialize(found.select("id", "y", "text", *meta))


def _vocabulary(sample: DataFrame, settings: Training) -> np.ndarray:
    """Hashes of the terms whose presence depends most on the label (chi-square)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, rows = [], []
        for first, texts in W.slices(batch.column("text")):
            ws = W.split(texts, W.PLAIN)
            row, h = (np.concatenate(x) for x in zip(*terms(ws)))
            by = np.lexsort((h, row))
            row, h = row[by], h[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            rows.append(row[new] + first)
            words.append(h[new])
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), batch.column("y").take(pa.array(row))], names=["word", "y"])

    labelled = sample.where("y >= 0").select("y", "text")
    up, down = (labelled.where(F.col("y") == k).count() for k in (1, 0))
    n = F.lit(float(up + down))
    seen = arrow_pass(labelled, step, "word long, y int").groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = n * (a * (down - b) - b * (up - a)) ** 2 / ((a + b) * (n - a - b + 1e-9) * float(up) * float(down) + 1e-9)
    candidates = materialize(seen.where(a + b >= settings.least_rows).select("word", chi.alias("chi")))
    many = max(2 * np.log(candidates.count() + 2), 2.0)
    telling = candidates.where(F.col("chi") >= float(many - np.log(many)))
    top = telling.orderBy(F.desc("chi"), "word").limit(settings.vocabulary).select("word").toArrow()
    return np.sort(top.column("word").to_numpy().view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, meta: list[str], settings: Training) -> Scorer | None:
    """Fit on ``docs`` (id, text, metadata) and ``labels`` (id, y); None without both classes."""
    sample = _sample(docs, labels, settings, meta)
    classes = {r["y"] for r in sample.select("y").distinct().collect()}
    if not {0, 1} <= classes:
        return None
    vocabulary = _vocabulary(sample, settings)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, styles, sizes = [], [], []
        for _, texts in W.slices(batch.column("text")):
            row, col = present(texts, vocabulary)
            cells += np.split(col, np.searchsorted(row, np.arange(1, len(texts))))
            styles += list(style(texts))
            sizes.append(np.diff(W.buffer(texts)[1]))
        cols = [*(batch.column(c) for c in ("id", "y", *meta)), pa.array(np.concatenate(sizes)), pa.array(cells, pa.list_(pa.int64())), pa.array(styles, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "y", *meta, "size", "cells", "style"])

    schema = T.StructType([sample.schema[c] for c in ("id", "y", *meta)]).add("size", "long")
    schema = schema.add("cells", T.ArrayType(T.LongType())).add("style", T.ArrayType(T.DoubleType()))
    table = arrow_pass(sample, step, schema).orderBy(F.xxhash64("id"), "id").toArrow().combine_chunks()
    y = table.column("y").to_numpy().astype(float)
    n = len(y)
    cells = table.column("cells").combine_chunks()
    row = np.repeat(np.arange(n), cells.value_lengths().to_numpy())
    content = View(n, row, cells.flatten().to_numpy(), np.array(table.column("style").to_pylist()), len(vocabulary))
    names = [table.column(c).combine_chunks() for c in meta]
    categories = [_frequent(c, settings.categories) for c in names]
    places = _cells(names, categories, table.column("size").to_numpy())
    width = sum(len(c) + 1 for c in categories) + MAX_SIZE_CLASS + 1
    metadata = View(n, np.repeat(np.arange(n), places.shape[1]), places.reshape(-1), np.zeros((n, 1)), width)
    models = co_train((content, metadata), y, settings)
    up = y[y >= 0].mean()
    return Scorer(vocabulary, categories, *models, float(np.log(up / (1 - up))))


def _frequent(values: pa.Array, most: int) -> list[str]:
    names, counts = np.unique([str(v.as_py()) for v in values], return_counts=True)
    return [str(names[i]) for i in np.lexsort((names, -counts))[:most]]


NEW = ("content_score", "metadata_score", "quality_score", "quality_keep")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"),
    settings: Training = Training(),
) -> DataFrame:
    """Score all documents: content, metadata and combined probability of being fit, and whether to keep.

    ``labels`` has (id, quality, toxic); a document is fit if quality is 1 and toxic is
    0, and rows with a null in any of them say nothing; of several labels of an id the
    worst counts. All columns of ``docs`` are kept (those named like the new ones are
    replaced), one row per input row; repeated rows get equal scores. A null text is
    scored as an empty one, null metadata as a category of its own. Without labels of
    both kinds scores are null and everything is kept.
    """
    bad = (F.col("quality") != 1) | (F.col("toxic") != 0)
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.when(bad, 0).when(~bad, 1).alias("y"))
    meta = [f"m_{i}" for i in range(len(meta_cols))]
    named = [F.col(f"`{c}`").cast("string").alias(m) for c, m in zip(meta_cols, meta)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    scorer = train(docs.select(F.col(f"`{id_col}`").alias("id"), text, *named), y, meta, settings)
    kept = [c for c in docs.columns if c not in NEW]
    if scorer is None:
        return docs.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast("double").alias(c) for c in NEW[:3]], F.lit(True).alias(NEW[3]))
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def step(texts: pa.Array, *names: pa.Array) -> pa.Array:
        scores = held.value.scores(texts, names)
        return pa.StructArray.from_arrays([*(pa.array(x) for x in scores.T), pa.array(scores[:, 2] >= settings.threshold)], names=list(NEW))

    kind = ", ".join(f"{n} double" for n in NEW[:3]) + f", {NEW[3]} boolean"
    return with_fields(docs.select(*[F.col(f"`{c}`") for c in kept]), step, [text, *named], kind)
