"""Jaccard join of documents on word shingles, by a grouped prefix join.

The shingles of all documents are put into one global order, rare ones first. Two
sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1``
of each, and ``k`` among the first ``n - ceil(t n) + k``: its prefix. Documents with equal sets are one class. Classes with the
same prefix and size are one group, and only groups are indexed by the shingles
of their prefixes; group pairs pass the length and positional bounds, are
expanded to their members, pass a bound by histograms of their shingles and are
verified on the whole sets.

The result are components, so a pair inside a component needs no proof of its own.
Of the groups of a shingle, only neighbours by size are verified first, and again
neighbours among the components that are left; what then remains in different
components is verified pair by pair, and where a shingle or a group has many classes, in
blocks of classes that are compared inside a task.

Texts are read three times: to count shingles, to find prefixes and groups, and to
store the sorted sets of the classes that share a group or a prefix token with
another. All checks read these stored sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcast.llm import words as W
from gridcast.llm.frames import KEY, arrow_pass, components, first_of_each, give_back, key_filter, keyed, passes, run_pass, small_batches
from gridcast.plans.storage import materialize, scratch_path

ORDER_BITS = 18
#: Bins of the histogram of a set; a bin that is full in both sets of a pair proves nothing.
BINS, FULL = 256, 255
#: A prefix is long enough that two sets that reach the threshold share this many of its tokens.
SHARED = 8
#: At most this many rows of names (16 to 64 bytes each) are broadcast; beyond that joins shuffle.
MAX_BROADCAST = 200_000
#: A token or a group of more classes is dealt with in blocks of classes, not by pairs.
CROWD, BLOCK = 64, 512


class Order:
    """The global order: by how often shingles of the same 18-bit hash prefix occur.

    ``rank`` has the place of each of the 2**18 values; the token of a shingle is
    its rank followed by the rest of its hash, so it stands for the whole hash. Any
    order gives the same result; a better one gives fewer candidates. Its size
    does not grow with the corpus, its counts cover all of it.
    """

    def __init__(self, counts: np.ndarray):
        self.rank = np.empty(len(counts), np.uint64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes & np.uint64((1 << ORDER_BITS) - 1)
        return (self.rank[low] << np.uint64(64 - ORDER_BITS)) | (hashes >> np.uint64(ORDER_BITS))


def shingle_sets(texts: pa.Array, size: int, order: Order | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row splits, distinct shingles of each row, sorted)."""
    ws = W.split(texts, W.FOLDED)
    h = ws.hashes()
    first, grams = ws.windows(size, h)
    row = np.searchsorted(ws.splits, first, "right") - 1
    short = np.flatnonzero((ws.counts > 0) & (ws.counts < size))
    if len(short):
        grams = np.concatenate([grams, ws.spans(h, ws.splits[short], ws.splits[short + 1])])
        row = np.concatenate([row, short])
    if order is not None:
        grams = order.tokens(grams)
    by = np.lexsort((grams, row))
    grams, row = grams[by], row[by]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return np.searchsorted(row, np.arange(len(texts) + 1)), grams


def _sums(values: np.ndarray, splits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[splits]


def _count_buckets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for _, texts in W.slices(batch.column("__text")):
                _, grams = shingle_sets(texts, size)
                counts += np.bincount((grams & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
            give_back()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    return run


def global_order(rows: DataFrame, size: int) -> Order:
    """Count the shingles of all documents; at most 2**18 sums come to the driver."""
    sums = rows.select("__text").mapInArrow(_count_buckets(size), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    small_batches(rows)
    table = sums.toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return Order(counts)


def _prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    """Sets that reach the threshold share at least ``least`` shingles, so at least the smaller of
    that and ``SHARED`` among their prefixes."""
    least = (percent * n + 99) // 100
    return n - least + np.minimum(least, SHARED)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sides(splits: np.ndarray, grams: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Size, prefix length and the two 128-bit names (of the set, of prefix and size)."""
    n = np.diff(splits)
    prefix = _prefix_lengths(n, percent)
    parts = [W.mix(grams), W.mix(grams ^ np.uint64(0x5851F42D4C957F2D))]
    names = [W.mix(_sums(p, splits[:-1], splits[1:]) + n.astype(np.uint64)) for p in parts]
    names += [W.mix(_sums(p, splits[:-1], splits[:-1] + prefix) * np.uint64(3) + n.astype(np.uint64)) for p in parts]
    return n, prefix, *names


NAMES = ("s0", "s1", "g0", "g1")


def _document_rows(size: int, percent: int, order):
    """Size and names of each document; its prefix with the first row of a group in a slice."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts, prefixes = [], []
        for _, texts in W.slices(batch.column("__text")):
            splits, grams = shingle_sets(texts, size, order.value)
            n, prefix, *names = _sides(splits, grams, percent)
            parts.append((n, *names))
            lone = first_of_each(W.mix(names[2] ^ W.mix(names[3])))[1] & (prefix > 0)
            held = np.where(lone, prefix, 0)
            row = np.repeat(splits[:-1], held)
            places = row + np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
            ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
            prefixes.append(pa.ListArray.from_arrays(pa.array(ends), _signed(grams[places]), mask=pa.array(~lone)))
        if not parts:
            return None
        n, *names = (np.concatenate(x) for x in zip(*parts))
        rest = [batch.column("__id"), *(batch.column(k) for k in KEY), pa.array(n.astype(np.int64))]
        columns = [*rest, *map(_signed, names), pa.concat_arrays(prefixes)]
        return pa.RecordBatch.from_arrays(columns, names=["__id", *KEY, "n", *NAMES, "prefix"])

    return step


def _stored_sets(size: int, order, wanted):
    """Sorted tokens, and how many fall into each bin (one byte a bin), of rows that may be wanted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        places = [batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in KEY]
        some = passes(wanted.value, places[0]) & passes(wanted.value, places[1])
        some &= first_of_each(W.mix(places[0] ^ W.mix(places[1])))[1]
        batch = batch.filter(pa.array(some))
        bins, tokens = [], []
        for _, texts in W.slices(batch.column("__text")):
            splits, grams = shingle_sets(texts, size, order.value)
            row = np.repeat(np.arange(len(texts)), np.diff(splits))
            place = (W.mix(grams) & np.uint64(BINS - 1)).astype(np.int64)
            counts = np.bincount(row * BINS + place, minlength=len(texts) * BINS).reshape(-1, BINS)
            bins += [c.tobytes() for c in np.minimum(counts, FULL).astype(np.uint8)]
            raw = memoryview(grams.view(np.uint8))
            tokens += [raw[8 * a : 8 * b] for a, b in zip(splits[:-1].tolist(), splits[1:].tolist())]
        columns = [*(batch.column(k) for k in KEY), pa.array(bins, pa.binary()), pa.array(tokens, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*KEY, "bins", "tokens"])

    return step


def _bins_allow(percent: int):
    """Pairs whose sets may overlap enough: in no bin by more than the smaller count."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("x", "y"))
        most = np.minimum(x, y)
        both = np.array(batch.column("n").to_numpy()) + batch.column("m").to_numpy()
        good = (100 + percent) * most.sum(1, dtype=np.int64) >= percent * both
        return batch.filter(pa.array(good | (most == FULL).any(1))).select(["u", "v"])

    return step


def _sets(tokens: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint64) for t in tokens]


LINK = "u struct<s0: long, s1: long>, v struct<s0: long, s1: long>"


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of blocks of the incidence matrix."""
    every, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    again = seen > 1  # what only one set holds adds to no intersection
    row, column = row[again[column]], (np.cumsum(again) - 1)[column[again[column]]]
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    total, width = np.zeros((len(sets), len(sets))), 1 << 12
    for first in range(0, int(again.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], column[a:b] - first] = 1
        total += block @ block.T
    return total


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric relation joins."""
    seen, edges = np.zeros(len(linked), bool), []
    for start in range(len(linked)):
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(linked[i] & ~seen):
                seen[j] = True
                edges.append((i, int(j)))
                todo.append(int(j))
    return edges


def _unit_links(percent: int):
    """Links of all pairs of a unit (two blocks, or one with itself), as a spanning forest."""

    def step(table: pa.Table, splits: np.ndarray) -> pa.RecordBatch | None:
        names = [table.column(k).to_numpy() for k in ("s0", "s1")]
        links = []
        for a, b in zip(splits[:-1].tolist(), splits[1:].tolist()):
            if b - a < 2:
                continue
            sets = _sets(table.column("tokens").slice(a, b - a))
            both = _overlaps(sets)
            n = np.array([len(s) for s in sets])
            linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
            links += [(a + i, a + j) for i, j in _forest(linked)]
        if not links:
            return None
        ends = np.array(links).T
        cols = [pa.StructArray.from_arrays([pa.array(x[e]) for x in names], names=["s0", "s1"]) for e in ends]
        return pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    return step


def _pair_links(percent: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        good = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(_sets(batch.column("x")), _sets(batch.column("y")))):
            both = len(np.intersect1d(a, b, assume_unique=True))
            good[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return batch.filter(pa.array(good)).select(["u", "v"])

    return step


def _may_link(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Length and positional bounds of two sets that share the token at ``pos`` and ``at``."""
    most = F.least(pos, at) + 1 + F.least(n - pos - 1, m - at - 1)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _few(rows: DataFrame) -> bool:
    return rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST


def _class_sets(members: DataFrame, listed: DataFrame, rows: DataFrame, order, size: int) -> DataFrame:
    """(s, n, bins, tokens) of the classes ``members``, from one document of each."""
    places = materialize(members.select("s", "n", "doc.__a", "doc.__b"))
    wanted = rows.sparkSession.sparkContext.broadcast(key_filter(places.select(*KEY)))
    found = arrow_pass(rows.select("__text", *KEY), _stored_sets(size, order, wanted), "__a long, __b long, bins binary, tokens binary")
    # rows with equal text and id share the key
    repeated = listed.groupBy(*KEY).count().where("count > 1").join(places, list(KEY), "left_semi")
    if _few(places) and not repeated.take(1):
        one = found.join(F.broadcast(places), list(KEY))
    else:
        one = found.join(places, list(KEY)).dropDuplicates([*KEY])
    # hashes do not compress, and a codec would hold whole pages of them outside the heap
    path = scratch_path(rows.sparkSession, "sets")
    one = one.select("s", "n", "bins", "tokens")
    one.write.option("compression", "none").parquet(path)
    return rows.sparkSession.read.schema(one.schema).parquet(path)


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that the histograms allow."""
    x = sets.select(F.col("s").alias("u"), "n", F.col("bins").alias("x"))
    y = sets.select(F.col("s").alias("v"), F.col("n").alias("m"), F.col("bins").alias("y"))
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "n", "m", "x", "y")
    return materialize(arrow_pass(both, _bins_allow(percent), LINK))


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (u, v) of classes that are links."""
    x = sets.select(F.col("s").alias("u"), F.col("tokens").alias("x"))
    y = sets.select(F.col("s").alias("v"), F.col("tokens").alias("y"))
    if _few(pairs):  # only the sets of these pairs are shuffled then
        both = x.join(F.broadcast(pairs), "u").join(y.join(F.broadcast(pairs.select("v").distinct()), "v", "left_semi"), "v")
    else:
        both = pairs.join(x, "u").join(y, "v")
    return arrow_pass(both.select("u", "v", "x", "y"), _pair_links(percent), LINK)


def _verify_crowds(crowds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among all classes (s) of each crowd, block by block."""
    blocks = crowds.groupBy("crowd").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("blocks"))
    rows = crowds.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("s", "crowd"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.where("block <> other OR blocks = 1")  # a unit of two blocks compares each with itself too
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = rows.select("s", F.xxhash64("crowd", low, high).alias("k0"), F.xxhash64(high, low, "crowd").alias("k1"))
    stored, names = sets.select("s", "tokens"), materialize(crowds.select("s").distinct())
    if _few(names):  # only the sets of these classes are shuffled then
        stored = stored.join(F.broadcast(names), "s", "left_semi")
    held = units.join(stored, "s").select("s.*", "k0", "k1", "tokens")
    return run_pass(held, ["k0", "k1"], _unit_links(percent), LINK)


def _with_roots(classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    name = F.struct("s0", "s1")
    if roots is None:
        return classes.withColumn("root", name)
    return classes.withColumn("node", name).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard of at least ``percent`` / 100.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the
    distinct runs of ``size`` words, or the whole sequence of a shorter document.
    Returns (id, n_shingles, component_id, is_first, __a, __b), one row per input row:
    the smallest id of the component, whether the row (or one equal to it) stands for
    the component, and the row key of ``frames.row_key``. A null or blank text has an empty set, links with nothing and
    is its own component; repeated rows link; null ids take part, but a component
    is named by an id only if it has one that is not null. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["__id"].dataType.simpleString()
    order = spark.sparkContext.broadcast(global_order(rows, size))
    schema = f"__id {kind}, __a long, __b long, n long, s0 long, s1 long, g0 long, g1 long, prefix array<long>"
    listed = materialize(arrow_pass(rows, _document_rows(size, percent, order), schema))
    classes = materialize(
        listed.where("n > 0").groupBy("s0", "s1").agg(
            F.min(F.struct(F.isnull("__id").alias("none"), "__id", *KEY)).alias("doc"),
            *[F.min(c).alias(c) for c in ("n", "g0", "g1")],
        )
    )
    roots = components(_links(rows, listed, classes, order, size, percent))
    named = _with_roots(classes.select("s0", "s1", "doc"), roots)
    least = named.groupBy("root").agg(F.min("doc").alias("first"))
    of_class = _with_roots(classes.select("s0", "s1"), roots).join(least, "root").select("s0", "s1", "first")
    filled, blank = listed.where("n > 0").join(of_class, ["s0", "s1"]), listed.where("n = 0")
    first = (F.col("__a") == F.col("first.__a")) & (F.col("__b") == F.col("first.__b"))
    size = F.col("n").alias("n_shingles")
    filled = filled.select("__id", size, F.col("first.__id").alias("component_id"), first.alias("is_first"), *KEY)
    blank = blank.select("__id", size, F.col("__id").alias("component_id"), F.lit(True).alias("is_first"), *KEY)
    return filled.unionByName(blank).withColumnRenamed("__id", id_col)


def _with_others(percent: int):
    """Rows, sorted by token, size and group, whose token another group of a size that allows a link has too.

    Of all groups with the token, the neighbours are closest in size. What stands before the first
    and behind the last row of a partition is not known here, so these two are kept. A group that
    several slices have found is kept once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first = True
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            token, group = rows.column("token").to_numpy(), rows.column("g0").to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
            place = np.flatnonzero(new)
            token, n = token[place], rows.column("n").to_numpy()[place].astype(np.int64)
            # the two last rows go on: the last is judged by what follows, the one before it shows what was before
            before, after = np.zeros(len(token), bool), np.zeros(len(token), bool)
            before[1:] = after[:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            good = before | after
            good[0] = first or (good[0] and held is None)
            start = 0 if first else 1
            if len(place) > 1:
                first = False
                out = place[start:-1][good[start:-1]]
                held = rows.take(pa.array(place[-2:]))
                if len(out):
                    yield rows.take(pa.array(out)).combine_chunks().to_batches()[0]
            else:
                held = rows.take(pa.array(place))
        if held is not None and held.num_rows:
            yield held.slice(held.num_rows - 1).combine_chunks().to_batches()[0]

    return run


def _shared_tokens(listed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(token, g0, g1, n, pos): prefix tokens that several groups of like size have, of groups with enough of them.

    Rows are dealt out by ranges of token, size and group, so that no task needs to hold all
    rows of a token, and neighbours show which tokens several groups have.
    """
    tokens = listed.where("prefix IS NOT NULL").select("g0", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    laid = tokens.repartitionByRange("token", "n", "g0").sortWithinPartitions("token", "n", "g0")
    shared = materialize(laid.mapInArrow(_with_others(percent), "g0 long, n int, pos int, token long"))
    least = F.least(F.lit(SHARED), F.expr(f"({percent} * n + 99) div 100"))
    counts = shared.groupBy("g0", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    kept = counts.select("g0").join(classes.select("g0", "g1").distinct(), "g0")
    return materialize(shared.join(kept, "g0").select("token", "g0", "g1", "n", "pos").distinct())


def _links(rows: DataFrame, listed: DataFrame, classes: DataFrame, order, size: int, percent: int) -> DataFrame:
    """Links that join the classes of each component."""
    group = ["g0", "g1"]
    shared = _shared_tokens(listed, classes, percent)
    # groups that hold several classes, or share a token with another group
    several = classes.groupBy(*group).count().where("count > 1").select(*group)
    wanted = shared.select(*group).unionByName(several).distinct()
    members = materialize(classes.join(wanted, group, "left_semi").withColumn("s", F.struct("s0", "s1")))
    sets = _class_sets(members, listed, rows, order, size)
    few = _few(members)  # there are no more groups than classes
    links = None
    # twice: neighbours among the components that a group or a token still has; here two rounds of them will do
    for seed in (1, 2):
        held = materialize(_with_roots(members.select("s0", "s1", "n", *group), components(links, rounds=2) if links else None))
        chain = _plausible(_neighbours(held, shared, percent, seed, few), sets, percent)
        found = materialize(_verify_pairs(chain, sets, percent))
        links = found if links is None else links.unionByName(found)
    # every pair that the bounds allow and that is still apart
    held = materialize(_with_roots(members.select("s0", "s1", "n", *group), components(links)))
    span = materialize(_spans(held))
    mixed = materialize(_mixed_tokens(shared, F.broadcast(span) if few else span).drop("s"))
    crowded = materialize(mixed.groupBy("token").agg(F.sum("k").alias("k")).where(F.col("k") > CROWD).select("token"))
    crowds = materialize(_crowds(mixed.join(crowded, "token"), held, span))
    pairs = _pairs_apart(mixed.join(crowded, "token", "left_anti"), shared, held, span, percent)
    links = links.unionByName(_verify_pairs(_plausible(pairs, sets, percent), sets, percent))
    return materialize(links.unionByName(_verify_crowds(crowds, sets, percent)))


def _crowds(mixed: DataFrame, held: DataFrame, span: DataFrame) -> DataFrame:
    """(crowd, s): the classes of tokens with many classes, and of large groups that are apart.

    Tokens with the same groups, like those of a passage that many documents share, make one crowd.
    """
    name = F.xxhash64("g0", "g1").cast("decimal(38,0)")
    alike = mixed.groupBy("token").agg(F.sum(name).alias("name"), F.sum("k").alias("k")).groupBy("name", "k").agg(F.min("token").alias("token"))
    of_token = mixed.join(alike.select("token"), "token", "left_semi").select(F.xxhash64("token").alias("crowd"), "g0", "g1")
    large = span.where((F.col("k") > CROWD) & (F.col("low") != F.col("high")))
    of_group = large.select(F.xxhash64("g0", "g1", F.lit("group")).alias("crowd"), "g0", "g1")
    classes = held.select("g0", "g1", F.struct("s0", "s1").alias("s"))
    return of_token.unionByName(of_group).join(classes, ["g0", "g1"]).select("crowd", "s").distinct()


def _spans(held: DataFrame) -> DataFrame:
    """By group: the smallest and largest root of its classes, one class, and their number."""
    return held.groupBy("g0", "g1").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("s0", "s1")).alias("s"), F.count(F.lit(1)).alias("k")
    )


def _neighbours(held: DataFrame, shared: DataFrame, percent: int, seed: int, few: bool) -> DataFrame:
    """Pairs of neighbours, by size, of one class for each component of a token or a group.

    A token whose groups are all in one component has one class here, and so no pair.
    """
    span = materialize(_spans(held)).select("g0", "g1", "low", "s")
    # tokens meet in narrow rows, if what is known of their groups can be joined there
    rows = shared.repartition("token").join(F.broadcast(span), ["g0", "g1"]) if few else shared.join(span, ["g0", "g1"])
    pick = F.xxhash64("token", "g0", "g1", F.lit(seed))
    one = rows.groupBy("token", "low").agg(F.min_by(F.struct("n", "s", "pos"), pick).alias("r"))
    last = F.lag("r").over(Window.partitionBy("token").orderBy("r.n", F.xxhash64("r.s", F.lit(seed)), "r.s"))
    pairs = one.withColumn("l", last).where(_may_link(F.col("r.n"), F.col("r.pos"), F.col("l.n"), F.col("l.pos"), percent))
    inside = Window.partitionBy("g0", "g1").orderBy(F.xxhash64("s0", "s1", F.lit(seed)), "s0", "s1")
    name = F.struct("s0", "s1")
    own = held.select(name.alias("r"), F.lag(name).over(inside).alias("l"), "root", F.lag("root").over(inside).alias("other"))
    own = own.where("root <> other").select("r", "l")
    ends = F.least("r", "l").alias("u"), F.greatest("r", "l").alias("v")
    return pairs.select(F.col("r.s").alias("r"), F.col("l.s").alias("l")).unionByName(own).select(*ends).distinct()


def _mixed_tokens(shared: DataFrame, span: DataFrame) -> DataFrame:
    """Rows of tokens whose groups are not all in one component.

    Tokens meet in narrow rows; what is known of a group is joined to those that are left.
    """
    ends = shared.join(span.select("g0", "g1", "low", "high"), ["g0", "g1"]).groupBy("token")
    ends = ends.agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("token")
    return shared.join(ends, "token").join(span, ["g0", "g1"])


def _enough_common(common: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups with enough rows in ``common``, which has one for each common token, for a link.

    Two sets that reach the threshold share ``SHARED`` of the tokens of their prefixes, or as many as
    the smaller must share, and what comes after the last common one bounds the rest. Crowded tokens
    have no rows; pairs that share one of them are compared in its crowd.
    """
    turned = F.struct("l_g0", "l_g1") > F.struct("g0", "g1")
    ends = [("g0", "g1", "n", "pos"), ("l_g0", "l_g1", "l_n", "l_pos")]
    columns = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(c) for x, y in (ends, ends[::-1]) for a, b, c in zip(x, y, x)]
    every = common.select(*columns).groupBy("l_g0", "l_g1", "g0", "g1").agg(
        F.count(F.lit(1)).alias("c"), *[F.max(c).alias(c) for c in ("l_n", "n", "l_pos", "pos")]
    )
    most = F.col("c") + F.least(F.col("l_n") - F.col("l_pos"), F.col("n") - F.col("pos")) - 1
    both = F.col("l_n").cast("long") + F.col("n")
    enough = (F.col("c") >= SHARED) | (100 * F.col("c") >= percent * F.least("l_n", "n").cast("long"))
    return every.where(enough & ((100 + percent) * most >= percent * both)).select("l_g0", "l_g1", "g0", "g1")


def _enough_shared(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups whose common prefix tokens, and all that comes after the last, suffice."""
    rows = shared.groupBy("g0", "g1").agg(F.min("n").alias("n"), F.collect_list("token").alias("tokens"), F.collect_list("pos").alias("places"))
    rows = materialize(rows)
    left = rows.select(*[F.col(c).alias(f"l_{c}") for c in rows.columns])
    both = pairs.join(left, ["l_g0", "l_g1"]).join(rows, ["g0", "g1"]).withColumn("common", F.array_intersect("l_tokens", "tokens"))
    # tokens are unsigned, and places follow their order
    last = F.array_max(F.transform("common", lambda t: t.bitwiseXOR(F.lit(-(1 << 63))))).bitwiseXOR(F.lit(-(1 << 63)))
    seen = both.where(F.size("common") > 0).withColumn("last", last).select(
        "l_g0", "l_g1", "g0", "g1", "l_n", "n", F.size("common").alias("c"),
        F.element_at("l_places", F.array_position("l_tokens", F.col("last")).cast("int")).alias("i"),
        F.element_at("places", F.array_position("tokens", F.col("last")).cast("int")).alias("j"),
    )
    most = F.col("c") + F.least(F.col("l_n") - F.col("i"), F.col("n") - F.col("j")) - 1
    return seen.where((100 + percent) * most >= percent * (F.col("l_n") + F.col("n"))).select("l_g0", "l_g1", "g0", "g1")


def _pairs_apart(mixed: DataFrame, shared: DataFrame, held: DataFrame, span: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes in different components that share a small group or enough of the tokens.

    Neither has more than ``CROWD`` classes, which bounds the pairs of each. Of each token, the component with most groups is compared with the others, not
    with itself.
    """
    group = ["g0", "g1"]
    of_token = Window.partitionBy("token")
    alone = F.when(F.col("low") == F.col("high"), F.col("low"))
    most = F.max(F.when(alone.isNotNull(), F.struct("m", "low"))).over(of_token)
    rows = mixed.select("token", *group, "n", "pos", "low", "high").repartition("token")
    rows = rows.withColumn("m", F.count(alone).over(Window.partitionBy("token", "low"))).withColumn("main", most["low"])
    minor = F.coalesce(~((F.col("low") == F.col("main")) & (F.col("high") == F.col("main"))), F.lit(True))
    marked = rows.select("token", *group, "n", "pos", "low", "high", minor.alias("minor"))
    left = marked.where("minor").select("token", *[F.col(c).alias(f"l_{c}") for c in ("g0", "g1", "n", "pos", "low", "high")])
    own, other = F.struct("l_g0", "l_g1"), F.struct("g0", "g1")
    common = left.join(marked, "token").where(
        _may_link(F.col("l_n"), F.col("l_pos"), F.col("n"), F.col("pos"), percent)
        & (~F.col("minor") | (own < other))
        & ~((F.col("l_low") == F.col("l_high")) & (F.col("low") == F.col("high")) & (F.col("l_low") == F.col("low")))
        & (own != other)
    )
    pairs = materialize(_enough_common(common, percent))
    ends = materialize(pairs.select(*group).unionByName(pairs.select(F.col("l_g0").alias("g0"), F.col("l_g1").alias("g1"))).distinct())
    pairs = _enough_shared(pairs, shared.join(F.broadcast(ends) if _few(ends) else ends, group, "left_semi"), percent)
    node = F.struct("s0", "s1")
    u = held.select(F.col("g0").alias("l_g0"), F.col("g1").alias("l_g1"), node.alias("u"), F.col("root").alias("u_root"))
    v = held.select(*group, node.alias("v"), F.col("root").alias("v_root"))
    across = pairs.join(u, ["l_g0", "l_g1"]).join(v, group).where("u_root <> v_root").select("u", "v")
    uneven = span.where((F.col("low") != F.col("high")) & (F.col("k") <= CROWD)).select(*group)
    own = held.join(uneven, group, "left_semi")
    a = own.select(*group, node.alias("u"), F.col("root").alias("u_root"))
    b = own.select(*group, node.alias("v"), F.col("root").alias("v_root"))
    within = a.join(b, group).where((F.col("u") < F.col("v")) & (F.col("u_root") != F.col("v_root"))).select("u", "v")
    return across.unionByName(within).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
