"""What the n-gram join moves: whole sets only where they are compared, pairs of groups without a row for each token."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridcast.llm import ngram_join as nj


def plan(df):
    return df._jdf.queryExecution().toString()


def signed(x):
    return x if x < 1 << 63 else x - (1 << 64)


def test_pairs_of_groups_are_judged_without_a_row_for_each_token(spark):
    dice, groups = random.Random(5), {}
    for g in range(25):
        groups[g] = dice.randint(30, 60), sorted(dice.sample(range(60), dice.randint(3, 25)))
    rows = [(signed(t << 58 | 5), g, -g, n, at) for g, (n, tokens) in groups.items() for at, t in enumerate(tokens)]
    shared = spark.createDataFrame(rows, "token long, g0 long, g1 long, n int, pos int").repartition(3)
    every = [(a, b) for a in groups for b in groups if a < b]
    pairs = spark.createDataFrame([(a, -a, b, -b) for a, b in every], "l_g0 long, l_g1 long, g0 long, g1 long")
    for percent in (20, 40, 60):
        got = nj._enough_shared(pairs, shared, percent)
        assert not [x for x in plan(got).splitlines() if "Exchange hashpartitioning" in x and "token" in x.split("ENSURE")[0]]
        want = set()
        for a, b in every:
            (n, x), (m, y) = groups[a], groups[b]
            if both := {*x} & {*y}:
                most = len(both) + min(n - x.index(max(both)), m - y.index(max(both))) - 1
                if (100 + percent) * most >= percent * (n + m):
                    want.add((a, b))
        assert {(r.l_g0, r.g0) for r in got.collect()} == want and want


def test_only_sets_of_crowded_classes_are_shuffled(spark):
    name = lambda i: (i, -i)
    tokens = {i: bytearray(np.arange(i // 4 * 100, i // 4 * 100 + 20, dtype=np.uint64).tobytes()) for i in range(40)}
    sets = spark.createDataFrame([(name(i), t) for i, t in tokens.items()], "s struct<s0: long, s1: long>, tokens binary")
    crowds = spark.createDataFrame([(7, name(i)) for i in range(8)], "crowd long, s struct<s0: long, s1: long>")
    got = nj._verify_crowds(crowds, sets, 85)
    assert "BroadcastHashJoin" in plan(got) and "LeftSemi" in plan(got)
    links = [(r.u.s0, r.v.s0) for r in got.collect()]
    assert len(links) == 6 and all(u // 4 == v // 4 for u, v in links)
    assert {i for pair in links for i in pair} == set(range(8))


def test_mixed_tokens_meet_in_narrow_rows(spark):
    shared = spark.createDataFrame([(1, 1, 1, 9, 0), (1, 2, 2, 9, 1), (2, 1, 1, 9, 1), (2, 3, 3, 9, 0)], "token long, g0 long, g1 long, n int, pos int")
    spans = [(g, g, (r, r), (r, r), 1, (g, g)) for g, r in ((1, 5), (2, 6), (3, 5))]
    span = spark.createDataFrame(spans, "g0 long, g1 long, low struct<a: long, b: long>, high struct<a: long, b: long>, k long, s struct<a: long, b: long>")
    got = nj._mixed_tokens(shared, F.broadcast(span))
    assert sorted((r.token, r.g0, r.low.a, r.k) for r in got.collect()) == [(1, 1, 5, 1), (1, 2, 6, 1)]
    assert "BroadcastHashJoin" in plan(got).split("== Physical Plan ==")[-1]
