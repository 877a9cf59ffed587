"""Which tokens and pairs of groups the n-gram join keeps: those of groups whose sizes and common tokens allow a link."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from gridcast.llm import ngram_join as nj


def test_tokens_of_groups_of_unlike_size_are_dropped():
    dice, percent = random.Random(3), 85
    for _ in range(60):
        rows = {(dice.randint(0, 12), dice.randint(1, 40), g) for g in range(dice.randint(2, 60))}
        rows = sorted(rows)
        want = {r for r in rows if any(r[0] == x[0] and r != x and 100 * min(r[1], x[1]) >= percent * max(r[1], x[1]) for x in rows)}
        told = sorted(r for r in rows for _ in range(dice.randint(1, 3)))  # a group may be found by several slices
        batches, at = [], 0
        while at < len(told):
            part = told[at : at + dice.randint(1, 7)]
            at += len(part)
            token, n, g = zip(*part)
            batches.append(pa.RecordBatch.from_arrays([pa.array(g), pa.array(n, pa.int32()), pa.array([0] * len(g), pa.int32()), pa.array(token)], names=["g0", "n", "pos", "token"]))
        got = [(r["token"], r["n"], r["g0"]) for b in nj._with_others(percent)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len({*got}) and want <= {*got} <= want | {rows[0], rows[-1]}


def test_pairs_of_groups_need_enough_common_tokens(spark):
    dice, percent = random.Random(4), 40
    groups = {g: (dice.randint(30, 60), sorted(dice.sample(range(60), dice.randint(2, 28)))) for g in range(25)}
    groups[25] = (5, [1, 2, 3])  # such small sets must share fewer tokens than SHARED
    groups[26] = (4, [1, 2, 3])
    rows, want = [], set()
    for a, (n, x) in groups.items():
        for b, (m, y) in groups.items():
            if a >= b or not (both := sorted({*x} & {*y})):
                continue
            for t in both:  # a pair may stand either way round
                u, v = ((a, -a, n, x.index(t)), (b, -b, m, y.index(t)))[:: dice.choice((1, -1))]
                rows.append((*u, *v))
            most = len(both) + min(n - x.index(both[-1]), m - y.index(both[-1])) - 1
            if 140 * most >= percent * (n + m) and len(both) >= min(nj.SHARED, -(-percent * min(n, m) // 100)):
                want.add((a, b))
    common = spark.createDataFrame(rows, "l_g0 long, l_g1 long, l_n int, l_pos int, g0 long, g1 long, n int, pos int").repartition(3)
    got = [(r.l_g0, r.g0) for r in nj._enough_common(common, percent).collect()]
    assert sorted(got) == sorted(want) and (25, 26) in want


def test_neighbours_deal_tokens_out_once(spark):
    names = "g0 long, g1 long"
    held = spark.createDataFrame([(g, g, 9, g, g, (g, g)) for g in range(6)], f"s0 long, s1 long, n int, {names}, root struct<s0: long, s1: long>")
    shared = spark.createDataFrame([(t, g, g, 9, t) for g in range(6) for t in range(g // 2, 4)], f"token long, {names}, n int, pos int")
    got = nj._neighbours(held, shared, 85, 1, True)
    text = got._jdf.queryExecution().executedPlan().toString()
    by_token = [x for x in text.splitlines() if "Exchange hashpartitioning(token" in x]
    assert len(by_token) == 1 and "token" in by_token[0] and "low" not in by_token[0]
    assert {(r.u.s0, r.v.s0) for r in got.collect()} <= {(a, b) for a in range(6) for b in range(a + 1, 6)}
    assert got.select(F.countDistinct("v")).first()[0] == 5
