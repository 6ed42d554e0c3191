"""Ordered greedy linking against the loop over all pairs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.operators import linking

UNITS, SIMILAR = "root long, name long, block long, ord long, guard int", "name_a long, name_b long"


def by_hand(units, similar):
    like = {(a, b) for a, b in similar}
    parent = {u[0]: u[0] for u in units}
    guard = {u[0]: u[4] for u in units}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    blocks = defaultdict(list)
    for u in units:
        blocks[u[2]].append(u)
    for b in sorted(blocks):
        rows = sorted(blocks[b], key=lambda u: u[3])
        for i, u in enumerate(rows):
            for v in rows[i + 1 :]:
                if (u[1], v[1]) not in like:
                    continue
                x, y = find(u[0]), find(v[0])
                if x != y and not guard[x] & guard[y]:
                    x, y = min(x, y), max(x, y)
                    parent[y], guard[x] = x, guard[x] | guard[y]
    return {r: find(r) for r in parent}


def made(seed, n=60, names=12, surnames=3, roots=None, guards=(0, 1, 2, 3), density=0.3):
    """Records in order, each with a root, a name of a surname, and the root's guard; one unit for each root and name."""
    r = random.Random(seed)
    root_of, guard, units, first = {}, {}, {}, {}
    for ord_ in range(n):
        root = ord_ if not roots or r.random() < 0.5 else root_of[r.randrange(ord_)] if ord_ else ord_
        root_of[ord_] = root
        guard.setdefault(root, r.choice(guards))
        s = r.randrange(surnames)
        name = (s, r.randrange(names))
        first.setdefault(name, ord_)
        units.setdefault((root, name), ord_)
    block = {}
    for (s, _), o in first.items():
        block[s] = min(o, block.get(s, o))
    rows = [(root, first[name], block[name[0]], o, guard[root]) for (root, name), o in units.items()]
    near = {(first[x], first[y]) for x in first for y in first if x[0] == y[0] and x < y and r.random() < density}
    return rows, [*near, *((b, a) for a, b in near), *((x, x) for x in first.values())]


CASES = [dict(), dict(roots=True), dict(names=1, surnames=1), dict(names=1, surnames=1, guards=(1, 2)), dict(names=2, surnames=1, guards=(1, 2), density=1), dict(names=6, guards=(1, 2, 0), roots=True), dict(guards=(0,)), dict(guards=(1, 1, 1, 2), surnames=1)]


@pytest.mark.parametrize("case", CASES)
def test_in_one_task(case):
    for seed in range(150):
        units, similar = made(seed, n=random.Random(seed).choice([2, 5, 20, 60]), **case)
        like = defaultdict(list)
        for a, b in similar:
            like[a].append(b)
        random.Random(seed).shuffle(units)
        assert linking.link_in_order(units, like) == by_hand(units, similar), (case, seed)


@pytest.mark.parametrize("case", [CASES[1], CASES[3], CASES[5], CASES[7]])
def test_in_rounds(spark, case, monkeypatch):
    """Groups beyond a bucket go through rounds of joins; the same clusters."""
    monkeypatch.setattr(linking, "BUCKET_UNITS", 4)
    units, similar = made(7, n=50, **case)
    got = linking.link(spark.createDataFrame(units, UNITS).repartition(3), spark.createDataFrame(similar, SIMILAR))
    want = by_hand(units, similar)
    assert {r.root: want[r.root] for r in got.collect()} == {r.root: r.cluster_id for r in got.collect()}
    assert {r for r in want if want[r] != r} <= {r.root for r in got.collect()}


def rounds_of(monkeypatch):
    taken, plain = [], linking._round
    monkeypatch.setattr(linking, "_round", lambda *a: taken.append(1) or plain(*a))
    return taken


def test_equal_names_in_few_rounds(spark, monkeypatch):
    """One name of many records, a third each with e-mails, phones and neither: two rounds, whatever their number."""
    monkeypatch.setattr(linking, "BUCKET_UNITS", 100)
    taken = rounds_of(monkeypatch)
    n = 5000
    units = spark.range(n).select(F.col("id").alias("root"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("block"), F.col("id").alias("ord"), (F.xxhash64("id") % 3 + 3).bitwiseAND(F.lit(3)).cast("int").alias("guard"))
    units = units.withColumn("guard", F.when(F.col("guard") == 3, 0).otherwise(F.col("guard")))
    rows = sorted((r.ord, r.guard) for r in units.collect())
    got = {r.root: r.cluster_id for r in linking.link(units, spark.createDataFrame([(0, 0)], SIMILAR)).collect()}
    like = {0: [0]}
    assert got == linking.link_in_order([(o, 0, 0, o, g) for o, g in rows], like)
    assert len(taken) <= 3


def test_chain_in_few_rounds(spark, monkeypatch):
    """A chain of names, each like the next: the rounds grow with the logarithm of its length."""
    monkeypatch.setattr(linking, "BUCKET_UNITS", 20)
    taken = rounds_of(monkeypatch)
    n = 600
    at = lambda i: (i * 7919) % n
    units = spark.createDataFrame([(at(i), at(i), 0, at(i), 1 if i % 150 == 75 else 0) for i in range(n)], UNITS)
    links = [(at(i), at(i + 1)) for i in range(n - 1)]
    similar = [*links, *((b, a) for a, b in links), *((i, i) for i in range(n))]
    got = {r.root: r.cluster_id for r in linking.link(units, spark.createDataFrame(similar, SIMILAR)).collect()}
    like = defaultdict(list)
    for a, b in similar:
        like[a].append(b)
    assert got == linking.link_in_order([tuple(u) for u in units.collect()], like) and len(set(got.values())) == 4
    assert len(taken) <= 10
