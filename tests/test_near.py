"""Greedy near dedup against a plain loop, on chains, crowds and components, and components of graphs."""

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import dedup
from loam.operators.components import components
from loam.plans import catalogue
from tests.conftest import SF
from tests.helpers import same


def plain(rows):
    kept, out = [], []
    for i, t in sorted(rows):
        w = set(t.lower().split())
        dup = bool(w) and any(20 * len(w & k) > 19 * len(w | k) for k in kept)
        out.append((i, dup))
        if not dup and w:
            kept.append(w)
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "i int, t string").repartition(4)
    return sorted((r["i"], r["is_dup"]) for r in dedup.near(df, F.lower("t"), "i").collect())


def chain(n, start=0, size=60, at=0):
    """Texts of which each shares all but one word with the next: every second one goes."""
    return [(at + i, " ".join(f"c{start}w{j}" for j in range(i, i + size))) for i in range(n)]


def crowd(rng, n, at, size=50, name="g"):
    base = [f"{name}{j}" for j in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        words[rng.randrange(size)] = f"own{name}{i}" if rng.random() < 0.7 else f"odd{rng.randrange(5)}"
        out.append((at + i, " ".join(words)))
    return out


def jobs(spark, work):
    tracker = spark.sparkContext
    before = len(tracker.statusTracker().getJobIdsForGroup("near"))
    tracker.setJobGroup("near", "near")
    got = work()
    after = len(tracker.statusTracker().getJobIdsForGroup("near"))
    tracker._jsc.clearJobGroup()
    return got, after - before


def test_long_chains_take_no_more_jobs(spark):
    short, few = jobs(spark, lambda: found(spark, chain(20)))
    long_, many = jobs(spark, lambda: found(spark, chain(1000)))
    assert short == plain(chain(20)) and long_ == plain(chain(1000))
    assert many <= few + 4


@pytest.mark.parametrize(("crowds", "task"), [(8, 10**6), (0, 10**6), (0, 40), (10**9, 40)])
def test_same_rows_go_whatever_the_way(spark, monkeypatch, crowds, task):
    monkeypatch.setattr(dedup, "CROWDED", crowds)
    monkeypatch.setattr(dedup.decided, "__defaults__", (task,))
    rng = random.Random(crowds + task)
    rows = chain(120) + crowd(rng, 80, 1000) + crowd(rng, 60, 2000, 30, "h") + [(3000 + i, f"few words {i % 5}") for i in range(40)]
    rows += [(4000 + i, rows[rng.randrange(len(rows))][1] + (" more" if i % 3 else "")) for i in range(60)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert found(spark, rows) == plain(rows)


def test_a_crowd_of_near_copies_is_not_compared_pair_by_pair(spark):
    rows = crowd(random.Random(1), 1500, 0)
    df = spark.createDataFrame(rows, "i int, t string")
    sets = dedup.word_sets(df, F.lower("t"), "i")
    short = dedup.prefixes(sets, (19, 20))
    assert dedup.crowded(short)
    heads, gone = dedup.settled(short, sets, (19, 20))
    assert heads.count() >= 1
    expected = {i for i, d in plain(rows) if d}
    leads = {r["k"]: r["lead"] for r in sets.collect()}
    assert {leads[r["v"]] for r in gone.collect()} <= expected
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("held", [3, 50, 10**6])
def test_components_of_random_graphs(spark, held):
    rng = random.Random(held)
    edges = [(rng.randrange(400) * 10**15, rng.randrange(400) * 10**15) for _ in range(260)] + [(i, i + 1) for i in range(-50, 0)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    expected = {x: root(x) for x in parent}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), held).collect()}
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long"), held).count() == 0


@pytest.mark.parametrize("name", ["near_dedup", "near_dup_pairs"])
def test_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)
