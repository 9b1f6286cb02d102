"""The stratified deal against a plain replay of its rule, on large and skewed queues."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import deal, split
from loam.plans import catalogue
from tests.conftest import SF
from tests.helpers import same


def plain(queue, train, val):
    """The rule, group by group, with all counters in one place."""
    n = len(queue)
    goal = [int(n * train)]
    goal.append((n - goal[0]) // 2)
    goal.append(n - sum(goal))
    parts, seen = ([], [], []), {}
    for group, code in queue:
        s = seen.setdefault(code, [0, 0, 0])
        full = [len(p) >= g for p, g in zip(parts, goal)]
        share = [s[i] / sum(s) if sum(s) else 0.0 for i in (0, 1)]
        if not full[0] and (share[0] < train or full[1] and full[2]):
            to = 0
        elif not full[1] and (share[1] < val or full[2]):
            to = 1
        else:
            to = 2
        parts[to].append(group)
        s[to] += 1
    if abs(len(parts[1]) - len(parts[2])) > 2:
        half = (len(parts[1]) + len(parts[2])) // 2
        large, small = (1, 2) if len(parts[1]) > len(parts[2]) else (2, 1)
        k = len(parts[1]) - half if large == 1 else half - len(parts[1])
        parts[small].extend(parts[large][:k])
        del parts[large][:k]
    return {g: name for name, p in zip(deal.PARTS, parts) for g in p}


def queue_of(spark, codes):
    return spark.createDataFrame([(f"g{i}", c, i) for i, c in enumerate(codes)], "group string, code string, place long").repartition(5)


CASES = {
    "hot": (lambda r: ["hot"] * (r.random() < 0.6) or [f"c{r.randrange(40)}"], 0.8, 0.1),
    "odd shares": (lambda r: [f"c{r.randrange(5)}"], 0.71, 0.23),
    "mostly train": (lambda r: [f"c{r.randrange(3)}"], 0.95, 0.1),
    "no val": (lambda r: [f"c{r.randrange(7)}"], 0.6, 0.0),
    "all train": (lambda r: [f"c{r.randrange(7)}"], 1.0, 0.0),
    "no train": (lambda r: [None if r.random() < 0.2 else f"c{r.randrange(4)}"], 0.0, 0.5),
    "single codes": (lambda r: [f"c{r.randrange(10**6)}"], 0.8, 0.1),
}


@pytest.mark.parametrize("case", CASES)
def test_deal_equals_replay(spark, monkeypatch, case):
    monkeypatch.setattr(deal, "BLOCK", 97)
    make, train, val = CASES[case]
    rng = random.Random(case)
    codes = [make(rng)[0] for _ in range(3000)]
    got = {r["group"]: r["split"] for r in deal.deal(queue_of(spark, codes), train, val).collect()}
    assert got == plain([(f"g{i}", c) for i, c in enumerate(codes)], train, val)


def test_deal_changes_where_a_code_starts_late(spark, monkeypatch):
    """Parts fill while one code has had no group yet: it starts under the rule of a later phase."""
    monkeypatch.setattr(deal, "BLOCK", 50)
    codes = ["a"] * 700 + ["b"] * 300
    got = {r["group"]: r["split"] for r in deal.deal(queue_of(spark, codes), 0.5, 0.4).collect()}
    assert got == plain([(f"g{i}", c) for i, c in enumerate(codes)], 0.5, 0.4)


def test_deal_of_a_million_groups(spark):
    n = 1_000_000
    code = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.xxhash64("id") % 50).cast("string")))
    queue = spark.range(n).select(F.col("id").alias("group"), code.alias("code"), F.col("id").alias("place"))
    rows = queue.orderBy("place").toPandas()
    got = deal.deal(queue).orderBy("group").toPandas()
    expected = plain(list(zip(rows["group"].tolist(), rows["code"].tolist())), 0.8, 0.1)
    assert len(got) == n and got["split"].tolist() == [expected[g] for g in got["group"].tolist()]


def test_deal_of_nothing_and_of_null_groups(spark):
    none = spark.createDataFrame([], "g string, c string, i int")
    assert split.stratified(none, "g", "c", "i").count() == 0
    some = spark.createDataFrame([(None, "a", 1), ("x", None, 2), ("x", "b", 3), (None, "b", 4)], "g string, c string, i int")
    got = split.stratified(some, "g", "c", "i").collect()
    assert len(got) == 4 and len({(r["g"], r["split"]) for r in got}) == 2


def test_stratified_plan_has_no_single_task(spark):
    df = spark.createDataFrame([(f"g{i}", f"c{i % 3}", i) for i in range(100)], "g string, c string, i int")
    assert "SinglePartition" not in split.stratified(df, "g", "c", "i")._jdf.queryExecution().toString()


def test_ranked_is_in_shuffled_order(spark):
    ids = list(range(500))
    got = {r["i"]: r["r"] for r in split.ranked(spark.createDataFrame([(i,) for i in ids], "i int"), F.col("i"), 3, "r").collect()}
    order = sorted(ids, key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_split_stratified_sql(spark):
    same(catalogue.queries()["split_stratified"](spark, SF), catalogue.oracle_sql()["split_stratified"], SF)
