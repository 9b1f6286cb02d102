"""Neighbours through cells around pivots, against every pair."""

import numpy as np
import pytest

from loam.operators import metric, vector
from loam.plans import catalogue
from tests.conftest import SF
from tests.helpers import same

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, queries, k):
    out = {}
    unit = lambda v: np.array(v, float) / np.abs(v).max()
    usable = [(i, unit(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, v in queries:
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            continue
        v = unit(v)
        d = [(round(1 - float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 12), j) for j, x in usable if len(x) == len(v)]
        out[i] = [j for _, j in sorted(d)[:k]]
    return {i: js for i, js in out.items() if js}


def found(spark, rows, queries, k=5, components=4000):
    rows, queries = ([(i, v and [c if c is None else float(c) for c in v]) for i, v in side] for side in (rows, queries))
    index = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in sorted(vector.knn(index, asked, k, direct=0, components=components).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def clustered(rng, n, dim, clusters, spread):
    centers = rng.normal(size=(clusters, dim))
    return [(i, (centers[i % clusters] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("spread", "k"), [(0.05, 5), (0.6, 1), (5.0, 7)])
def test_same_rows_as_every_pair(spark, spread, k):
    rng = np.random.default_rng(k)
    rows = clustered(rng, 1500, 12, 20, spread)
    queries = [(i, v) for i, v in rows[::25]] + [(9000 + i, rng.normal(size=12).tolist()) for i in range(20)]
    assert found(spark, rows, queries, k) == plain(rows, queries, k)


def test_odd_rows_ties_and_a_hot_cell(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0] * 6), (4, [None, 1.0, 0, 0, 0, 0]), (5, [nan] * 6), (6, [inf, 0, 0, 0, 0, 0]), (7, [1e300] * 6), (8, [1e-300] * 6), (9, [1.0, 2.0]), (10, [3.0])]
    hot = [(100 + i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(600)]
    rows = [*odd, *hot, *((1000 + i, v) for i, v in clustered(rng, 500, 6, 4, 0.3))]
    queries = [*odd, (20, [2.0, 2.0, 0, 0, 0, 0]), (21, [1.0, 0, 0, 0, 0, 0]), (22, [-1.0, -1.0, 0, 0, 0, 0]), (23, [5.0, 1.0]), (24, [1.0] * 4)]
    assert found(spark, rows, queries, 5, 600) == plain(rows, queries, 5)


def test_small_and_empty_sides(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert found(spark, rows, rows, 5, 2) == {1: [1, 2], 2: [2, 1]}
    assert found(spark, [], rows) == {} and found(spark, rows, []) == {}


def test_clusters_leave_most_pairs_out(spark):
    rng = np.random.default_rng(5)
    rows = clustered(rng, 6000, 16, 60, 0.1)
    index = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = spark.createDataFrame(rows[::20], SCHEMA).withColumnRenamed("vec_id", "query_id")
    near, pairs = metric.searched(index, asked, 5, "vec_id", "embedding", 16_000)
    assert near.count() >= 5 * 300
    assert metric.share_computed(pairs, 300, 6000) < 0.2


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_pruned", "vector_topk_filtered"])
def test_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


def test_small_components_make_few_large_bins(spark):
    """A query is sent once to each bin, and bins stay few however small a tile may be."""
    rows = clustered(np.random.default_rng(7), 1500, 12, 20, 5.0)
    index = spark.createDataFrame(rows, SCHEMA).repartition(3)
    asked = spark.createDataFrame(rows[::5], SCHEMA).withColumnRenamed("vec_id", "query_id")
    pairs = metric.searched(index, asked, 5, "vec_id", "embedding", 60)[1]
    assert pairs.filter("pairs > 0").count() <= 4 * metric.BINS
    assert found(spark, rows, rows[::25], 5, 60) == plain(rows, rows[::25], 5)
