"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.scratch import drop, written
from loam.ship import ship

#: Edges that one task holds; a graph that has no more once tasks have thinned it is finished by one task.
HELD = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the edges a - b: each node that isn't the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def thinned(edges: DataFrame, held: int = HELD) -> DataFrame:
    """Edges (a, b: long) with the same components, of which each task keeps one a node at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in frames:
            a, b = np.append(a, frame["a"].to_numpy()), np.append(b, frame["b"].to_numpy())
            if len(a) > held:
                a, b = stars(a, b)
                if len(a) > held // 2:
                    yield pd.DataFrame({"a": a, "b": b})
                    a, b = a[:0], b[:0]
        a, b = stars(a, b)
        yield pd.DataFrame({"a": a, "b": b})

    return edges.select("a", "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """node and component (its least node) for each node of edges (a, b: long, not null). Loops and repeats don't matter.

    Tasks thin their own edges to stars. What is left of a graph of up to `held` edges goes to one task; a larger one is hung on least
    neighbours in rounds, each of which is a written table, until it is small enough or has become stars.
    """
    ship(edges.sparkSession)
    pairs = edges.filter("a <> b")
    now = written(thinned(pairs, held).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while (n := now.count()) > held:
        mark = (n, now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if mark == last:
            break
        last = mark
        # each node and its neighbours hang on the least of them: neighbours above it first, then those below
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        up = written(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = written(down.filter("a <> b").distinct())
        drop(now)
        drop(up)
        now = new
    found = now if n > held else written(thinned(now.coalesce(1), 4 * held + 4))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
