"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import drop, save

#: Edges that a task holds at once while it thins its own.
HELD = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) of the graph of the edges a-b, by minimum labels and pointer jumps."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def thin(edges: DataFrame) -> DataFrame:
    """Replace the edges of each task by a forest of stars with the same components; at most one edge for each node and HELD edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def out() -> tuple[np.ndarray, np.ndarray]:
            x, y = forest(np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))
            a[:], b[:] = [x], [y]
            return x, y

        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            if sum(map(len, a)) > HELD:
                x, y = out()
                if len(x) > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                    a.clear(), b.clear()
        if a:
            x, y = out()
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for each node of edges (a, b: long, not null); loops and repeats don't matter.

    Alternating large and small stars (Kiveris and others, 2014): each round hangs nodes on smaller
    neighbours, and about log² n rounds reach stars. A node's least neighbour is a map-side minimum, joined back to
    the edges as an ordinary (skew-split) join, so that no task holds a node's neighbours. Each round is
    a written table.
    """
    now = save(thin(edges.filter("a <> b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = mark
        # large star: to each larger neighbour of u, the least of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = save(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        # small star: to each smaller neighbour of u and to u, the least of them
        least2 = save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least2.select("a", F.col("m").alias("b")))
        new = save(small.filter("a <> b").distinct(), "edges")
        for old in (now, least, large, least2):
            drop(old)
        now = new
