"""Embeddings fitted on a corpus: TF-IDF of hashed words, projected on its leading singular vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions.text import words
from loam.operators.scratch import drop, written
from loam.ship import ship

#: Buckets of hashed words, components of an embedding, directions beyond these that the search keeps, rounds of the search.
BUCKETS, DIM, MORE, ROUNDS = 8192, 64, 16, 6
#: Rows of a block, and words of its rows, at most (a row may have more).
ROWS, WORDS = 128, 1 << 16


def buckets_of(text: Column, n: int) -> Column:
    """The bucket of each word of a text, in lower case; null has none."""
    return F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def blocks(terms: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, lengths of rows and all their buckets, for stretches of ROWS rows at most that have about WORDS buckets (or are one row)."""
    n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = terms.flatten().to_numpy(zero_copy_only=False), np.cumsum(n)
    start = 0
    while start < len(n):
        before = ends[start] - n[start]
        stop = max(start + 1, min(start + ROWS, int(np.searchsorted(ends, before + WORDS, "right"))))
        yield start, n[start:stop], flat[before : ends[stop - 1]]
        start = stop


def lists(values: np.ndarray, fine: np.ndarray) -> pa.Array:
    """The rows of a matrix as arrays; null where they aren't fine."""
    offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1]))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()), mask=pa.array(~fine))


def sparse(n: np.ndarray, flat: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of TF-IDF rows of length 1, from their lengths and buckets: (1 + ln of the count) times the bucket's weight."""
    at = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(at * len(idf) + flat, return_counts=True)
    at, col = key // len(idf), key % len(idf)
    value = (1 + np.log(count)) * idf[col]
    length = np.sqrt(np.bincount(at, value * value, len(n)))
    return at, col, value / length[at]


def filled(terms: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and TF-IDF rows of each block, in one matrix that serves all blocks."""
    held = np.zeros((ROWS, len(idf)))
    for first, lengths, flat in blocks(terms):
        at, col, value = sparse(lengths, flat, idf)
        held[at, col] = value
        yield first, held[: len(lengths)]
        held[at, col] = 0


def squared_times(terms: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The transposed TF-IDF matrix times the matrix times right (buckets x columns), summed over blocks of rows: a task keeps one matrix of right's size."""
    n = right.shape[1]
    names = [f"z{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(right.shape), np.empty(right.shape)
        for batch in batches:
            for _, rows in filled(batch.column(0), idf):
                total += np.matmul(rows.T, rows @ right, out=part)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in total[some].T.copy()), pa.array(some.astype(np.int32))], names=[*names, "bucket"])

    sums = terms.select("terms").mapInArrow(run, ", ".join(f"{c} double" for c in names) + ", bucket int")
    got = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names)).toArrow().to_pandas()  # a row a bucket
    out = np.zeros(right.shape)
    out[got["bucket"].to_numpy(int)] = got[names].to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    """Weights of buckets and the directions (buckets x components) that texts are projected on, strongest first, with their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    def embed(self, df: DataFrame, text: str = "document") -> DataFrame:
        """Adds embedding: the projection of a text's TF-IDF, scaled to length 1; null without words, or where nothing is left of it."""
        ship(df.sparkSession)
        idf, directions = self.idf, self.directions

        @F.arrow_udf("array<double>")
        def project(terms: pa.Array) -> pa.Array:
            y = np.zeros((len(terms), directions.shape[1]))
            for first, rows in filled(terms, idf):
                y[first : first + len(rows)] = rows @ directions
            length = np.sqrt((y * y).sum(axis=1))
            fine = length > 1e-12
            return lists(np.divide(y, length[:, None], out=y, where=fine[:, None]), fine)

        return df.withColumn("embedding", project(buckets_of(F.col(text), len(idf))))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), [float(x) for x in d], [float(x) for x in self.values] if not i else None) for i, (w, d) in enumerate(zip(self.idf, self.directions))]
        spark.createDataFrame(rows, "bucket int, idf double, direction array<double>, singular array<double>").coalesce(1).write.parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # a row a bucket
    return Model(np.array([r["idf"] for r in rows]), np.array([r["direction"] for r in rows]), np.array(rows[0]["singular"]))


def fit(df: DataFrame, text: str = "document", dim: int = DIM, buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 0) -> Model:
    """A model of the texts of df, null and empty ones included as rows without words.

    Words are hashed to buckets, whose weights come from counts of texts over all rows. Random directions are multiplied by the
    matrix and its transpose in rounds, each a pass over blocks of rows, and made orthogonal on the driver, which holds
    buckets x (dim + MORE) numbers; a small eigenproblem then gives singular vectors and values. Their signs are set so that
    the largest entry is positive. Fewer words than components leave the rest of the directions zero.
    """
    spark = df.sparkSession
    ship(spark)
    terms = written(df.select(buckets_of(F.col(text), buckets).alias("terms")))
    n = terms.count()
    seen = {r["b"]: r["n"] for r in terms.select(F.explode(F.array_distinct("terms")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
    idf = np.log((1 + n) / (1 + np.array([seen.get(b, 0) for b in range(buckets)]))) + 1
    rng = np.random.default_rng(seed)
    used = np.array([b in seen for b in range(buckets)])
    q = np.linalg.qr(rng.normal(size=(buckets, min(dim + MORE, buckets))) * used[:, None])[0]
    for _ in range(rounds):
        q = np.linalg.qr(squared_times(terms, idf, q))[0]
    small = q.T @ squared_times(terms, idf, q)
    drop(terms)
    values, turns = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:dim]
    values = np.sqrt(np.maximum(values[best], 0))
    directions = q @ turns[:, best]
    directions[:, values <= 1e-9 * max(values.max(initial=0), 1e-300)] = 0
    peak = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[peak, np.arange(directions.shape[1])] < 0, -1, 1)
    return Model(idf, directions, values)
