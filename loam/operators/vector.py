"""Exact top-k search over a vector table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators import embedding, metric, snapshots
from loam.ship import ship

#: Vector components of a tile of rows or of queries, about.
COMPONENTS = 2_000_000
#: Tiles of rows up to which every query meets every tile; beyond it cells of rows are ruled out first.
DIRECT = 8


def build_index(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame] | str, path: str, keep: int = 2) -> None:
    """Embed chunks and publish them as the index's new version, in folders by legal_code; readers see the old version until then.

    embed adds a column embedding; or it is ``fitted``: an embedding is fitted on the chunks and stored with the version.
    """
    spark = chunks.sparkSession

    def write(folder: str) -> None:
        how = embed
        if embed == "fitted":
            model = embedding.fit(chunks)
            model.save(spark, f"{folder}/model")
            how = model.embed
        made = how(chunks)
        spark.createDataFrame([], made.schema).coalesce(1).write.parquet(f"{folder}/schema")  # for an empty index, and codes that look like numbers
        made.write.partitionBy("legal_code").parquet(f"{folder}/chunks")

    snapshots.publish(spark, path, write, keep)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index's current version; later versions don't change what it reads."""
    folder = snapshots.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.schema(spark.read.parquet(f"{folder}/schema").schema).parquet(f"{folder}/chunks")


def index_embedder(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame] | None:
    """The embedding that is stored with the index's current version, if there is one."""
    folder = snapshots.current(spark, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/model")
    if folder is None or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return embedding.load(spark, f"{folder}/model").embed


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(index: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query, in order, with rank and distance."""
    rows = index if where is None else index.filter(where)
    asked = F.array(*(F.lit(float(x)) for x in query))
    best = rows.withColumn("distance", cosine_distance(F.col(vector), asked)).orderBy("distance", id_).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_)))


def results(found: DataFrame) -> DataFrame:
    """What a search tells of each chunk, in order of rank."""
    similarity = (1 - F.col("distance")).alias("similarity")
    return found.select("rank", "distance", similarity, F.col("document").alias("text"), "article_title", "article_url", "legal_code").orderBy("rank")


def hashed_batch(texts: pa.Array, dim: int) -> pa.Array:
    """Vectors of hashed(), a text at a time into one matrix."""
    from zlib import crc32

    out, fine = np.zeros((len(texts), dim)), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        h = np.array([crc32(w.encode()) for w in (text.as_py() or "").lower().split()], np.int64)
        v = np.bincount(h % dim, np.where(h >> 31, 1.0, -1.0), dim)
        length = np.sqrt((v * v).sum())
        if length:
            out[i], fine[i] = v / length, True
    return embedding.lists(out, fine)


def hashed(df: DataFrame, dim: int = 256) -> DataFrame:
    """Adds embedding: signed counts of hashed words of document, scaled to length 1 (null without words). Stands in where no embedding model is at hand."""
    ship(df.sparkSession)
    vector = F.arrow_udf(lambda texts: hashed_batch(texts, dim), "array<double>", F.ArrowUDFType.SCALAR)
    return df.withColumn("embedding", vector("document"))


def knn(index: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding", direct: int = DIRECT, components: int = COMPONENTS) -> DataFrame:
    """For each query (query_id, vector) the k nearest rows of the whole index: query_id, id, rank, distance (ties: the lower id). Exact; query_ids and ids are unique.

    Rows that aren't of a query's dimension, or have null, non-finite or only zero components, are no neighbours, and
    queries of that kind have none. A small index (up to `direct` tiles of `components`) meets each query whole; a larger one is searched by
    metric.searched(), which sends a query only to cells that can hold a neighbour. Nothing but bounded samples and counts goes through the driver.
    """
    size = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.max(F.size(vector)), F.lit(1)), F.lit(1)).alias("dim")).first()
    q, x = size(queries), size(index)
    n_q, n_x = -(-q["n"] * q["dim"] // components) or 1, -(-x["n"] * x["dim"] // components) or 1
    if n_x > direct:
        found = metric.searched(index, queries, k, id_, vector, components)[0].withColumnRenamed("id", id_)
    else:
        found = all_tiles(index, queries, k, id_, vector, n_q, n_x)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), id_))
    return found.withColumn("rank", order).filter(F.col("rank") <= k)


def all_tiles(index: DataFrame, queries: DataFrame, k: int, id_: str, vector: str, n_q: int, n_x: int) -> DataFrame:
    """query_id, id, distance of the k best rows of each tile: queries and rows are dealt by hash, each pair of tiles is a task, and a tile is sent once for each tile of the other side."""
    kind = index.schema[id_].dataType.simpleString()
    # new names on both sides, which may come from one table
    tile = lambda own, n: F.pmod(F.xxhash64(own, vector), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(tile("query_id", n_q).alias("_q"), F.col("query_id").alias("_id"), F.col(vector).alias("_v")).withColumn("_x", every(n_x))
    rows = index.select(tile(id_, n_x).alias("_x"), F.col(id_).alias("_id"), F.col(vector).alias("_v")).withColumn("_q", every(n_q))

    def best(left, right):
        def by_dimension(pdf):
            out = {}
            if not len(pdf):  # the other side alone
                return out
            for dim, part in pdf.groupby(pdf["_v"].map(lambda v: -1 if v is None else len(v))):
                if dim > 0:
                    m = np.array([[np.nan if c is None else c for c in v] for v in part["_v"]], np.float64)
                    length = np.linalg.norm(m, axis=1)
                    fine = np.isfinite(length) & (length > 0)
                    out[dim] = part["_id"].to_numpy()[fine], m[fine] / length[fine][:, None]
            return out

        asked, rows, found = by_dimension(left), by_dimension(right), []
        for dim in asked.keys() & rows.keys():
            (qid, q), (xid, x) = asked[dim], rows[dim]
            names, place = np.unique(xid, return_inverse=True)
            for s in range(0, len(q), 256):
                d = 1 - q[s : s + 256] @ x.T
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero(d <= edge[:, None] + 1e-12)
                order = np.lexsort((place[j], d[i, j].round(12), i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(pd.DataFrame({"query_id": qid[s + i[keep]], id_: names[place[j[keep]]], "distance": d[i[keep], j[keep]]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], id_: [], "distance": []})

    return asked.groupBy("_q", "_x").cogroup(rows.groupBy("_q", "_x")).applyInPandas(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{id_}` {kind}, distance double")
