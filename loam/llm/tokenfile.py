"""Token ids as Parquet list columns in document order, with reads of selected columns and ranges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import placed, save, scratch_path, table
from loam.llm.encoding import encoded

END = 0
#: Ids are dictionary-encoded (16-bit indices, one dictionary a row group), counts and starts as deltas (version 2 pages).
#: Row groups of 32 MB and pages of 64 KB: the page index leads a reader of one document to a few pages.
FORMAT = {
    "compression": "snappy",  # packed 16-bit indices hardly shrink under any codec
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 64 << 10,
    "parquet.page.row.count.limit": 2_000,
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": 1 << 20,
}
SCHEMA = "doc_id long, part int, local_start long, n_tokens int, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, partitions: int | None = None) -> None:
    """Encode docs (doc_id, text) and write their ids, each ending with END, to Parquet files in ascending doc_id order.

    Texts are range-partitioned by (doc_id, place of the row), so that even one doc_id with a third of all rows
    is split, equal rows too; each task then encodes its range and writes one file. If docs is a table of files,
    the place is the row's in its file, and the ranges are found without reading a text; else docs is
    written once to have places. Null texts are empty, null doc_ids come first, repeated rows stay. Other columns
    are left out, whatever their names. A row also holds its place: ``part`` (the file) and ``local_start`` (ids
    before it in the file).
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_row", "_file"]
    ranged = placed(docs, "doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for piece, ids, at in encoded(batches, vocabulary):
            lengths = np.diff(at) + 1
            ends = np.cumsum(lengths)
            flat = np.full(int(ends[-1]), END, np.int32)
            flat[np.delete(np.arange(len(flat)), ends - 1)] = ids
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            columns = [piece.column("doc_id"), pa.array(np.full(len(lengths), part, np.int32)), pa.array(before + ends - lengths), pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            before += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "local_start", "n_tokens", "tokens"])

    ranged.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "part", "local_start", "n_tokens", "tokens"), where: Column | None = None) -> DataFrame:
    """Selected columns of selected documents; without ``tokens`` the ids are not read, and ranges of doc_id skip row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part and the ids before its file, from the counts alone (one row a file)."""
    sums = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return save(sums.withColumn("before", before).drop("n"), "starts")


def crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        ids = tokens.flatten().to_numpy().astype("<u4")
        at = np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        view = memoryview(ids).cast("B")
        sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).mapInArrow(crc32, "doc_id long, part int, local_start long, n_tokens int, ids_crc32 long")
    return rows.join(starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op1_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files and read back. Null and empty texts are the end id alone; repeated rows are rows of their own, in a stable order; other columns are left out."""
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return digest(spark, path)
