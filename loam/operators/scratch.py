"""Tables written to the shared folder, for operators that run in rounds."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; a cluster, whose machines share no such folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="loam-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


def fresh_path(spark: SparkSession) -> str:
    """A new place in the shared folder, deleted at the end of the driver, unless dropped before."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(sweep)
    _tables[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """df from files that survive lost executors; its lineage ends there."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Rows with their number in order, from 0 without gaps; order should name each row, ties are numbered as they come (once, in a written table).

    Rows are sorted by ranges and written; the driver sums one count a file, and a row's place in its file does the rest.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    placed = rows.withColumns({"__loam_file": F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long"), "__loam_row": F.col("_metadata.row_index")})
    starts, total = [], 0
    for file, count in sorted(tuple(r) for r in placed.groupBy("__loam_file").count().collect()):
        starts.append((file, total))
        total += count
    before = spark.createDataFrame(starts, "__loam_file long, __loam_before long")
    return placed.join(F.broadcast(before), "__loam_file").withColumn(name, F.col("__loam_before") + F.col("__loam_row")).drop("__loam_file", "__loam_row", "__loam_before")


def drop(df: DataFrame) -> None:
    """Delete a written table that no plan reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        remove(df.sparkSession, path)
        _tables.pop(path, None)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def sweep() -> None:
    """Delete what is left, while there is a session to do it with."""
    for path, spark in _tables.items():
        with contextlib.suppress(Exception):
            remove(spark, path)
    _tables.clear()
