"""What the operators of this subpackage share: scratch tables, Arrow helpers, exact ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loam.ship import ship as ship_code

#: Rows of one chunk of a scratch table; a window over one chunk never holds more.
CHUNK_ROWS = 65_536
#: Bytes of text that a Python worker handles at once (one longer text is handled alone).
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch, where the session has Spark's default of 10,000: a batch of documents is held several times at once, by the executor and its workers.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and batches small; every operator's queries call it first."""
    ship_code(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master (tests) gets a temporary one; a cluster, whose machines share no such folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = getattr(shared_dir, "made", None)
        if made is None:
            made = shared_dir.made = tempfile.mkdtemp(prefix="loam-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
        found = f"file://{made}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Scratch tables that are still there.
_tables: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted at the end of the driver, unless dropped before."""
    path = f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}/{name}"
    if not _tables:
        atexit.register(sweep)
    _tables[path] = spark
    return path


def save(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage with files that outlive executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loam_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that later plans no longer read."""
    for df in tables:
        path = getattr(df, "loam_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables.pop(path, None)


def tables() -> set[str]:
    return set(_tables)


def sweep(keep: set[str] = frozenset()) -> None:
    """Delete all scratch tables but some; at the end of the driver, as long as there is a session to do it with."""
    for path, spark in list(_tables.items()):
        if path not in keep:
            with contextlib.suppress(Exception):
                remove(spark, path)
            _tables.pop(path, None)


def tidy() -> None:
    """Give memory that is free in this worker back to the system; idle workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has at most so many bytes of the column, or one row. Pieces are copies: some string kernels misread the offset of a slice."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        at = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        start = 0
        while start < len(values):
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.take(pa.array(np.arange(start, end)))
            start = end
        tidy()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all items of runs that begin at starts and have lengths."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def row_place() -> tuple[Column, Column]:
    """Number of the file and of the row in it, for a table that save() has written: a stable name for each row, repeated rows included."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"), F.col("_metadata.row_index")


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """columns of df with _file (a hash of its path) and _row, which name each row on any retry: its place in the files that df is read from; else df is written once to have places."""
    named = lambda rows: rows.select(*columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    try:
        return named(df)
    except AnalysisException:
        return named(save(df.select(*columns), "placed"))


def exact_ranks(saved: DataFrame, key: list[str], rank: str = "rank", order: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in the order of files and, within chunks, of order (else of rows).

    saved comes from save(). No task holds all rows of a key: rows are ranked within chunks of
    CHUNK_ROWS rows of a file, and the counts of earlier chunks are added. Null keys are one key.
    """
    spark = saved.sparkSession
    file, row = row_place()
    rows = saved.withColumns({"_file": file, "_row": row}).withColumn("_chunk", F.col("_file") * F.lit(1 << 32) + F.floor(F.col("_row") / CHUNK_ROWS))
    names = [f"_k{i}" for i in range(len(key))]
    rows = rows.withColumns({n: F.coalesce(F.to_json(F.array(F.col(k))), F.lit("")) for n, k in zip(names, key)} if key else {})
    counts = rows.groupBy(*names, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    counts = save(counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(names or [F.lit(0)])).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))), "counts")
    within = F.row_number().over(Window.partitionBy(*names, "_chunk").orderBy(*([order] if order is not None else []), "_row"))
    return (
        rows.withColumn("_in", within)
        .join(counts.select(*names, "_chunk", "_before"), [*names, "_chunk"])
        .withColumn(rank, F.col("_in") - 1 + F.coalesce("_before", F.lit(0)))
        .drop(*names, "_chunk", "_before", "_in", "_file", "_row")
    )


def with_columns(df: DataFrame, column: str, added: str, work: Callable[[pa.Array], list[pa.Array]], keep: list[str]) -> DataFrame:
    """The columns keep of df and those that work makes from pieces of a text column; one map, no shuffle.

    added is DDL. A kept column that has the name of a new one is left out. Rows keep their order.
    """
    new = StructType.fromDDL(added)
    keep = [c for c in dict.fromkeys(keep) if c not in new.names]
    schema = StructType([*(df.schema[c] for c in keep), *new.fields])
    column_ = "_text" if column not in keep else column
    source = df.select(*keep, *([F.col(column).alias(column_)] if column_ not in keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column_):
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *work(piece.column(column_))], names=[*keep, *new.names])

    return source.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row: a lambda that names a long expression would evaluate it for each of its items."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def plain_words(text: Column) -> Column:
    """The stretches of a-z, 0-9 and characters beyond ASCII of a text, A-Z lower-cased; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, mod n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Groups that lowest() looks at, the largest ones: with its bound of rows a group this bounds what the driver gets.
GROUPS = 256


def lowest(df: DataFrame, group: Column | None, most: int, order: Column, columns: list[str], groups: int = GROUPS) -> list[Row]:
    """Of each of the largest groups (`groups` at most; null ones are left out) the rows with the lowest values of a hash (order), at most `most`: a bounded sample for the driver.

    Rows of equal hash, which repeat each other, count once. The distinct hashes of a group are estimated first; then only
    rows under the group's threshold leave the scan, equal ones become one before they leave the executors, and the bound is cut here. Groups of equal
    size are taken in the order of their names.
    """
    at = (group if group is not None else F.lit("all")).cast("string").alias("_group")
    unit = ((order.bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))).alias("_unit")
    sizes = df.select(at, unit).filter(F.col("_group").isNotNull()).groupBy("_group").agg(F.approx_count_distinct("_unit", 0.02).alias("n"))
    n = {r["_group"]: r["n"] for r in sizes.orderBy(F.desc("n"), "_group").limit(groups).collect()}
    if not n:
        return []
    share = df.sparkSession.createDataFrame([(g, min(1.0, 1.1 * (most + 4 * most**0.5) / max(c, 1))) for g, c in n.items()], "_group string, _share double")
    some = df.select(*columns, at, unit).join(F.broadcast(share), "_group").filter(F.col("_unit") <= F.col("_share"))
    few = some.groupBy("_group", "_unit").agg(F.min(F.struct(*columns)).alias("_row"))
    rows = few.select("_group", "_unit", "_row.*").collect()
    rows.sort(key=lambda r: (r["_group"], r["_unit"]))
    out, seen = [], {}
    for r in rows:
        seen[r["_group"]] = seen.get(r["_group"], 0) + 1
        if seen[r["_group"]] <= most:
            out.append(r)
    return out
