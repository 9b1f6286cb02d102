"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix (DataFrame functions only)."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import CHUNK_ROWS, row_place, save, scratch_path, table

#: Partitions of the matrix, at most: beyond, a partition holds more than CHUNK_ROWS rows.
PARTITIONS = 8_192
#: Outcomes less likely than this share of the likeliest are left out of a draw: together under 1e-15 of its mass.
NEGLIGIBLE = 1e-22


def outcomes(good: int, bad: int, drawn: int) -> tuple[int, list[float]]:
    """The least outcome, and the probabilities of it and those after it, of the number of good items among drawn ones, taken without return.

    Weights come from the mode outwards by exact ratios of neighbours and are divided by their sum, so no logarithm of
    a large factorial is rounded: the mass is 1 at any size.
    """
    least, most = max(0, drawn - bad), min(good, drawn)
    mode = min(most, max(least, (drawn + 1) * (good + 1) // (good + bad + 2)))
    up, x = [1.0], mode
    while x < most and up[-1] > NEGLIGIBLE:
        up.append(up[-1] * ((good - x) / (x + 1)) * ((drawn - x) / (bad - drawn + x + 1)))
        x += 1
    down, x = [], mode
    w = 1.0
    while x > least and w > NEGLIGIBLE:
        w *= (x / (good - x + 1)) * ((bad - drawn + x) / (drawn - x + 1))
        down.append(w)
        x -= 1
    weights = [*reversed(down), *up]
    total = sum(sorted(weights))
    return x, [w / total for w in weights]


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """One draw of how many of drawn items, taken without return from good + bad, are good: inversion from the mode outwards."""
    if max(0, drawn - bad) == min(good, drawn):
        return min(good, drawn)
    least, p = outcomes(good, bad, drawn)
    u = rng.random()
    low = high = max(range(len(p)), key=p.__getitem__)
    u -= p[low]
    while u > 0 and (low > 0 or high < len(p) - 1):
        if high < len(p) - 1:
            high += 1
            u -= p[high]
            if u <= 0:
                return least + high
        if low > 0:
            low -= 1
            u -= p[low]
            if u <= 0:
                return least + low
    return least + max(range(len(p)), key=p.__getitem__) if low == 0 and high == len(p) - 1 else least + high


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts from partition to shard with exactly these margins, distributed as under a uniform permutation of all rows."""
    rng, left, out = random.Random(seed), list(shards), []
    for n in rows:
        line, open_ = [], sum(left)
        for j, size in enumerate(left):
            take = hypergeometric(rng, size, open_ - size, n) if n else 0
            line.append(take)
            n, open_ = n - take, open_ - size
            left[j] -= take
        out.append(line)
    return out


def as_table(spark: SparkSession, rows: list[dict], schema: str, name: str) -> DataFrame:
    """Rows of the driver as JSON lines in the shared folder, read back as a table; they are not in any plan."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, f"{name}.json"))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for i in range(0, len(rows), 1000):
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows[i : i + 1000]).encode()))
    finally:
        out.close()
    return spark.read.schema(schema).json(path.toString())


def shard_rows(df: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """Give each row a shard (int) and a slot in it (long, gapless from 0); shard sizes differ by one row at most.

    The rows are written once, so (file, row) names each row, repeated and all-null rows included, on
    any retry. Chunks of CHUNK_ROWS rows of a file are dealt to partitions by hash, as many as there are chunks but
    PARTITIONS at most. The driver gets one count for each partition and draws the matrix, which becomes a table;
    each partition is permuted by a hash of the place and cut at the matrix' counts; after the exchange each shard
    is permuted again by another hash, in ranges of about CHUNK_ROWS rows, so that no task holds a shard. Pass the
    columns that must travel only: ids and digests, not texts. An empty df gives no rows. Columns that are named shard
    or slot are replaced, any other name is kept.
    """
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    inner = [f"c{i}" for i in range(len(names))]
    source = save(df.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner))) if names else df.select(F.lit(0).alias("none")), "rows")
    file, row = row_place()
    rows = source.withColumns({"_file": file, "_row": row}).withColumn("_chunk", F.floor(F.col("_row") / CHUNK_ROWS))
    chunks = rows.select("_file", "_chunk").distinct().count() if rows.take(1) else 1
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), "_file", "_chunk"), F.lit(min(chunks, PARTITIONS))))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # PARTITIONS rows at most
    total = sum(n for _, n in counts)
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    cuts = as_table(spark, [{"_part": p, "_cut": [sum(line[: j + 1]) for j in range(n_shards)]} for (p, _), line in zip(counts, matrix)], "_part long, _cut array<long>", "matrix")

    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_file", "_row"), "_file", "_row"))
    ranges = max(1, -(-total // (n_shards * CHUNK_ROWS)))
    sent = rows.withColumn("_place", place).join(cuts, "_part").withColumn("_shard", F.size(F.filter("_cut", lambda c: c < F.col("_place"))).cast("int"))
    again = F.xxhash64(F.lit(seed + 1), "_file", "_row")
    sent = sent.withColumn("_key", again).withColumn("_range", F.floor((F.shiftrightunsigned("_key", 33) * F.lit(ranges)) / F.lit(1 << 31)).cast("int"))
    sent = save(sent.select(*source.columns, "_shard", "_range", "_key", "_file", "_row"), "sent")
    before = sent.groupBy("_shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = save(before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n"), "before")
    slot = F.row_number().over(Window.partitionBy("_shard", "_range").orderBy("_key", "_file", "_row"))
    out = sent.withColumn("_in", slot).join(before, ["_shard", "_range"])
    return out.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), F.col("_shard").alias("shard"), (F.col("_in") - 1 + F.col("_before")).alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """Write whole rows of df, one folder a shard, in slot order. key is unique in df."""
    n = assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (df.join(assigned.select(key, "shard", "slot"), key).repartitionByRange(int(n), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))


def op7_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``. Null texts count as empty: size 1, crc 0."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
