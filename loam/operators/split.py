"""Splits without leaks: whole groups go to one part. Orders come from md5 of a seed and a key, the same on any run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.deal import deal
from loam.operators.scratch import numbered, written


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def unit(key: Column, seed: int) -> Column:
    """A number from 0 to 1 for each key, the same on any run."""
    return F.conv(F.left(shuffled(key, seed), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError(f"ratios must sum to 1, not to {train + val + test}")


def ranked(df: DataFrame, key: Column, seed: int, out: str) -> DataFrame:
    """Rank from 1 in shuffled order, without a task that holds all rows."""
    rows = df.withColumns({"__loam_h": shuffled(key, seed), "__loam_k": key})
    return numbered(rows, ["__loam_h", "__loam_k"], out).withColumn(out, F.col(out) + 1).drop("__loam_h", "__loam_k")


def simple(df: DataFrame, group: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Column split: the first int(n * train) groups in shuffled order, then int(n * val), then the rest."""
    groups = df.select(group).distinct()
    n = groups.count()
    cut, cut2 = int(n * train), int(n * train) + int(n * val)
    part = ranked(groups, F.col(group), seed, "_r").select(group, F.when(F.col("_r") <= cut, "train").when(F.col("_r") <= cut2, "val").otherwise("test").alias("split"))
    return df.join(part, group)


def rows(df: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Column split: the first max(1, int(n * ratio)) rows in shuffled order are the test part."""
    cut = max(1, int(df.count() * ratio))
    return ranked(df, F.col(key), seed, "_r").withColumn("split", F.when(F.col("_r") <= cut, "test").otherwise("train")).drop("_r")


def tail(df: DataFrame, order: str, batch: int = 4, ratio: float = 0.05) -> DataFrame:
    """Column split: the last min(max(batch, int(n * ratio)), n - batch) rows by order validate. order names each row.

    Orders are dealt to ranges and counted; only the range in which the border lies is sorted for it.
    """
    n = df.count()
    size = min(max(batch, int(n * ratio)), n - batch)
    if size < 1:
        raise ValueError(f"{n} rows are too few for batches of {batch}")
    ranged = written(df.select(F.col(order).alias("_o")).repartitionByRange(F.desc("_o")).withColumn("_p", F.spark_partition_id()))
    before = 0
    for row in sorted(ranged.groupBy("_p").count().collect(), key=lambda r: r["_p"]):  # a row a range
        if before + row["count"] >= size:
            break
        before += row["count"]
    least = ranged.filter(F.col("_p") == row["_p"]).orderBy(F.desc("_o")).limit(size - before).agg(F.min("_o").alias("_least"))
    return df.join(F.broadcast(least)).withColumn("split", F.when(F.col(order) >= F.col("_least"), "valid").otherwise("train")).drop("_least")


def stratified(df: DataFrame, group: str, code: str, order: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Column split: whole groups, dealt in shuffled order so that each code keeps its shares.

    A group's code is that of its first row; null groups are one group, null codes one code. See deal.deal().
    """
    groups = df.groupBy(group).agg(F.min_by(code, order).alias("code"))
    queue = numbered(groups.select(F.col(group).alias("group"), "code", shuffled(F.col(group), seed).alias("_h")), ["_h", "group"], "place").drop("_h")
    dealt = deal(queue, train, val).select(F.col("group").alias("__loam_group"), "split")
    return df.join(dealt, df[group].eqNullSafe(dealt["__loam_group"])).drop("__loam_group")


def overlapping(df: DataFrame, group: str) -> DataFrame:
    """Groups in more than one part; must be none."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def manifest(df: DataFrame, group: str) -> DataFrame:
    """split and group of each group, one row a group: as many as there are groups, in no single row."""
    return df.select("split", F.col(group).cast("string").alias("group")).distinct()
