"""Writing datasets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.split import manifest


#: Groups of a manifest that is one row, at most.
GROUPS = 100_000


def jsonl(df: DataFrame, path: str) -> bool:
    """``{"messages": ...}`` a line; nothing is written for no rows. Tells whether it wrote."""
    if not df.take(1):
        return False
    df.select("messages").write.mode("overwrite").json(path)
    return True


def split_manifest(df: DataFrame, group: str, seed: int, path: str) -> None:
    """Up to GROUPS groups: one JSON row with the seed and each part's sorted groups. More: a sorted row for each group, in folders by split."""
    rows = manifest(df, group)
    if rows.count() > GROUPS:
        rows.withColumn("seed", F.lit(seed)).repartitionByRange("split", "group").sortWithinPartitions("split", "group").write.mode("overwrite").partitionBy("split").json(path)
        return
    m = rows.groupBy("split").agg(F.sort_array(F.collect_list("group")).alias("groups")).agg(F.map_from_entries(F.collect_list(F.struct("split", "groups"))).alias("m"))
    names = ("train", "val", "test")
    m.select(F.lit(seed).alias("seed"), *(F.coalesce(F.col("m")[n], F.array().cast("array<string>")).alias(f"{n}_groups") for n in names)).write.mode("overwrite").json(path)


def code_report(counts: DataFrame, path: str) -> None:
    """A JSON row for each code, by code."""
    counts.orderBy("code").coalesce(1).write.mode("overwrite").json(path)  # few rows


def report(stages: DataFrame, reasons: DataFrame, path: str) -> None:
    """One JSON row: the stage counts with the removal reasons as a map."""
    by_count = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reason", "n")))  # one entry a reason
    told = reasons.agg(F.map_from_entries(F.transform(by_count, lambda x: F.struct(x["reason"], x["n"]))).alias("removed_reasons"))
    stages.crossJoin(told).write.mode("overwrite").json(path)


def health_report(health: DataFrame, path: str) -> None:
    """``{"datasets": {name: counts}}``."""
    rest = [c for c in health.columns if c != "dataset"]
    health.agg(F.map_from_entries(F.collect_list(F.struct("dataset", F.struct(*rest)))).alias("datasets")).write.mode("overwrite").json(path)


def rows_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
