"""Bag unions of datasets, and caps of records a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a key's rows are ranked in before the parts meet.
PARTS = 64


def union(datasets: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """All rows of all datasets with the name of theirs; columns that one lacks are null. Repeated rows stay."""
    out = None
    for key, df in datasets.items():
        part = df.withColumn(name, F.lit(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset")
    return out


def routed(df: DataFrame, conditions: dict[str, Column], work: Callable[[DataFrame], DataFrame] | None = None, name: str = "dataset") -> DataFrame:
    """One scan for datasets that are parts of one table: a row for each condition that a row fulfils, null ones don't hold."""
    names = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())), lambda x: x.isNotNull())
    rows = df.withColumn(name, F.explode(names))
    return work(rows) if work else rows


def cap(df: DataFrame, by: str, order: list[Column | str], most: int, rank: str = "rank") -> DataFrame:
    """The first `most` rows of each key in order, with their rank from 1. order should name each row; null keys are one key.

    A key's rows are ranked in PARTS parts first, of which `most` each go on, so that no task holds a key with very many rows.
    """
    parts = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    some = df.withColumn("__loam_part", parts).withColumn(rank, F.row_number().over(Window.partitionBy(by, "__loam_part").orderBy(*order))).filter(F.col(rank) <= most)
    return some.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= most).drop("__loam_part")
