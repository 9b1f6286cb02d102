"""Reports over tagged records and whole datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.messages import content_hash
from loam.operators.quality import bad_format, noise

def reason_histogram(tagged: DataFrame) -> DataFrame:
    """reason and count of the rows that go, the most frequent first."""
    return tagged.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def code_counts(tagged: DataFrame) -> DataFrame:
    """Per code: records, groups (articles) and what is kept of both."""
    groups = tagged.groupBy("code", "group_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("kept"))
    return groups.groupBy("code").agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("groups"), F.sum("kept").alias("kept_records"), F.count_if(F.col("kept") > 0).alias("kept_groups"))


def domains(rows: DataFrame, url: str) -> DataFrame:
    """Rows by the domain of a url, with their share; summed before the shuffle, the total as a one-row join."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    n = rows.groupBy(host.alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"))
    return n.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def units(nodes: DataFrame, column: str = "nodes") -> DataFrame:
    """The distinct units of content nodes and how often each occurs."""
    return nodes.select(F.explode(column).alias("x")).groupBy(F.coalesce("x.unit", F.lit("")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def size_counts(rows: DataFrame, tokens: Column, most: int) -> DataFrame:
    """One row: records, those of over `most` tokens, and their shares."""
    over = tokens > most
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("overlong"), F.count_if(~over).alias("fitting"))


def stage_report(tagged: DataFrame) -> DataFrame:
    """One row: counts after each stage, total removed and removal rate, from rows with their first reason (null: kept)."""
    r = F.col("reason")
    gone = lambda *names: F.count_if(r.isin(*names))
    early, clean, dup = ["empty_after_normalization"], ["empty_after_cleaning"], ["exact_duplicate", "near_duplicate"]
    counts = tagged.agg(
        F.count(F.lit(1)).alias("initial_count"),
        (F.count(F.lit(1)) - gone(*early)).alias("after_normalization"),
        (F.count(F.lit(1)) - gone(*early, *clean)).alias("after_cleaning"),
        F.count_if(r.isNull() | r.isin(*dup)).alias("after_filtering"),
        F.count_if(r.isNull()).alias("after_dedup"),
    )
    removed = F.col("initial_count") - F.col("after_dedup")
    return counts.withColumns({"total_removed": removed, "removal_rate": F.coalesce(F.try_divide(removed.cast("double"), F.col("initial_count")), F.lit(0.0))})


def health(df: DataFrame, dataset: Column) -> DataFrame:
    """Per dataset: rows, well-formed distinct ones, internal duplicates, bad and noisy rows. A distinct count is a sum over hashes, not a set in a task."""
    m = F.col("messages")
    rows = df.select(dataset.alias("dataset"), bad_format(m).alias("bad"), F.when(~bad_format(m), content_hash(m)).alias("h"), noise(m).alias("noisy"))
    by_hash = rows.groupBy("dataset", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if("noisy").alias("noisy"))
    out = by_hash.groupBy("dataset").agg(F.sum("n").alias("total_records"), F.count("h").alias("valid_records"), F.sum("bad").alias("bad_format"), F.sum("noisy").alias("noise_count"))
    return out.withColumn("internal_duplicates", F.col("total_records") - F.col("bad_format") - F.col("valid_records"))


def role_lengths(df: DataFrame) -> DataFrame:
    """Per role: shortest, longest, exact median (truncated) and number of contents."""
    rows = df.select(F.explode("messages").alias("m")).select("m.role", F.length(F.coalesce("m.content", F.lit(""))).alias("n")).filter(F.col("role").isin("user", "assistant", "system"))
    return rows.groupBy("role").agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.median("n").cast("int").alias("median_len"), F.count("n").alias("n"))


def issues(df: DataFrame, order: str, most: int = 10) -> DataFrame:
    """The first ill-formed rows."""
    return df.filter(bad_format(F.col("messages"))).orderBy(order).limit(most).select(order)


def leaked(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows (h) whose hash the reference (h) has; repeats count. Joined as sizes allow, skew split at run time."""
    return rows.join(reference.select("h").filter(F.col("h").isNotNull()).distinct(), "h", "left_semi")


def length_stats(df: DataFrame) -> DataFrame:
    """Over the last message of each row that has any: mean (rounded half to even), shortest, longest, count."""
    n = F.length(F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit("")))
    return df.filter(~bad_format(F.col("messages"))).agg(F.bround(F.avg(n), 0).alias("avg_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.count(F.lit(1)).alias("n"))
