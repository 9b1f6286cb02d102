"""Benchmark decontamination by winnowing (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import let, placed, plain_words, save, table

#: Words of a window: each shared stretch of so many words is found.
WINDOW = 10
#: Words of a hashed k-gram. Of the k-grams of each window the least hash is kept, so a shared window shares a kept hash.
GRAM = 5
#: Rows of fingerprints or windows of the benchmark that are broadcast (24 bytes each); beyond it they are joined by a shuffle.
SMALL = 1_000_000


def fingerprints(words: Column, window: int, gram: int = GRAM) -> Column:
    """Array of (window, hash, start, run): from word start on, run windows in a row have this least k-gram hash. Empty where words are too few."""
    k = min(gram, window)
    w = window - k + 1
    none = F.array().cast("array<struct<window:int,hash:bigint,start:int,run:int>>")

    def grams() -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(g) - w + 1), lambda i: F.array_min(F.slice(g, i, w))) if w > 1 else g

    def first(m: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(m)), lambda i: (i == 1) | (F.get(m, i - 1) != F.get(m, i - 2)))

    def runs(m: Column) -> Column:
        return let(first(m), lambda at: F.transform(at, lambda s, j: F.struct(F.lit(window).alias("window"), F.get(m, s - 1).alias("hash"), s.alias("start"), (F.coalesce(F.get(at, j + 1), F.size(m) + 1) - s).alias("run"))))

    return F.when(F.size(words) >= window, let(grams(), lambda g: let(least(g), runs))).otherwise(none)


def window_key(words: Column, start: Column, window: Column | int) -> tuple[Column, Column]:
    """Two 64-bit hashes of the words of a window."""
    cut = F.slice(words, start, window)
    return F.xxhash64(cut).alias("h1"), F.xxhash64(F.lit(1), cut).alias("h2")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df of a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, small: int = SMALL, text: str = "text", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """What a benchmark's windows hit in docs: (rows, groups).

    rows has all rows of docs (any columns, repeated and null ones too) with _n_words, _spans (array of (start, end) of windows
    that occur in the benchmark, words from 0, end outside, in order, one for each window) and _groups (the distinct sets of items that these windows
    come from, as hashes, in order). groups has a row for each set: _group and _items (item ids as strings, distinct, in order).
    A window is as many words in a row of an item, or all words of a shorter item. Null texts have no words; items without words
    have no window; items without an id hit words but are in no set; an empty benchmark hits nothing. Columns named like the new ones are replaced.

    1. Each text is winnowed: of the k-grams of each window the least hash is kept, once for windows in a row. Kept hashes are met with those of the benchmark (distinct,
       broadcast up to a counted size), and only those that meet leave the scan. A window that occurs in both is among what meets.
    2. Texts with hits alone are read again; the windows of each hit are compared by 128 bits of hashes, and windows
       that occur extend to spans.
    A frequent window is one row of the benchmark's side; texts with equal sets of groups share the work on items. Short
    items take a winnowing each for their lengths (window - 1 at most, and those that occur only).
    """
    spark = docs.sparkSession
    docs = docs.drop("_n_words", "_spans", "_groups", "_file", "_row")
    cut = benchmark.select(F.col(item).cast("string").alias("_item"), plain_words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    items = save(cut.withColumn("window", F.least(F.size("words"), F.lit(window))), "items")
    widths = sorted(r["window"] for r in items.select("window").distinct().collect())  # window rows at most
    prints = [fingerprints(F.col("words"), n, gram) for n in widths]
    chosen = F.lit(None).cast("array<struct<window:int,hash:bigint,start:int,run:int>>")
    for n, p in zip(widths, prints):
        chosen = F.when(F.col("window") == n, p).otherwise(chosen)
    keys = save(items.select(F.explode(chosen).alias("p")).select("p.window", "p.hash").distinct(), "fingerprints")
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("window") + 1))
    windows = items.select("_item", "words", "window", at.alias("start")).select("window", *window_key(F.col("words"), F.col("start"), F.col("window")), "_item").distinct()
    owned = windows.groupBy("window", "h1", "h2").agg(F.array_sort(F.collect_set("_item")).alias("_items"))
    owned = save(owned.withColumn("_group", F.xxhash64("_items")), "windows")
    groups = save(owned.select("_group", "_items").groupBy("_group").agg(F.first("_items").alias("_items")), "groups")

    # every row has a mark of its own that always stays: its count of words
    source = placed(docs, *docs.columns)
    mark = lambda n: F.struct(F.lit(0).alias("window"), F.xxhash64("_file", "_row").alias("hash"), n.alias("start"), F.lit(0).alias("run"))
    found = let(plain_words(F.col(text)), lambda w: F.concat(F.array(mark(F.size(w))), *(fingerprints(w, n, gram) for n in widths)))
    sent = source.select("_file", "_row", F.explode(found).alias("p")).select("_file", "_row", "p.*")
    met = sent.join(bounded(keys.withColumn("_met", F.lit(True)), small), ["window", "hash"], "left").filter("window = 0 or _met")
    per_row = met.groupBy("_file", "_row").agg(F.max(F.when(F.col("window") == 0, F.col("start"))).alias("_n_words"), F.collect_list(F.when(F.col("window") > 0, F.struct("window", "start", "run"))).alias("_hits"))
    per_row = save(per_row, "hits")

    # windows of the hits, compared whole
    hit = per_row.filter(F.size("_hits") > 0).select("_file", "_row", "_hits")
    texts = source.select("_file", "_row", F.col(text).alias("text")).join(bounded(hit, small // 10), ["_file", "_row"])
    starts = F.flatten(F.transform("_hits", lambda h: F.transform(F.sequence(h["start"], h["start"] + h["run"] - 1), lambda s: F.struct(h["window"].alias("window"), s.alias("start")))))
    tried = texts.select("_file", "_row", plain_words(F.col("text")).alias("words"), starts.alias("at"))
    tried = tried.select("_file", "_row", F.explode(let(F.col("words"), lambda w: F.transform("at", lambda a: F.struct(a["window"].alias("window"), a["start"].alias("start"), *window_key(w, a["start"], a["window"]))))).alias("w")).select("_file", "_row", "w.*")
    same = tried.join(bounded(owned.select("window", "h1", "h2", "_group"), small), ["window", "h1", "h2"])
    spans = F.array_sort(F.collect_set(F.struct((F.col("start") - 1).alias("start"), (F.col("start") + F.col("window") - 1).alias("end"))))
    spans = save(same.groupBy("_file", "_row").agg(spans.alias("_spans"), F.array_sort(F.collect_set("_group")).alias("_groups")), "spans")
    rows = source.join(per_row.select("_file", "_row", "_n_words"), ["_file", "_row"]).join(spans, ["_file", "_row"], "left").drop("_file", "_row")
    return rows.withColumns({"_spans": F.coalesce("_spans", F.array()), "_groups": F.coalesce("_groups", F.array())}), groups


def covered(spans: Column) -> Column:
    """Words in spans (in order of their starts)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], **how: object) -> DataFrame:
    """The columns keep of each row of docs with n_words, n_hit, items (ids as strings, distinct, in order) and contaminated. Rows and items as in hits(); keep may not name the new columns.

    Items of a set of groups are gathered once a distinct set, so that thousands of copies are one.
    """
    rows, groups = hits(docs, benchmark, **how)
    rows = save(rows.select(*keep, "_n_words", "_groups", covered(F.col("_spans")).alias("_n_hit")).withColumn("_set", F.xxhash64("_groups")), "rows")
    sets = rows.filter(F.size("_groups") > 0).select("_set", "_groups").groupBy("_set").agg(F.first("_groups").alias("_groups"))
    pairs = sets.select("_set", F.explode("_groups").alias("_group")).join(groups, "_group").select("_set", F.explode("_items").alias("_item")).distinct()
    items = save(pairs.groupBy("_set").agg(F.array_sort(F.collect_list("_item")).alias("items")), "set_items")
    out = rows.join(items, "_set", "left")
    return out.select(*keep, F.col("_n_words").cast("long").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("_n_hit") > 0).alias("contaminated"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in windows of ten words of the benchmark, and a digest of the items; null texts have no words."""
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id"])
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


def oracle() -> str:
    """The same for DuckDB: every window of every document, compared as text."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    items AS (SELECT item_id, {words} AS w FROM benchmark),
    grams AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS m, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM items WHERE len(w) > 0)),
    tried AS (SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS g
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM docs, (SELECT DISTINCT m FROM grams) WHERE len(w) >= m)),
    met AS (SELECT r, t.m, s, item_id FROM tried t JOIN grams USING (m, g)),
    covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT r, m, s FROM met)) GROUP BY r),
    named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM met WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
