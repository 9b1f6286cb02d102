"""Exact, keyed and near deduplication. Order columns decide which row is first."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import word_set
from loam.operators.components import components
from loam.operators.scratch import written


def exact(df: DataFrame, value: Column, order: str, among: Column | None = None) -> DataFrame:
    """Column is_dup: an earlier row has the same value (nulls are equal). A map-side minimum finds each value's first row; no window holds a value's rows.

    order should name each row: rows that share a value's least order are all first. among: only rows where it
    is true take part, the others are no duplicates.
    """
    keyed = df.withColumn("__loam_h", F.md5(F.coalesce(F.concat(F.lit("="), value), F.lit("null")).cast("binary")))
    if among is not None:
        keyed = keyed.withColumn("__loam_h", F.when(among, F.col("__loam_h")))
    first = keyed.filter(F.col("__loam_h").isNotNull()).groupBy("__loam_h").agg(F.min(order).alias("__loam_first"))
    dup = F.coalesce(F.col(order) > F.col("__loam_first"), F.lit(False))
    return keyed.join(first, "__loam_h", "inner" if among is None else "left").select(*df.columns, dup.alias("is_dup"))


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*key, "_x.*").select(*df.columns)


def longest(df: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """The row with the longest text of each key (ties: the first; null is shorter than empty), with the order of the key's first row. order may be of any type that sorts."""
    rest = [c for c in df.columns if c not in key]
    got = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-F.coalesce(F.length(text), F.lit(-1)), F.col(order))).alias("_x"), F.min(order).alias("first_seen"))
    return got.select(*key, "_x.*", "first_seen").select(*df.columns, "first_seen")


#: Candidate pairs for each word of a prefix up to which all are compared at once; beyond it sets that are first wherever they stand are settled before.
CROWDED = 8
#: Times that this is done.
PASSES = 3
#: Pairs of a component that one task decides; larger ones are decided in rounds.
TASK = 1_000_000


def word_sets(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Distinct word sets (k: a digest of the words, lead: the least order of their rows, w), written. Rows without words are in no set."""
    rows = df.select(F.col(order).alias("o"), words_of(key).alias("w")).filter(F.size("w") > 0).withColumn("k", digest(F.col("w")))
    return written(rows.groupBy("k").agg(F.min("o").alias("lead"), F.first("w").alias("w")))


def prefixes(sets: DataFrame, above: tuple[int, int]) -> DataFrame:
    """k, lead, n, pos and t: the rarest words of each set, of which two sets that are near share one; n - (floor(19 n / 20) + 1) + 1 words. Written."""
    num, den = above
    counts = sets.select(F.explode("w").alias("t")).groupBy("t").count()
    tokens = sets.select("k", "lead", F.size("w").alias("n"), F.explode("w").alias("t")).filter(F.col("n") >= den).join(counts, "t")
    ranked = tokens.groupBy("k", "lead", "n").agg(F.array_sort(F.collect_list(F.struct("count", "t"))).alias("p"))
    return written(ranked.select("k", "lead", "n", F.posexplode(F.slice("p", F.lit(1), F.col("n") - F.floor(F.col("n") * num / den).cast("int"))).alias("pos", "x")).select("k", "lead", "n", "pos", F.xxhash64("x.t").alias("t")))


def verified(met: DataFrame, sets: DataFrame, above: tuple[int, int]) -> DataFrame:
    """Pairs (ka, kb) with a, b (leads) and similarity, if they are near."""
    num, den = above
    side = lambda x: sets.select(F.col("k").alias(f"k{x}"), F.col("lead").alias(x), F.col("w").alias(f"w{x}"))
    full = met.join(side("a"), "ka").join(side("b"), "kb")
    both = F.size(F.array_intersect("wa", "wb"))
    hit = full.filter(den * both > num * (F.size("wa") + F.size("wb") - both))
    return hit.select("ka", "kb", "a", "b", (both.cast("double") / (F.size("wa") + F.size("wb") - both)).alias("similarity"))


def sizes_fit(a: Column, b: Column, above: tuple[int, int]) -> Column:
    return above[1] * F.least(a, b) > above[0] * F.greatest(a, b)


def pairs_of(short: DataFrame, sets: DataFrame, above: tuple[int, int]) -> DataFrame:
    """All near pairs of sets by their prefixes, the earlier one first. Digests, not words, are grouped and joined."""
    num, den = above
    a, b = short.alias("a"), short.alias("b")
    earlier = F.struct("a.lead", "a.k") < F.struct("b.lead", "b.k")
    # words after both places can still be shared: with too few of them the pair can't reach the share
    rest = 1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) - 1 + F.least("a.pos", "b.pos")
    enough = (den + num) * rest > num * (F.col("a.n") + F.col("b.n"))
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & earlier & sizes_fit(F.col("a.n"), F.col("b.n"), above) & enough)
    return verified(met.select(F.col("a.k").alias("ka"), F.col("b.k").alias("kb")).distinct(), sets, above)


def near_sets(df: DataFrame, key: Column, order: str, above: tuple[int, int] = (19, 20)) -> tuple[DataFrame, DataFrame]:
    """Distinct word sets and all pairs (ka, kb, a, b, similarity; lead a before lead b) with Jaccard above 19/20, by an exact prefix filter."""
    sets = word_sets(df, key, order)
    return sets, pairs_of(prefixes(sets, above), sets, above)


def crowded(short: DataFrame) -> bool:
    """Whether sets share words of prefixes so often that comparing all pairs would cost far more than reading them."""
    met = short.groupBy("t").count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"), F.sum("count").alias("n")).first()
    return bool(met["n"]) and met["pairs"] > CROWDED * met["n"]


def settled(short: DataFrame, sets: DataFrame, above: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Sets (k) that stay as no set before them shares a word of their prefix, and sets (v) that are near one of those, so that they go.

    Each word has one first set, and only such are compared with the word's other sets: as many pairs as prefixes have words,
    however many near copies there are.
    """
    first = short.groupBy("t").agg(F.min(F.struct("lead", "k")).alias("h"), F.count(F.lit(1)).alias("c"))
    known = short.join(first, "t")
    heads = written(known.groupBy("k").agg(F.bool_and(F.col("h.k") == F.col("k")).alias("free")).filter("free").select("k"))
    mine = known.filter("c > 1").select(F.col("h.k").alias("ka"), F.col("k").alias("kb"), F.col("n").alias("nb")).filter("ka <> kb").distinct()
    mine = mine.join(heads.select(F.col("k").alias("ka")), "ka").join(sets.select(F.col("k").alias("ka"), F.size("w").alias("na")), "ka").filter(sizes_fit(F.col("na"), F.col("nb"), above))
    return heads, written(verified(mine.select("ka", "kb"), sets, above).select(F.col("kb").alias("v")).distinct())


def words_of(key: Column) -> Column:
    return F.coalesce(F.array_sort(word_set(key)), F.array().cast("array<string>"))


def digest(words: Column) -> Column:
    """Of a set of words, which hold no white space."""
    return F.md5(F.array_join(words, " ").cast("binary"))


def near_pairs(df: DataFrame, key: Column, order: str, above: tuple[int, int] = (19, 20)) -> DataFrame:
    """Pairs (a, b: least orders of distinct word sets, a < b) with Jaccard above 19/20, and their similarity."""
    return near_sets(df, key, order, above)[1].select("a", "b", "similarity")


def near(df: DataFrame, key: Column, order: str, among: Column | None = None) -> DataFrame:
    """Column is_dup: the row has an earlier kept row with Jaccard above 0.95, or the same words as any earlier row.

    Greedy in order: a row stays unless an earlier kept one is near. Null and blank keys have no words and are
    near to nothing, so such rows stay. Every row comes back once; rows that share the least order of a word set
    all count as its first. among: only rows where it is true take part, the others are no duplicates.

    Where many sets crowd around the same words, sets that are the first of all their words are settled before, with those near to them, a few times. Of what is left all
    near pairs are found; each of their connected components is decided by one task, in order, up to TASK pairs, however long its chains
    are. Larger ones are decided in rounds.
    """
    above = (19, 20)
    sets = word_sets(df if among is None else df.filter(among), key, order)
    short, settled_gone = prefixes(sets, above), []
    for _ in range(PASSES):
        if not crowded(short):
            break
        heads, gone = settled(short, sets, above)
        settled_gone.append(gone)
        short = written(short.join(heads, "k", "left_anti").join(gone, short["k"] == gone["v"], "left_anti"))
    gone = decided(written(pairs_of(short, sets, above).select("ka", "kb", "a", "b")))
    for more in settled_gone:
        gone = gone.unionByName(more)
    known = sets.join(gone.withColumn("__loam_gone", F.lit(True)), sets["k"] == gone["v"], "left").select(F.col("k").alias("__loam_k"), F.col("lead").alias("__loam_lead"), F.col("__loam_gone"))
    words = words_of(key)
    keyed = df.withColumn("__loam_key", F.when((F.size(words) > 0) & (F.lit(True) if among is None else among), digest(words)))
    dup = F.coalesce(F.col("__loam_gone").isNotNull() | (F.col(order) > F.col("__loam_lead")), F.lit(False))
    return keyed.join(known, keyed["__loam_key"] == known["__loam_k"], "left").select(*df.columns, dup.alias("is_dup"))


def decided(pairs: DataFrame, most: int = TASK) -> DataFrame:
    """v: the sets that go, of written pairs (ka, kb, a, b; a the earlier lead), where a set goes if it is near an earlier one that stays."""
    if not pairs.take(1):
        return pairs.select(F.col("kb").alias("v"))
    # digests as numbers for the search; equal numbers of different digests would join components, which does no harm
    number = lambda c: F.xxhash64(c)
    label = written(components(pairs.select(number("ka").alias("a"), number("kb").alias("b"))))
    edges = written(pairs.join(label, number("ka") == F.col("node")).select("ka", "kb", "a", "b", "component"))
    large = edges.groupBy("component").count().filter(F.col("count") > most).select("component")
    large = written(large)

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(frame["ka"], frame["kb"]):
            near.setdefault(a, []).append(b)
        gone: set[str] = set()
        for a in frame["ka"].iloc[frame["_rank"].to_numpy().argsort(kind="stable")]:
            if a not in gone:
                gone.update(near.pop(a, ()))
        return pd.DataFrame({"v": sorted(gone)}, dtype=object)

    # the order of leads may be of any type: a number in a component stands for it
    place = F.dense_rank().over(Window.partitionBy("component").orderBy("a", "ka"))
    small = edges.join(F.broadcast(large), "component", "left_anti").withColumn("_rank", place).select("component", "ka", "kb", "_rank")
    gone = written(small.groupBy("component").applyInPandas(greedy, "v string"))
    if not large.take(1):
        return gone
    return gone.unionByName(in_rounds(written(edges.join(large, "component", "left_semi").select("ka", "kb"))))


def in_rounds(edges: DataFrame) -> DataFrame:
    """v: the sets that go, of written edges (ka before kb): those without an undecided earlier neighbour stay, and their later neighbours go, until nothing is undecided."""
    gone = written(edges.select(F.col("ka").alias("v")).limit(0))
    while True:
        waits = edges.select(F.col("kb").alias("v")).distinct()
        stay = edges.select(F.col("ka").alias("v")).distinct().join(waits, "v", "left_anti")
        new = written(edges.join(stay, edges["ka"] == stay["v"], "left_semi").select(F.col("kb").alias("v")).distinct())
        if not new.take(1):
            return gone
        gone = written(gone.unionByName(new))
        edges = written(edges.join(new, edges["ka"] == new["v"], "left_anti").join(new, edges["kb"] == new["v"], "left_anti"))
