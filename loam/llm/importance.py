"""Importance resampling towards a target distribution, by hashed n-grams (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import let, placed, plain_words, row_place, save, table

#: Buckets of features, the longest run of words that is a feature, the fewest words of a document that can be drawn, the percentage drawn, the seed.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7


def buckets(words: Column, longest: int = LONGEST, n: int = BUCKETS) -> Column:
    """The bucket of each feature of a text: of all runs of 1 to longest words, joined by one space."""
    number = lambda x: (F.crc32(x.cast("binary")) % n).cast("int")

    def runs(k: int) -> Column:
        if k == 1:
            return F.transform(words, lambda x: number(x))
        cut = F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))
        return F.transform(cut, lambda x, i: number(F.concat_ws(" ", x, *(F.get(words, i + j) for j in range(1, k)))))

    return F.concat(*(runs(k) for k in range(1, longest + 1)))


def counted(hashed: DataFrame) -> DataFrame:
    """bucket and n: its features over all rows, summed before the shuffle."""
    return hashed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gain_table(raw: DataFrame, target: DataFrame, n: int = BUCKETS) -> DataFrame:
    """bucket and gain: thousandths of the log ratio of a bucket's shares in target and raw, each with one more feature a bucket. n rows at most: a bucket without a feature of raw is not needed."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = ((t + 1) * F.lit(float(total(raw) + n))) / ((s + 1) * F.lit(float(total(target) + n)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def noise(name: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, floored, from a hash of the seed and a name (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, longest: int = LONGEST, n_buckets: int = BUCKETS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of docs (key and text) with n_words, n_features, weight, score and rank (long; null: not drawn).

    weight is the floored mean of its features' gains (0 without features), score adds the noise of the key. Of the rows
    with at least least_words words, the percent with the highest scores are drawn, without replacement; ties go to the smaller key (null keys
    first), then to the place of the row. Null texts have no words. Repeated rows count each. An empty docs gives no rows, an empty target gives
    every bucket its own share's inverse.

    Texts are hashed once: a row's buckets are written as a list column, which is read for the counts and
    again for the sums. The gain table has n_buckets rows at most and is broadcast. Sums of a row's gains are partial before the shuffle, so a
    long text is one row there. Rows are sorted by ranges of (drawable, score, key, place), so equal scores split too; a range's ranks begin after the counts of
    the ranges before it.
    """
    spark = docs.sparkSession
    hashed = let(plain_words(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), buckets(w, longest, n_buckets).alias("buckets")))
    rows = placed(docs.select(key, text), key, text).select(F.col(key).alias("key"), "_file", "_row", hashed.alias("x")).select("key", "_file", "_row", "x.*")
    rows = save(rows, "buckets")
    aim = save(target.select(let(plain_words(F.col(text)), lambda w: buckets(w, longest, n_buckets)).alias("buckets")), "target")
    raw, want = save(counted(rows), "raw_counts"), save(counted(aim), "target_counts")
    gains = save(gain_table(raw, want, n_buckets), "gains")
    each = rows.select("key", "_file", "_row", "n_words", F.explode_outer("buckets").alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    each = each.groupBy("key", "_file", "_row", "n_words").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(0).cast("long")
    scored = save(each.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("key"), seed)).drop("sum"), "scores")

    able = F.col("n_words") >= least_words
    order = [F.when(able, 0).otherwise(1), F.col("score").desc(), F.col("key"), F.col("_file"), F.col("_row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = save(scored.repartitionByRange(n, *order).sortWithinPartitions(*order), "ordered")
    file, row = row_place()
    at = ordered.withColumns({"_part": file, "_place": row})
    counts = sorted(at.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(able, 1)).alias("able")).collect())  # a row a range
    before, total = [], 0
    for c in counts:
        before.append((c["_part"], total))
        total += c["n"]
    drawn = percent * sum(c["able"] for c in counts) // 100
    starts = spark.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + F.col("_place") + 1
    out = at.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= drawn, rank))
    return out.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight towards the benchmark, score and rank; null texts have no words."""
    found = resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The same for DuckDB, with crc32 by its table of 256 remainders, which comes from its polynomial."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    shifts = "i::UBIGINT"
    for _ in range(8):
        shifts = f"(SELECT CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END FROM (SELECT {shifts} AS x))"
    features = lambda name: f"SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {name}"
    return rf"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    items AS (SELECT row_number() OVER () AS r, {words} AS w FROM benchmark),
    remainders AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM (SELECT i, {shifts} AS x FROM range(256) a(i))),
    doc_features AS MATERIALIZED ({features("docs")}), item_features AS MATERIALIZED ({features("items")}),
    names AS (SELECT DISTINCT f FROM (SELECT f FROM doc_features UNION ALL SELECT f FROM item_features)),
    bytes AS (SELECT f, hex(encode(f)) AS h FROM names),
    steps(f, h, pos, crc) AS (SELECT f, h, 1::BIGINT, 4294967295::UBIGINT FROM bytes
        UNION ALL SELECT f, h, pos + 2, xor(crc >> 8, t[(1 + (xor(crc, ('0x' || substr(h, pos, 2))::UBIGINT) & 255))::BIGINT]) FROM steps, remainders WHERE pos < len(h)),
    bucket_of AS MATERIALIZED (SELECT f, xor(crc, 4294967295::UBIGINT) % {BUCKETS} AS b FROM steps WHERE pos > len(h)),
    raw AS (SELECT b, count(*) AS s FROM doc_features JOIN bucket_of USING (f) GROUP BY b),
    want AS (SELECT b, count(*) AS t FROM item_features JOIN bucket_of USING (f) GROUP BY b),
    gains AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_features) + {BUCKETS})::DOUBLE)
        / ((s + 1)::DOUBLE * ((SELECT count(*) FROM item_features) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM raw LEFT JOIN want USING (b)),
    sums AS (SELECT r, count(*) AS n, sum(g) AS g FROM doc_features JOIN bucket_of USING (f) JOIN gains USING (b) GROUP BY r),
    weights AS (SELECT docs.r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN floor(g::DOUBLE / n)::BIGINT ELSE 0 END AS weight,
        ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT AS h FROM docs LEFT JOIN sums USING (r)),
    scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, r) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () AS able FROM scores)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= {PERCENT} * able // 100 THEN place END AS rank FROM ranked"""
