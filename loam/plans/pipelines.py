"""Whole runs: preprocessing, health, retrieval. Each is one lazy plan with a reason for each row that goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text
from loam.operators import chunk, dedup, html, messages, profile, quality, sets, split, vector
from loam.operators.scratch import written
from loam.sources import readers, sinks


def tag(records: DataFrame) -> DataFrame:
    """Records with messages and the first reason of normalization, cleaning and filters (null: kept)."""
    rows = messages.chatml(records)
    rows = rows.withColumn("messages", messages.clean_messages(F.col("messages")))
    later = F.when(F.size("messages") < 2, "empty_after_cleaning").otherwise(quality.reason(F.col("messages")))
    return rows.withColumn("reason", F.coalesce("reason", later))


def near_key(m: Column) -> Column:
    user, answer = (F.coalesce(messages.last_of(m, r), F.lit("")) for r in ("user", "assistant"))
    return F.concat(F.left(F.lower(user), F.lit(200)), F.lit("|||"), F.left(F.lower(answer), F.lit(500)))


def deduplicated(tagged: DataFrame, order: str) -> DataFrame:
    """Reasons exact_duplicate and near_duplicate for rows that had none."""
    free = F.col("reason").isNull()
    told = lambda rows, why: rows.withColumn("reason", F.coalesce("reason", F.when(F.col("is_dup"), why))).drop("is_dup")
    exact = written(told(dedup.exact(tagged, F.to_json("messages"), order, free), "exact_duplicate"))
    return told(dedup.near(exact, near_key(F.col("messages")), order, free), "near_duplicate")


def preprocess(spark: SparkSession, raw_dir: str, out: str, seed: int = 42, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Ingest, normalize, clean, filter, dedup, split, and write data, manifest and report under out. Gives the kept rows with their split."""
    split.check_ratios(train, val, test)
    records = readers.raw_directory(spark, raw_dir).withColumn("ord", F.struct("file_name", "item_idx"))
    tagged = written(deduplicated(written(tag(records)), "ord"))
    sinks.report(profile.stage_report(tagged), profile.reason_histogram(tagged), f"{out}/report")
    sinks.code_report(profile.code_counts(tagged), f"{out}/codes")
    kept = tagged.filter("reason is null")
    if not kept.take(1):
        return kept
    parts = written(split.stratified(kept, "group_id", "code", "ord", train, val, seed))
    for name in ("train", "val", "test"):
        sinks.jsonl(parts.filter(F.col("split") == name), f"{out}/{name}")
    sinks.split_manifest(parts, "group_id", seed, f"{out}/manifest")
    return parts


def health(spark: SparkSession, paths: dict[str, str], out: str | None = None) -> DataFrame:
    """Counts of datasets (train, test, val: path) with leaks: of test into train, of val into both."""
    rows = None
    for name, path in paths.items():
        item = readers.lines(spark, path).select(F.lit(name).alias("dataset"), F.expr(f"try_variant_get(try_parse_json(item), '$.messages', '{messages.MESSAGES}')").alias("messages"))
        rows = item if rows is None else rows.unionByName(item)
    rows = written(rows)
    counts = profile.health(rows, F.col("dataset"))
    hashed = rows.filter(~quality.bad_format(F.col("messages"))).select("dataset", messages.content_hash(F.col("messages")).alias("h"))
    for name, against in (("test", ["train"]), ("val", ["train", "test"])):
        leaks = profile.leaked(hashed.filter(F.col("dataset") == name), hashed.filter(F.col("dataset").isin(against)))
        n = leaks.groupBy("dataset").agg(F.count(F.lit(1)).alias(f"leaks_{name}"))
        counts = counts.join(n, "dataset", "left")
    counts = counts.select(*[c for c in counts.columns if not c.startswith("leaks_")], F.coalesce("leaks_test", "leaks_val", F.lit(0)).alias("leakage_count"))
    if out:
        sinks.health_report(counts, out)
    return counts


def article_chunks(articles: DataFrame) -> DataFrame:
    """url, title, content -> chunks with ids and metadata, ready to be embedded."""
    rows = chunk.chunks(articles.withColumn("_o", F.struct("url", "title")), "content")
    return chunk.with_code(chunk.chunk_ids(rows, "_o"), "url").select("chunk_id", "document", F.col("url").alias("article_url"), F.col("title").alias("article_title"), "chunk_start", "chunk_end", "legal_code")


def build_retrieval(spark: SparkSession, articles: str, index: str, embed: Callable[[DataFrame], DataFrame] | str) -> dict[str, int]:
    """Chunk, embed and index the articles of an array file, as a new version of the index. Gives counts of articles, those too short, and chunks."""
    rows = readers.articles(spark, articles)
    vector.build_index(article_chunks(rows), embed, index)
    long = chunk.long_enough(F.col("content"))
    counts = rows.agg(F.count(F.lit(1)).alias("articles"), F.count_if(~F.coalesce(long, F.lit(False))).alias("too_short")).first()
    return {**counts.asDict(), "chunks": vector.open_index(spark, index).count()}


def ask(spark: SparkSession, index: str, query: str, embed: Callable[[DataFrame], DataFrame] | str, k: int = 5, code: str | None = None) -> DataFrame:
    """The k chunks nearest to a query: rank, distance, similarity, text and metadata. A blank query finds nothing; code looks in one folder of the index only. An embedding stored with the index is used instead of embed."""
    rows = vector.open_index(spark, index)
    vectors = (vector.index_embedder(spark, index) or embed)(spark.createDataFrame([(query,)], "document string")).select("embedding").first() if query and query.strip() else None
    if vectors is None or not vectors[0]:
        return vector.results(vector.search(rows.limit(0), [1.0], k, id_="chunk_id"))
    return vector.results(vector.search(rows, list(vectors[0]), k, None if code is None else F.col("legal_code") == code, id_="chunk_id"))


def qa_dataset(spark: SparkSession, files: dict[str, str], out: str | None = None) -> DataFrame:
    """Question and answer messages of the article files (path: name of the law), written to out as JSON."""
    rows = readers.file_map(spark, files)
    pairs = messages.qa_pair(rows, F.col("law_name"))
    made = pairs.select("file_no", F.array(messages.message("user", F.col("question")), messages.message("assistant", F.col("answer"))).alias("messages"))
    if out:
        sinks.rows_json(made.select("messages"), out)
    return made


def labelled(rows: DataFrame) -> DataFrame:
    """Columns law and law_code from article, title and article_title, as far as there are any."""
    have = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(""))
    name, code = text.law(have("article", "article_title"), have("title", "article_title"))
    return rows.withColumns({"law": name, "law_code": code})


def label_file(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Label the records of an array file, write them, and give the counts of each law."""
    made = labelled(readers.record_array(spark, path))
    sinks.rows_json(made, out)
    return made.groupBy("law_code", "law").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "law_code")


def training_set(spark: SparkSession, path: str, most_tokens: int, overlong: str = "chunk", keep_ratio: float = 1.0, seed: int = 42, render: Callable[[Column], Column] = messages.inst_text) -> tuple[DataFrame, DataFrame]:
    """Loader-normalized records (item, messages, text, n_tokens) that fit most_tokens, and one row of counts.

    overlong: ``chunk`` cuts the last answer of over-long records to parts with a follow-up question, nothing of which is lost, ``drop`` leaves the records
    out, ``keep`` keeps them. Tokens are words of the rendered text. keep_ratio below 1 takes a seeded share; render makes the text of messages.
    """
    if overlong not in ("chunk", "drop", "keep"):
        raise ValueError(f"overlong is chunk, drop or keep, not {overlong}")
    rows = readers.training_records(spark, path)
    if keep_ratio < 1:
        rows = rows.filter(split.unit(F.col("item"), seed) < keep_ratio)
    rows = readers.with_fields(rows, messages.LEGACY)
    user, answer = messages.legacy_pair(rows)
    rows = rows.withColumn("messages", F.coalesce(messages.loader_messages(F.col("messages")), F.when((user != "") & (answer != ""), F.array(messages.message("user", user), messages.message("assistant", answer)))))
    good = written(rows.filter(F.col("messages").isNotNull()).select("item", "messages"))
    sized = good.withColumn("n_tokens", text.token_count(render(F.col("messages"))))
    fits = F.col("n_tokens") <= most_tokens
    counts = sized.agg(F.count(F.lit(1)).alias("loaded"), F.count_if(fits).alias("fitting"), F.count_if(~fits).alias("overlong"))
    if overlong != "keep":
        short = sized.filter(fits)
        if overlong == "chunk":
            parts = chunk.message_parts(sized.filter(~fits).select("item", "messages"), most_tokens, render)
            short = short.unionByName(parts.select("item", "messages").withColumn("n_tokens", text.token_count(render(F.col("messages")))))
        sized = short
    made = sized.withColumn("text", render(F.col("messages")))
    dropped = F.col("overlong") if overlong == "drop" else F.lit(0).cast("long")
    chunked = F.col("overlong") if overlong == "chunk" else F.lit(0).cast("long")
    return made, counts.select("loaded", "fitting", dropped.alias("dropped"), chunked.alias("chunked"))


def page_pairs(docs: DataFrame, out: str | None = None, test_ratio: float = 0.1, seed: int = 42, most: int = 900) -> DataFrame:
    """Pages with content trees (code, doc_hash, html, nodes) -> pairs (case, article) with their split, by code.

    At most `most` records a code, in order of document, node and the digest of their text; of each case the longest article stays; a seeded share of each
    code's pairs is its test part. Written in folders by code and split; a reader of all codes reads the parent folder.
    """
    records = html.article_records(html.node_slices(docs))
    named = records.withColumn("_text", F.md5(F.col("content").cast("binary")))  # pages may share a doc_hash
    pairs = sets.cap(named, "code", ["doc_hash", "node_id", "_text"], most, "ord").select("code", F.col("title").alias("case"), F.col("content").alias("article"), "ord")
    once = written(dedup.longest(pairs, ["code", "case"], "article", "ord"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(split.shuffled(F.col("first_seen"), seed)))
    n = once.groupBy("code").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(float(test_ratio)))).alias("_n"))
    parts = once.withColumn("_r", rank).join(n, "code").withColumn("split", F.when(F.col("_r") <= F.col("_n"), "test").otherwise("train")).drop("_r", "_n", "ord")
    if out:
        parts.write.mode("overwrite").partitionBy("code", "split").json(out)
    return parts
