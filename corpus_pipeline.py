"""The pipeline over documents: toxicity, language ID, n-gram Jaccard join, best-fit packing.

Each stage gets all rows that the one before it kept, with the columns of documents, and all but the
last return these columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import langid, ngram_join, packing, toxicity
from loam.llm.common import row_place, save, ship, sweep, table, tables

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Learns from the labelled ones among docs (those that aren't held out); without any, all stay.

    Null and empty texts stay unless most labelled texts of that kind are toxic. Rows may repeat; other columns are left out.
    """
    ship(spark)
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, COLUMNS).filter("predicted = 0").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the column lang stays as it is. Learns from docs that aren't held out; without any, none is recognised.

    Null texts and texts without a letter have no language and go. Rows may repeat; other columns are left out.
    """
    ship(spark)
    model = langid.fit(langid.learnable(docs))
    return langid.predict(docs, model, COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each group of linked rows; of several with that id, the one of the least text and other columns.

    Rows go one by one, not by doc_id, so unlinked texts stay whatever ids they have. Rows without an id are no
    group's least one: they go if a row of their group has an id, else all of the group stay. Texts without words are
    linked to nothing: of those of one doc_id one stays, and none beside a text with words of that doc_id that stays.
    """
    ship(spark)
    file, place = row_place()
    rows = save(docs.select(*COLUMNS), "rows").withColumn("row", file * F.lit(1 << 36) + place)
    found = save(ngram_join.join(rows, row="row").select("row", "doc_id", "component"), "groups")
    least = found.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    named = save(found.join(least, "component", "left"), "least")
    gone = named.filter("least is not null and (doc_id is null or doc_id > least)").select("row")
    first = named.filter("doc_id is not null and (component is null or doc_id = least)").select("row", "doc_id", "component")
    # several rows of one group and its least id
    again = save(first.groupBy("component", "doc_id").count().filter("count > 1").select("doc_id"), "again")
    several = save(ngram_join.of_docs(first, again), "several")
    texts = ngram_join.of_docs(rows, again).join(several.select("row", "component"), "row")
    best = save(texts.groupBy("component", "doc_id").agg(F.min(F.struct(*(c for c in COLUMNS if c != "doc_id"), "row")).alias("x")).select("x.row"), "best")
    gone = gone.unionByName(ngram_join.of_docs(several, best, "left_anti", "row").select("row"))
    # texts without words beside others of their id
    bare = first.filter("component is null")
    beside = ngram_join.of_docs(first.filter("component is not null"), bare)
    gone = gone.unionByName(ngram_join.of_docs(bare, beside).select("row"))
    return ngram_join.of_docs(rows, save(gone, "gone"), "left_anti", "row").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of docs in sequences of at most 2048 tokens. Null and empty texts are the end id alone; repeated rows are packed each; an empty table gives no rows."""
    ship(spark)
    return packing.pack(packing.cut_documents(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxic), ("language_id", language), ("ngram_join", one_of_each), ("packing", packed)]

#: SQL expresses none of the models; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again, and what it needed is deleted then."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    others = tables()
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        sweep(others | {docs.loam_path})
    return docs
