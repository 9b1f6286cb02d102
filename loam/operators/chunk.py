"""Overlapping chunks of long texts, and parts of long answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import SPACE, strip, url_code
from loam.operators.messages import message
from loam.operators.scratch import numbered

SIZE, OVERLAP, LEAST = 2500, 400, 200
#: Fixed value: what the question of a later part ends with.
HINT = "\n\nПродолжи ответ. Часть {}."
#: Pieces of an answer that a part has at least.
LEAST_BUDGET = 64


def starts(length: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    step = size - overlap
    last = F.when(length > size, F.ceil((length - overlap) / F.lit(step)) - 1).otherwise(F.lit(0))
    return F.sequence(F.lit(0), (last * step).cast("int"), F.lit(step))


def long_enough(text: Column, least: int = LEAST) -> Column:
    return F.length(strip(text)) >= least


def chunks(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """A row for each window of size characters, overlap apart from the next, of texts of at least `least` characters. All columns but text stay; text_md5 tells chunks of different texts apart."""
    rows = df.filter(long_enough(F.col(text), least)).withColumn("_n", F.length(text))
    rows = rows.select("*", F.posexplode(starts(F.col("_n"), size, overlap)).alias("chunk_no", "chunk_start"))
    return rows.withColumns({"chunk_end": F.least(F.col("chunk_start") + size, F.col("_n")), "document": F.substring(F.col(text), F.col("chunk_start") + 1, F.lit(size)), "text_md5": F.md5(F.col(text).cast("binary"))}).drop("_n", text)


def chunk_ids(df: DataFrame, order: str) -> DataFrame:
    """Running ids ``chunk_%06d`` of chunks() by order, text and place in it, without a task that holds all chunks.

    Articles that share an order have their chunks one after the other, articles that are equal altogether mix theirs; each chunk has an id of its own.
    """
    return numbered(df, [order, "text_md5", "chunk_no"], "_id").withColumn("chunk_id", F.format_string("chunk_%06d", F.col("_id"))).drop("_id", "text_md5")


def with_code(df: DataFrame, url: str) -> DataFrame:
    return df.withColumn("legal_code", url_code(F.col(url)))


def word_pieces(text: Column) -> Column:
    """A text cut before the white space that leads to each word, so that the pieces make up the text; white space at its end is the last piece's."""
    return F.regexp_extract_all(text, F.lit(rf"(?U){SPACE}*[^\s\x1c-\x1f]+(?:{SPACE}+\z)?"), F.lit(0))


def message_parts(df: DataFrame, longest: int, render: Callable[[Column], Column], pieces: Callable[[Column], Column] = word_pieces, hint: str = HINT, least: int = LEAST_BUDGET) -> DataFrame:
    """messages -> part_no, messages: conversations over the budget are cut in their last answer, of which nothing is lost.

    The budget of a part is longest less the pieces of its prompt: of what render makes of all messages with an empty last answer. Parts after the first
    add a hint with their number to the last user's message; all other messages stay in each part. The answers of the parts make up
    the answer, white space included. A conversation stays whole if it fits, if it doesn't end with an assistant's message that has words, or if a
    budget is below `least`. pieces cuts a text where a tokenizer would; its pieces must make up the text.
    """
    m = F.col("messages")
    last = F.try_element_at(m, F.lit(-1))
    asked = F.array_max(F.filter(F.transform(m, lambda x, i: F.when(x["role"] == "user", i)), lambda i: i.isNotNull()))
    rows = df.withColumns({"_asked": F.coalesce(asked, F.lit(-1)), "_pieces": F.when(last["role"] == "assistant", pieces(F.coalesce(last["content"], F.lit(""))))})

    def with_answer(answer: Column, part: Column) -> Column:
        before, after = hint.split("{}")
        more = F.when(part > 1, F.concat(F.lit(before), part.cast("string"), F.lit(after))).otherwise("")
        said = lambda x, i: F.when(i == F.size(m) - 1, answer).when(i == F.col("_asked"), F.concat(F.coalesce(x["content"], F.lit("")), more)).otherwise(x["content"])
        return F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), said(x, i).alias("content")))

    budget = lambda part: F.lit(longest) - F.size(pieces(render(with_answer(F.lit(""), F.lit(part)))))
    rows = rows.withColumns({"_n": F.size("_pieces"), "_first": budget(1), "_rest": budget(2)})
    whole = F.col("_pieces").isNull() | (F.col("_n") <= F.greatest("_first", F.lit(0))) | (F.col("_first") < least) | (F.col("_rest") < least)
    rows = rows.withColumn("_parts", F.when(whole, 1).otherwise(1 + F.ceil((F.col("_n") - F.col("_first")) / F.col("_rest")).cast("int")))
    rows = rows.withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    start = F.when(F.col("part_no") == 1, 1).otherwise(1 + F.col("_first") + (F.col("part_no") - 2) * F.col("_rest"))
    piece = F.array_join(F.slice("_pieces", start, F.greatest(F.when(F.col("part_no") == 1, F.col("_first")).otherwise(F.col("_rest")), F.lit(1))), "")
    cut = F.when(F.col("_parts") == 1, m).otherwise(with_answer(piece, F.col("part_no")))
    return rows.withColumn("messages", cut).drop("_asked", "_pieces", "_n", "_first", "_rest", "_parts")


def answer_parts(df: DataFrame, longest: int, hint: str = HINT, least: int = LEAST_BUDGET) -> DataFrame:
    """user, answer -> part_no, user, answer: message_parts() of one question and its answer, whose words alone count."""
    said = lambda i: F.get("messages", F.lit(i))["content"]
    asked = df.withColumn("messages", F.array(message("user", F.col("user")), message("assistant", F.col("answer"))))
    words_only = lambda m: F.array_join(F.transform(m, lambda x: x["content"]), "\n")
    return message_parts(asked, longest, words_only, hint=hint, least=least).withColumns({"user": said(0), "answer": said(1)}).drop("messages")
