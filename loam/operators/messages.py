"""Chat messages: an array of (role, content) in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import article_number, clean_article, clean_chat, first_words, nonempty, strip, title_parts

MESSAGES = "array<struct<role:string,content:string>>"
#: The system prompt and the question for records without one.
SYSTEM = "Ты - юридический ассистент, который помогает разбираться в российском законодательстве."
QUESTION = "Расскажи об этой статье кодекса"


#: Fields of older record forms.
LEGACY = ["instruction", "input", "case", "question", "article_title", "article", "answer", "output", "context"]


def collect_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation: key and messages in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, "role", F.col("text").alias("content"))))
    return turns.groupBy(key).agg(rows.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chatml(df: DataFrame) -> DataFrame:
    """raw_case, raw_article, is_messages_format -> messages and reason (null: kept).

    Records that were messages need both sides; others get a default question and keep an empty answer.
    """
    user, answer = strip(F.coalesce("raw_case", F.lit(""))), strip(F.coalesce("raw_article", F.lit("")))
    bad = F.col("is_messages_format") & ((user == "") | (answer == ""))
    asked = F.when(user == "", F.lit(QUESTION)).otherwise(user)
    return df.withColumns({"messages": F.array(message("system", F.lit(SYSTEM)), message("user", asked), message("assistant", answer)), "reason": F.when(bad, F.lit("empty_after_normalization"))})


def clean_messages(messages: Column) -> Column:
    """Cleaned contents; empty ones go."""
    return F.filter(F.transform(messages, lambda m: F.struct(m["role"].alias("role"), clean_chat(F.coalesce(m["content"], F.lit(""))).alias("content"))), lambda m: m["content"] != "")


def loader_messages(messages: Column) -> Column:
    """Stripped messages with a role and a content, or null unless there is a user's one and the last is the assistant's."""
    kept = F.filter(F.transform(messages, lambda m: F.struct(strip(F.coalesce(m["role"], F.lit(""))).alias("role"), strip(F.coalesce(m["content"], F.lit(""))).alias("content"))), lambda m: (m["role"] != "") & (m["content"] != ""))
    good = (F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1))["role"] == "assistant") & F.exists(kept, lambda m: m["role"] == "user")
    return F.when(good, kept)


def legacy_pair(df: DataFrame) -> tuple[Column, Column]:
    """User and answer from the older fields instruction, input, case, question, article_title; article, answer, output, context. Missing ones count as null."""
    have = lambda name: nonempty(strip(F.col(name))) if name in df.columns else F.lit(None).cast("string")
    user = F.coalesce(have("case"), have("question"), have("input"), have("article_title"))
    told = F.when(have("instruction").isNotNull() & have("input").isNotNull(), F.concat(have("instruction"), F.lit("\n\n"), have("input")))
    return F.coalesce(told, user, have("instruction"), F.lit("")), F.coalesce(have("article"), have("answer"), have("output"), have("context"), F.lit(""))


def inst_text(messages: Column) -> Column:
    """``<s>[INST] system, user [/INST] assistant</s>`` of the last user and assistant."""
    some = lambda role: F.filter(messages, lambda m: (m["role"] == role) & (F.coalesce(m["content"], F.lit("")) != ""))
    last = lambda role: F.coalesce(F.try_element_at(some(role), F.lit(-1))["content"], F.lit(""))
    system = strip(F.array_join(F.transform(some("system"), lambda m: m["content"]), "\n\n"))
    user = last("user")
    user = F.when((system != "") & (user != ""), F.concat(system, F.lit("\n\n"), user)).otherwise(user)
    return F.concat(F.lit("<s>[INST] "), user, F.lit(" [/INST] "), last("assistant"), F.lit("</s>"))


def chat_text(messages: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """All messages in the form of a chat template: begin, role, line feed, content, end, line feed. Null contents are empty."""
    turn = lambda m: F.concat(F.lit(begin), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(f"{end}\n"))
    return F.array_join(F.transform(messages, turn), "")


def qa_pair(df: DataFrame, law_name: Column) -> DataFrame:
    """title, content -> question and answer of a statute article; rows without a title's text go."""
    case, article = clean_article(F.coalesce("title", F.lit(""))), clean_article(F.coalesce("content", F.lit("")))
    df = df.withColumns({"_case": case, "_article": article})
    number, title = title_parts(F.col("_case"))
    df = df.withColumns({"_number": number, "_title": title})
    rest = strip(F.expr("substring(_article, length(_case) + 1)"))
    rest = F.when(rest.startswith(". "), strip(F.substring(rest, 3, 1 << 30))).otherwise(rest)
    body = F.when(F.expr("startswith(_article, _case)"), rest).otherwise(F.col("_article"))
    head = F.concat(F.lit("Статья "), F.col("_number"), F.lit(". "), F.col("_title"))
    answer = F.when((body != "") & (strip(body) != strip(F.col("_title"))), F.concat(head, F.lit(" "), body)).otherwise(head)
    asked = F.concat(F.lit("Какая статья из "), law_name, F.lit(" регулирует: "), first_words(F.col("_title"), 6))
    return df.withColumns({"question": asked, "answer": answer}).filter(F.col("_title") != "").drop("_case", "_article", "_number", "_title")


def question_of(code: Column, title: Column, content: Column) -> tuple[Column, Column]:
    """Article number, and the question that a titled article answers."""
    number = article_number(F.coalesce(nonempty(content), title))
    gone = lambda x, what: strip(F.replace(x, what))
    name = gone(gone(gone(title, F.concat(F.lit("Статья "), number)), F.concat(F.lit("ст. "), number)), F.concat(F.lit("Статья "), F.replace(number, F.lit("_"), F.lit(" "))))
    known = F.concat(F.lit("Какая статья из "), F.upper(code), F.lit(" кодекс РФ регулирует: "), F.coalesce(nonempty(name), title))
    told = F.when(title != "", F.concat(F.lit("Расскажи о статье: "), title)).otherwise(F.concat(F.lit("Расскажи об этой статье "), F.upper(code), F.lit(" кодекса")))
    return number, F.when(number != "unknown", known).otherwise(told)


def content_hash(messages: Column) -> Column:
    """md5 of ``role:content`` joined by ``|``."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "|").cast("binary"))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
