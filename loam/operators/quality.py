"""Filters with a reason for each row that goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.text import noisy, repetitive, strip, token_count, truncated
from loam.operators.messages import last_of

LEAST_USER, LEAST_ANSWER, MOST_TOTAL = 5, 10, 50_000


def reason(messages: Column) -> Column:
    """The first test that a record fails, or null."""
    user, answer = F.coalesce(last_of(messages, "user"), F.lit("")), F.coalesce(last_of(messages, "assistant"), F.lit(""))
    return (
        F.when(F.length(strip(user)) < LEAST_USER, "user_too_short")
        .when(F.length(strip(answer)) < LEAST_ANSWER, "assistant_too_short")
        .when(F.length(user) + F.length(answer) > MOST_TOTAL, "too_long")
        .when(repetitive(user) | repetitive(answer), "repetitive_chars")
        .when((F.length(answer) > 100) & truncated(answer), "truncated")
    )


def bad_format(messages: Column) -> Column:
    return messages.isNull() | (F.size(messages) == 0)


def noise(messages: Column) -> Column:
    return F.coalesce(F.exists(messages, lambda m: noisy(F.coalesce(m["content"], F.lit("")))), F.lit(False))


def overlong(text: Column, most_tokens: int) -> Column:
    """Whether a rendered text has more tokens (words) than a model's window."""
    return token_count(text) > most_tokens


#: How a lower-cased name tells weights for inference: by its end, or by this pattern.
INFERENCE_END, INFERENCE = ".gguf", r"(^|[\/_\-])gguf($|[\/_\-])"


def inference_only(name: Column) -> Column:
    """Whether a model's name or path tells weights that can't be trained on. Null and blank names tell nothing."""
    lower = F.lower(strip(F.coalesce(name, F.lit(""))))
    return lower.endswith(INFERENCE_END) | lower.rlike(INFERENCE)
