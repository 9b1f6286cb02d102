"""Column builders for text. Patterns follow Python's notion of white space and digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"

#: Names of laws by code.
LAWS = {
    "НК": "Налоговый кодекс РФ",
    "ГК": "Гражданский кодекс РФ",
    "ТК": "Трудовой кодекс РФ",
    "ЖК": "Жилищный кодекс РФ",
    "КоАП": "Кодекс об административных правонарушениях",
    "УК": "Уголовный кодекс РФ",
    "ФЗ": "Федеральный закон",
}
OTHER_LAW, NO_LAW, NO_CODE = "Другой закон", "Неизвестно", "UNKNOWN"
#: Remains of web pages, and lines of a page's controls.
NOISE = ["<[^>]*>", 'id="[^"]*"', "undefined", "null", r"\[object Object\]", "Закрыть|Развернуть|Свернуть"]
STOP_LINES = ["Закрыть", "Развернуть", "Свернуть"]
#: Remarks on editions.
REMARKS = ["В редакции", "Дополнение", "Утратила силу"]


def rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python's str.strip."""
    return rx(c, rf"(?U)^{SPACE}+|{SPACE}+\z")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(rx(c, rf"(?U){SPACE}+", " "))


def clean_chat(c: Column) -> Column:
    """Cleaning of messages: a leading id attribute and ``>``, white space, and the words undefined and null, in this order."""
    steps = [(rf'(?U)^id="[^"]*"{SPACE}*', ""), (rf"(?U)^>{SPACE}*", ""), (" ", " "), ("[ \\t]+", " "), ("\\n+", " "), (" +", " "), (r"(?iU)\bundefined\b", ""), (r"(?iU)\bnull\b", "")]
    return strip(reduce(lambda x, s: rx(x, *s), steps, c))


def clean_article(c: Column) -> Column:
    """Cleaning of statute texts: remarks in brackets on one line go, then white space."""
    return squeeze(reduce(lambda x, r: rx(x, rf"\({r}[^\n]*?\)"), REMARKS, c))


def nonempty(c: Column) -> Column:
    """Null for null or empty."""
    return F.nullif(c, F.lit(""))


def article_number(c: Column) -> Column:
    """``1`` or ``1_2`` after the word for article, whatever its case; else ``unknown``."""
    found = F.regexp_extract(c, rf"(?iU)Статья{SPACE}+(\d+(?:{SPACE}+\d+)?)", 1)
    return F.coalesce(nonempty(F.replace(found, F.lit(" "), F.lit("_"))), F.lit("unknown"))


def dotted_number(c: Column) -> Column:
    """``14.3`` after the word for article, in this case; else null."""
    return nonempty(F.regexp_extract(c, rf"(?U)Статья{SPACE}+(\d+(?:\.\d+)*)", 1))


def title_parts(c: Column) -> tuple[Column, Column]:
    """Number and title of a heading; a text without heading is all title."""
    pattern = rf"(?U)^Статья{SPACE}+([\d½\-\s\x1c-\x1f]+)\.?{SPACE}*([^\n]+)"
    fits = c.rlike(pattern)
    return F.when(fits, strip(F.regexp_extract(c, pattern, 1))).otherwise(F.lit("неизвестная")), F.when(fits, strip(F.regexp_extract(c, pattern, 2))).otherwise(c)


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def repetitive(c: Column) -> Column:
    """Five equal characters in a row, other than space, tab and line feed, that something follows; in texts of ten at least."""
    return (F.length(c) >= 10) & c.rlike(r"(?s)([^ \n\t])\1{4}.")


def truncated(c: Column) -> Column:
    """No sentence end near the end of a stripped text of 100 characters or more; empty texts are truncated."""
    t = strip(c)
    closed = F.right(t, F.lit(1)).rlike(r"[.!?;)\]}\"]") | F.right(t, F.lit(30)).rlike(r"[.!?;]")
    return F.when(F.length(t) == 0, F.lit(True)).when(F.length(t) < 100, F.lit(False)).otherwise(~closed)


def noisy(c: Column) -> Column:
    """Whether a text holds remains of a web page, in any case, also inside words."""
    return c.rlike("(?iU)" + "|".join(NOISE))


def law(article: Column, title: Column) -> tuple[Column, Column]:
    """Name and code of the law in an article's heading, else in its title's."""
    pattern = rf"(?iU)^Статья{SPACE}+\d+{SPACE}+([А-ЯA-Z]+)"
    code = F.coalesce(nonempty(F.upper(F.regexp_extract(article, pattern, 1))), nonempty(F.upper(F.regexp_extract(title, pattern, 1))))
    names = F.create_map(*(F.lit(x) for pair in LAWS.items() for x in pair))
    return F.when(code.isNull(), F.lit(NO_LAW)).otherwise(F.coalesce(F.try_element_at(names, code), F.lit(OTHER_LAW))), F.coalesce(code, F.lit(NO_CODE))


def url_code(url: Column) -> Column:
    """The fourth part of a url between slashes, in upper case; null if there is none."""
    return F.upper(F.get(F.split(url, "/"), F.lit(3)))


def unescape(c: Column) -> Column:
    """Escapes of quotes, line ends and tabs."""
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), [('\\"', '"'), ("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t")], c)


def drop_stop_lines(c: Column) -> Column:
    """Lines of page controls and empty ones go; the rest is squeezed to one line."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: (x != "") & ~x.isin(STOP_LINES))
    return squeeze(F.array_join(lines, "\n"))


def token_count(c: Column) -> Column:
    """Words, one at least: stands in where no tokenizer is at hand."""
    return F.greatest(F.lit(1), F.size(words(c)))
