"""Chunk ids, lossless parts of answers, longest rows and last steps of the id cascade."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions.text import token_count
from loam.operators import chunk, dedup, html, messages
from loam.plans import catalogue, pipelines
from tests.conftest import SF
from tests.helpers import same


def test_ids_of_articles_that_share_url_and_title(spark):
    texts = ["a" * 3000, "b" * 3000, "a" * 3000, "c" * 10_000]
    rows = spark.createDataFrame([("https://h/gk/1/x", "Same", t) for t in texts], "url string, title string, content string")
    got = pipelines.article_chunks(rows).collect()
    n = sum(len(range(0, len(t) - 400, 2100)) for t in texts)
    assert sorted(r["chunk_id"] for r in got) == [f"chunk_{i:06d}" for i in range(n)]
    at = {r["chunk_id"]: r["document"][0] for r in got}
    letters = "".join(at[k] for k in sorted(at))
    assert all(letters.count(x) == letters.rindex(x) - letters.index(x) + 1 for x in "abc"), "chunks of a text stand together"


def test_ids_of_nothing(spark):
    assert pipelines.article_chunks(spark.createDataFrame([], "url string, title string, content string")).count() == 0


def test_longest_takes_any_order(spark):
    rows = [("k", "aa", -(2**63)), ("k", "bb", 5), ("k", "c", -(2**62)), ("n", None, 1), ("n", "", 2), ("m", None, 7)]
    df = spark.createDataFrame(rows, "k string, t string, i long")
    got = {r["k"]: (r["t"], r["first_seen"]) for r in dedup.longest(df, ["k"], "t", "i").collect()}
    assert got == {"k": ("aa", -(2**63)), "n": ("", 1), "m": (None, 7)}
    paired = df.withColumn("o", F.struct(F.lit("f"), "i"))
    assert {r["k"]: r["t"] for r in dedup.longest(paired, ["k"], "t", "o").collect()}["k"] == "aa"


def conversation(spark, *turns):
    return spark.createDataFrame([([{"role": r, "content": c} for r, c in turns],)], f"messages {messages.MESSAGES}")


def plain(turns, longest, count):
    """The parts of a conversation, by a loop over words with the white space before them."""
    import re

    if turns[-1][0] != "assistant" or not turns[-1][1].strip():
        return [turns]
    words = re.findall(r"\s*\S+(?:\s+\Z)?", turns[-1][1])
    asked = max((i for i, t in enumerate(turns) if t[0] == "user"), default=None)
    out, at = [], 0
    while at < len(words):
        now = [list(t) for t in turns]
        if len(out) and asked is not None:
            now[asked][1] += chunk.HINT.format(len(out) + 1)
        now[-1][1] = ""
        room = longest - count(now)
        if room < 64 and not (not out and len(words) <= room):
            return [turns]
        now[-1][1] = "".join(words[at : at + room])
        out.append([tuple(t) for t in now])
        at += room
    return out


@pytest.mark.parametrize(
    "turns",
    [
        [("system", "Be brief."), ("user", "First one?"), ("assistant", "Yes."), ("user", "And  more?"), ("assistant", "  w1\n\n" + "".join(f"word{i}{' ' * (1 + i % 3)}" for i in range(500)) + "\t\n")],
        [("user", "q"), ("assistant", "short  answer ")],
        [("assistant", "x " * 400)],
        [("user", "long " * 250), ("assistant", "x " * 400)],
        [("user", "q"), ("assistant", "x " * 400), ("user", "last")],
        [("user", "q"), ("assistant", " \n ")],
    ],
)
def test_parts_of_conversations_lose_nothing(spark, turns):
    render = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    count = lambda ts: len(" ".join(f"{r}: {c}" for r, c in ts).split())
    got = chunk.message_parts(conversation(spark, *turns), 200, render).orderBy("part_no").collect()
    parts = [[(m["role"], m["content"]) for m in r["messages"]] for r in got]
    assert parts == plain(turns, 200, count)
    assert "".join(p[-1][1] for p in parts) == turns[-1][1]
    if len(parts) > 1:
        sized = chunk.message_parts(conversation(spark, *turns), 200, render).select(token_count(render(F.col("messages"))).alias("n")).collect()
        assert max(r["n"] for r in sized) <= 200


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=" \n\t\x1cab  é", max_size=400), st.integers(70, 120))
def test_answers_are_cut_byte_for_byte(spark, answer, longest):
    df = spark.createDataFrame([("u", answer * 3)], "user string, answer string")
    got = chunk.answer_parts(df, longest).orderBy("part_no").collect()
    assert "".join(r["answer"] for r in got) == answer * 3


def test_last_steps_of_the_cascade(spark):
    cases = {
        "<script>window.redid = 77;</script>": 77,
        "<script>window.rdk=5</script><script>var redid = 9</script>": 5,
        "<script>const  redid =\n 12;</script>": 12,
        "<script>let rdk = 12;</script>": None,
        "<script>window.redid = 77; redid: 5000</script>": 5000,
        "window.redid = 77": None,
        "<script>VAR  RDK = 3</script>": 3,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", html.redid(F.col("p")).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == cases


@pytest.mark.parametrize("name", ["example_split", "redid_cascade", "chunk_ids_of_repeats", "chunk_documents", "article_index", "argmax_dedupe"])
def test_sql(spark, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)
