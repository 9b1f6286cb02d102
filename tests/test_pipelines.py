import gzip
import json
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import text as X
from loam.__main__ import main
from loam.operators import chunk, dedup, messages, profile, quality, split, vector
from loam.plans import catalogue, pipelines
from loam.sources import readers, sinks
from loam.streaming import stateless
from tests.conftest import SF


def good(i):
    return {"case": f"Вопрос номер {i} о праве", "article": f"Статья {i % 5}. Ответ номер {i} на этот вопрос, достаточно длинный."}


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    forms = [good(1), [{"role": "user", "content": "Что такое договор аренды?"}, {"role": "assistant", "content": "Это соглашение сторон."}], {"messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "x"}]}, {"title": "Статья 7. Имя", "content": "Статья 7. Имя и текст статьи."}, 5]
    (folder / "actual_gk_1.json").write_text(json.dumps(forms + [good(i) for i in range(30)], ensure_ascii=False))
    (folder / "gk_rf_bad.json").write_text("[{")
    (folder / ".hidden_gk_rf.json").write_text("[]")
    (folder / "actual_jk_1.json").write_text(json.dumps([good(1)]))
    (folder / "koap.json").write_text(json.dumps(good(3), ensure_ascii=False))
    return folder


def test_ingest(spark, raw):
    rows = {r["source_id"]: r for r in readers.raw_directory(spark, str(raw)).collect()}
    assert len(rows) == 35
    assert rows["actual_gk_1_1"]["is_messages_format"] and rows["actual_gk_1_1"]["raw_case"] == "Что такое договор аренды?"
    assert rows["actual_gk_1_3"]["raw_case"] == "Какая статья из GK кодекс РФ регулирует: . Имя"
    assert rows["koap_0"]["code"] == "koap" and rows["koap_0"]["group_id"] == "koap_3"
    assert "actual_gk_1_4" not in rows


def test_preprocess(spark, raw, tmp_path):
    parts = pipelines.preprocess(spark, str(raw), str(tmp_path / "out"))
    assert split.overlapping(parts, "group_id").count() == 0
    report = spark.read.json(str(tmp_path / "out/report")).first()
    assert report["initial_count"] == 35 and report["after_dedup"] == parts.count()
    assert report["total_removed"] == 35 - parts.count()
    assert spark.read.json(str(tmp_path / "out/train")).columns == ["messages"]


def test_health(spark, tmp_path):
    a = {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y <b>"}]}
    b = {"messages": [{"role": "user", "content": "z"}]}
    (tmp_path / "train.jsonl").write_text("\n".join(map(json.dumps, [a, a, b])) + "\n\nbroken\n")
    (tmp_path / "test.jsonl").write_text(json.dumps([a, {"messages": []}]))
    got = {r["dataset"]: r for r in pipelines.health(spark, {"train": str(tmp_path / "train.jsonl"), "test": str(tmp_path / "test.jsonl")}).collect()}
    assert (got["train"]["total_records"], got["train"]["valid_records"], got["train"]["internal_duplicates"], got["train"]["noise_count"]) == (3, 2, 1, 2)
    assert (got["test"]["bad_format"], got["test"]["leakage_count"]) == (1, 1)


def test_strict_reader(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"messages": [{"role": "user", "content": "x"}]}\n# note\n\n')
    assert readers.training_records(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "b.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="no JSON object"):
        readers.training_records(spark, str(tmp_path / "b.jsonl")).collect()


@pytest.mark.parametrize(("length", "starts"), [(199, []), (200, [0]), (2500, [0]), (2501, [0, 2100]), (4600, [0, 2100]), (4601, [0, 2100, 4200]), (9000, [0, 2100, 4200, 6300, 8400])])
def test_chunk_starts(spark, length, starts):
    df = spark.createDataFrame([(1, "x" * length)], "id int, t string")
    assert [r["chunk_start"] for r in chunk.chunks(df, "t").orderBy("chunk_no").collect()] == starts


def test_near_dedup_is_greedy(spark):
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(120):
        w = base[: rng.choice([21, 30, 40])]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = [*w[1:], f"v{rng.randrange(6)}"]
        rng.shuffle(w)
        texts.append(" ".join(w))
    kept, wanted = [], {}
    for i, t in enumerate(texts):
        s = set(t.split())
        wanted[i] = any(20 * len(s & k) > 19 * len(s | k) for k in kept) or any(s == set(x.split()) for x in texts[:i])
        if not wanted[i]:
            kept.append(s)
    got = dedup.near(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), F.col("t"), "i")
    assert {r["i"]: r["is_dup"] for r in got.collect()} == wanted


def replay(groups, train, val, seed):
    """The deal, group by group, from counts recounted each time; groups: (name, code)."""
    queue = sorted(groups, key=lambda g: (md5(f"{seed}:{g[0]}".encode()).hexdigest(), g[0]))
    n, goal = len(queue), int(len(queue) * train)
    most = {"val": (n - goal) // 2, "test": n - goal - (n - goal) // 2}
    out = {"train": [], "val": [], "test": []}
    for name, code in queue:
        of_code = {k: sum(c == code for _, c in v) for k, v in out.items()}
        total = sum(of_code.values())
        share = {k: of_code[k] / total if total else 0.0 for k in of_code}
        room = {k: len(out[k]) < most[k] for k in most}
        if len(out["train"]) < goal and (share["train"] < train or not (room["val"] or room["test"])):
            to = "train"
        else:
            to = "val" if room["val"] and (share["val"] < val or not room["test"]) else "test"
        out[to].append((name, code))
    if abs(len(out["val"]) - len(out["test"])) > 2:
        small, large = sorted(("test", "val"), key=lambda k: len(out[k]))
        k = len(out["val"]) - (len(out["val"]) + len(out["test"])) // 2
        k = k if large == "val" else -k
        out[small] += out[large][:k]
        del out[large][:k]
    return {name: part for part, rows in out.items() for name, _ in rows}


@pytest.mark.parametrize(("n", "codes", "train", "val"), [(13, 1, 0.8, 0.1), (57, 3, 0.8, 0.1), (200, 9, 0.5, 0.3), (41, 2, 0.9, 0.0), (1, 1, 0.8, 0.1)])
def test_stratified(spark, n, codes, train, val):
    rows = [(i, f"g{i % n}", f"c{(i % n) ** 2 % codes}") for i in range(2 * n)]
    got = split.stratified(spark.createDataFrame(rows, "i int, g string, c string"), "g", "c", "i", train, val, 7)
    assert {r["g"]: r["split"] for r in got.collect()} == replay([(f"g{i}", f"c{i ** 2 % codes}") for i in range(n)], train, val, 7)


def test_stratified_documents(spark):
    got = catalogue.queries()["split_stratified"](spark, SF).collect()
    rows = catalogue.by_group(spark, SF).collect()
    groups = {r["group_id"]: r["lang"] for r in rows}
    assert {r["doc_id"]: r["split"] for r in got} == (lambda part: {r["doc_id"]: part[r["group_id"]] for r in rows})(replay(groups.items(), 0.8, 0.1, 42))


def test_near_dedup_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words), (1, words), (1, words + " "), (2, words + " x"), (3, None), (3, None), (4, ""), (5, "   "), (6, words), (7, "a"), (8, "A"), (9, "a a")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "i int, t string, lead string")
    got = [(r["i"], r["is_dup"]) for r in dedup.near(df, F.lower("t"), "i").collect()]
    assert sorted(got) == [(1, False), (1, False), (1, False), (2, True), (3, False), (3, False), (4, False), (5, False), (6, True), (7, False), (8, True), (9, True)]
    assert dedup.near(df.limit(0), F.col("t"), "i").count() == 0
    some = dedup.near(df, F.lower("t"), "i", F.col("i") > 5).filter("is_dup").collect()
    assert sorted(r["i"] for r in some) == [8, 9]


def test_exact_dedup_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "z"), (3, None, "n"), (4, None, "n"), (5, "null", "n"), (6, "=a", "n")], "i int, t string, _first string")
    assert sorted((r["i"], r["is_dup"]) for r in dedup.exact(df, F.col("t"), "i").collect()) == [(1, False), (1, False), (2, True), (3, False), (4, True), (5, False), (6, False)]
    assert sorted(r["i"] for r in dedup.exact(df, F.col("t"), "i", F.col("i") != 1).filter("is_dup").collect()) == [4]


@pytest.mark.parametrize("n", [5, 9, 400, 1003])
def test_tail(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % n).alias("i")).repartition(5)
    size = min(max(4, int(n * 0.05)), n - 4)
    got = {r["i"] for r in split.tail(df, "i").filter("split = 'valid'").collect()}
    assert got == set(sorted({r["i"] for r in df.collect()})[-size:])
    with pytest.raises(ValueError, match="too few"):
        split.tail(df.limit(4), "i")


def test_ratios():
    with pytest.raises(ValueError):
        split.check_ratios(0.5, 0.1, 0.1)


def test_quality(spark):
    told = "Срок давности составляет три года."
    rows = [("fine", "Каков срок давности?", told), ("mute", None, told), ("brief", "  где ", told), ("yes", "Каков срок давности?", "Да, три"), ("both", "?", "!"), ("edge", "ab c" * 10_000, "z y" * 3_333 + "."), ("long", "ab c" * 10_000, "z y" * 3_333 + ".."), ("shout", "Каков срок давности?", "Три годааааа, не два."), ("cut", "Каков срок давности?", "слово " * 30), ("open", "Каков срок давности?", "слово " * 30 + "конец;")]
    df = spark.createDataFrame(rows, "k string, u string, a string")
    m = F.array(messages.message("user", F.col("u")), messages.message("assistant", F.col("a")))
    assert {r["k"]: r["r"] for r in df.select("k", quality.reason(m).alias("r")).collect()} == {"fine": None, "mute": "user_too_short", "brief": "user_too_short", "yes": "assistant_too_short", "both": "user_too_short", "edge": None, "long": "too_long", "shout": "repetitive_chars", "cut": "truncated", "open": None}


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [{"messages": [{"role": "user", "content": "Хороший вопрос"}, {"role": "assistant", "content": "Срок исковой давности равен трём годам"}]}, {"messages": [{"role": "user", "content": "К"}]}]
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    q = stateless.follow(spark, str(folder), f"messages {messages.MESSAGES}", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_unescape(spark):
    assert spark.range(1).select(X.unescape(F.lit('a\\"b\\nc')).alias("x")).first()["x"] == 'a"b\nc'


def test_qa_and_labels(spark, tmp_path):
    (tmp_path / "tk.json").write_text(json.dumps([{"title": "Статья 3. Запрет дискриминации в сфере труда и не только", "content": "Статья 3. Запрет дискриминации в сфере труда и не только. Каждый имеет равные права."}], ensure_ascii=False))
    got = pipelines.qa_dataset(spark, {str(tmp_path / "tk.json"): "Трудового кодекса", str(tmp_path / "no.json"): "x"}, str(tmp_path / "out")).first()["messages"]
    assert got[0]["content"] == "Какая статья из Трудового кодекса регулирует: Запрет дискриминации в сфере труда и"
    assert got[1]["content"] == "Статья 3. Запрет дискриминации в сфере труда и не только Каждый имеет равные права."
    rows = spark.createDataFrame([("Статья 5 ГК РФ", "x"), (None, "Статья 7 УК")], "article string, title string")
    assert {r["title"]: r["law_code"] for r in pipelines.labelled(rows).collect()} == {"x": "ГК", "Статья 7 УК": "УК"}


def test_page_pairs(spark, tmp_path):
    body = "Текст статьи закона. " * 15
    page = "".join(f'<p id="p{i}">Статья {i}. {body}{i}</p><p id="q{i}">Конец {i}.</p>' for i in range(12))
    nodes = [(f"n{i:02}", f"p{i}", f"q{i}", f"Статья {i}", "статья", 3) for i in range(12)] + [("n99", None, None, "Глава", "глава", 1)]
    df = spark.createDataFrame([("gk", "h", page, nodes), ("gk", "i", page, nodes)], "code string, doc_hash string, html string, nodes array<struct<id:string,np:string,npe:string,caption:string,unit:string,lvl:int>>")
    got = pipelines.page_pairs(df, str(tmp_path / "out")).collect()
    assert len(got) == 12 and sum(r["split"] == "test" for r in got) == 1
    assert all(r["case"] == r["article"] and "Конец" in r["article"] for r in got)
    assert spark.read.json(str(tmp_path / "out")).filter("code = 'gk' and split = 'train'").count() == 11


def test_page_pairs_of_one_url(spark):
    """Pages that share a url are told apart by their text, not by the order of rows."""
    rows = [("gk", "h", f'<p id="p">Статья {i}. {"Текст статьи закона. " * 15}</p><p id="q">Конец.</p>', [("n", "p", "q", "x", "статья", 3)]) for i in range(40)]
    kind = "code string, doc_hash string, html string, nodes array<struct<id:string,np:string,npe:string,caption:string,unit:string,lvl:int>>"
    got = [sorted((r["case"], r["split"]) for r in pipelines.page_pairs(spark.createDataFrame(x, kind), most=10).collect()) for x in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 10


def test_lines(spark, tmp_path):
    a, b = {"x": 1}, {"x": "[2"}
    (tmp_path / "a.jsonl").write_text("\ufeff" + json.dumps(a) + "\n\nbroken\n" + json.dumps(b) + "\n")
    (tmp_path / "b.json").write_text(" \n[" + json.dumps(a) + ",\n " + json.dumps(b) + "]")
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(json.dumps(b) + "\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "odd name%20.jsonl").write_text(json.dumps(a))
    got = sorted(json.dumps(json.loads(r["item"])) for r in readers.lines(spark, str(tmp_path)).collect())
    assert got == sorted(map(json.dumps, [a, b, a, b, b, a]))
    assert readers.lines(spark, str(tmp_path / "none")).count() == 0


def test_training_forms(spark, tmp_path):
    chat = {"messages": [{"role": "user", "content": " вопрос "}, {"role": "assistant", "content": "слово " * 400}]}
    old = {"instruction": "Скажи", "input": "кто", "output": "Никто"}
    rows = [chat, old, {"messages": []}, {"messages": [{"role": "assistant", "content": "x"}]}]
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for name in ("a.jsonl.gz", "a.json"):
        told = {}
        for how in ("keep", "drop", "chunk"):
            made, counts = pipelines.training_set(spark, str(tmp_path / name), 150, how)
            told[how] = (made.count(), *counts.first())
        assert told == {"keep": (2, 2, 1, 0, 0), "drop": (1, 2, 1, 1, 0), "chunk": (4, 2, 1, 0, 1)}
        made = pipelines.training_set(spark, str(tmp_path / name), 150)[0]
        assert "".join(r["messages"][-1]["content"] + " " for r in made.filter("text like '%слово%'").collect()).count("слово") == 400
        assert made.filter("text like '%кто%'").first()["text"] == "<s>[INST] Скажи\n\nкто [/INST] Никто</s>"
        chatml = pipelines.training_set(spark, str(tmp_path / name), 150, "drop", render=messages.chat_text)[0].first()["text"]
        assert chatml == "<|im_start|>user\nСкажи\n\nкто<|im_end|>\n<|im_start|>assistant\nНикто<|im_end|>\n"
    with pytest.raises(ValueError, match="overlong"):
        pipelines.training_set(spark, str(tmp_path / "a.json"), 150, "cut")


def article(i, words=600):
    return {"url": f"https://h/law/{'gk' if i % 2 else 'tk'}/{i}", "title": f"Статья {i}", "content": f"тема{i} " * words}


def test_retrieval(spark, tmp_path):
    source, index = str(tmp_path / "a.json"), str(tmp_path / "index")
    (tmp_path / "a.json").write_text(json.dumps([*(article(i) for i in range(6)), article(9, 3)], ensure_ascii=False))
    assert {r["url"] for r in readers.articles(spark, source).collect()} == {article(i)["url"] for i in [*range(6), 9]}
    assert pipelines.build_retrieval(spark, source, index, vector.hashed) == {"articles": 7, "too_short": 1, "chunks": 12}
    got = pipelines.ask(spark, index, "тема4", vector.hashed, 3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["article_title"] == "Статья 4" and got[0]["legal_code"] == "LAW"
    assert [r["distance"] for r in got] == sorted(r["distance"] for r in got) and abs(got[0]["similarity"] + got[0]["distance"] - 1) < 1e-12
    assert pipelines.ask(spark, index, "тема4", vector.hashed, 50).count() == 12
    assert pipelines.ask(spark, index, "тема4", vector.hashed, 5, "no").count() == 0
    for blank in ("", "  "):
        assert pipelines.ask(spark, index, blank, vector.hashed).count() == 0
    (tmp_path / "b.json").write_text(json.dumps([article(7)], ensure_ascii=False))
    assert pipelines.build_retrieval(spark, str(tmp_path / "b.json"), index, vector.hashed)["chunks"] == 2  # replaces the old index


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(2 + i % 2).tolist()) for i in range(200)] + [(500, None), (501, [0.0, 0.0]), (502, [float("nan"), 1.0]), (503, []), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0] * 9)]
    got = vector.knn(df, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 4).collect()
    for q, v in asked:
        fits = [(i, np.array(x)) for i, x in rows if v and x and len(x) == len(v) and np.isfinite(x).all() and np.any(x) and np.any(v)]
        wanted = sorted((round(1 - float(np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x)), 12), i) for i, x in fits)[:4]
        assert [(round(r["distance"], 12), r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == wanted


def test_knn_tiles(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = e.select(F.col("vec_id").alias("query_id"), "embedding").limit(9)
    whole = sorted(map(tuple, vector.knn(e, queries).select("query_id", "vec_id", "rank").collect()))
    monkeypatch.setattr(vector, "COMPONENTS", 150)
    assert sorted(map(tuple, vector.knn(e, queries).select("query_id", "vec_id", "rank").collect())) == whole


def test_commands(spark, tmp_path, caplog):
    caplog.set_level("INFO")
    assert main(["lengths", "--dataset", str(tmp_path / "no.jsonl")]) == 0 and "No such file" in caplog.text
    (tmp_path / "a.jsonl").write_text(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "12345"}]}) + "\n")
    main(["lengths", "--dataset", str(tmp_path / "a.jsonl")])
    assert "Mean length: 5" in caplog.text
    (tmp_path / "e.jsonl").write_text(json.dumps({"messages": []}) + "\n")
    main(["lengths", "--dataset", str(tmp_path / "e.jsonl")])
    assert "No record with messages" in caplog.text
    assert main(["index"]) == 0 and "--build" in caplog.text
    (tmp_path / "a.json").write_text(json.dumps([article(i) for i in range(3)], ensure_ascii=False))
    main(["index", "--build", "--query", "тема2", "--articles", str(tmp_path / "a.json"), "--db_path", str(tmp_path / "i")])
    assert "1. Статья 2" in caplog.text
    (tmp_path / "l.json").write_text(json.dumps([{"article": "Статья 5 ГК РФ", "n": 1}, {"article_title": "Статья 2 УК РФ"}], ensure_ascii=False))
    main(["label", "--input", str(tmp_path / "l.json"), "--output", str(tmp_path / "labels")])
    assert {r["law_code"] for r in spark.read.json(str(tmp_path / "labels")).collect()} == {"ГК", "УК"}
    main(["qa", "--file", f"{tmp_path / 'a.json'}=ТК", "--output", str(tmp_path / "qa")])
    assert spark.read.json(str(tmp_path / "qa")).count() == 3
    main(["records", "--data", str(tmp_path / "a.jsonl"), "--output", str(tmp_path / "r")])
    assert spark.read.json(str(tmp_path / "r")).columns == ["messages"]
    main(["health", "--train", str(tmp_path / "a.jsonl"), "--test", str(tmp_path / "a.jsonl"), "--report-name", str(tmp_path / "h")])
    told = spark.read.json(str(tmp_path / "h")).first()["datasets"].asDict(recursive=True)
    assert told["test"]["leakage_count"] == 1 and told["train"]["leakage_count"] == 0


def test_sinks(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("train", "b"), ("train", "a"), ("train", "a"), ("val", "c")], "split string, g string")
    sinks.split_manifest(df, "g", 42, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"seed": 42, "train_groups": ["a", "b"], "val_groups": ["c"], "test_groups": []}
    monkeypatch.setattr(sinks, "GROUPS", 2)
    sinks.split_manifest(df, "g", 42, str(tmp_path / "m"))
    assert sorted((r["split"], r["group"], r["seed"]) for r in spark.read.json(str(tmp_path / "m")).collect()) == [("train", "a", 42), ("train", "b", 42), ("val", "c", 42)]
    tagged = spark.createDataFrame([("gk", "gk_1", None), ("gk", "gk_1", "short"), ("gk", "gk_2", "short"), ("gk", "gk_2", "long")], "code string, group_id string, reason string")
    assert [tuple(r) for r in profile.reason_histogram(tagged).collect()] == [("short", 2), ("long", 1)]
    sinks.code_report(profile.code_counts(tagged), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first().asDict() == {"code": "gk", "records": 4, "groups": 2, "kept_records": 1, "kept_groups": 1}
    assert not sinks.jsonl(spark.createDataFrame([], f"messages {messages.MESSAGES}"), str(tmp_path / "j")) and not (tmp_path / "j").exists()


def test_page_queries(spark):
    """Links, titles and texts of the table's pages, from regular expressions instead of a parser."""
    import html as entities
    import re

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    wanted = sorted((r["url"], entities.unescape(m)) for r in pages.values() for m in re.findall(r"<a\b[^>]*?href=[\"']([^\"']*)[\"']", r["html"] or ""))
    assert sorted((r["url"], r["href"]) for r in catalogue.queries()["page_links"](spark, SF).collect()) == wanted
    told = {r["page_id"]: r["text"] for r in catalogue.queries()["fragment_to_text"](spark, SF).collect()}
    letters = lambda t: re.sub(r"\W+", "", t)
    for i, r in pages.items():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", r["html"] or "")
        assert letters(entities.unescape(bare)) == letters(told[i])
