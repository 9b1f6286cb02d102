"""Arrays read by byte ranges, against whole-file parsing."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from loam.plans import catalogue_files
from loam.sources import arrays, readers

TRICKY = ['a,b', 'x]y[', '{"k": [1,2]}', "quote \" and \\", "ends with \\\\", "\\\",\\\"", "a\nb,\tc", "", "ü,😀", "]", "},{"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(TRICKY) * rng.randrange(1, 4)
    if kind == 1:
        return rng.randrange(1000)
    if kind == 2:
        return rng.choice([None, True, 1.5])
    if kind == 3:
        return "".join(rng.choice('ab,"\\{}[] ') for _ in range(rng.randrange(60)))
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["a", "b,c", 'q"', "messages"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("bytes_", [23, 300, 1 << 20])
def test_elements_of_any_ranges(spark, tmp_path, small_ranges, bytes_):
    rng, expected = random.Random(bytes_), {}
    n = 3 if bytes_ < 50 else 40
    for k, indent in enumerate((None, 2, "\t", None)):
        items = [value(rng) for _ in range(n)]
        expected[f"f{k}.json"] = items
        text = json.dumps(items, indent=indent, ensure_ascii=bool(k % 2), separators=(",", ":") if k == 3 else None)
        (tmp_path / f"f{k}.json").write_text(("﻿" if k == 1 else " \n") + text + "\n" * k, encoding="utf-8")
    expected |= {"empty.json": [], "one.json": [{"a": "x,]y", "b": [1, 2]}], "blank.json": []}
    (tmp_path / "empty.json").write_text("[ ]")
    (tmp_path / "one.json").write_text('{"a": "x,]y",\n "b": [1, 2]}\n')
    (tmp_path / "blank.json").write_text("")
    small_ranges(bytes_)
    got = {}
    for r in arrays.elements(spark, str(tmp_path), "*.json").collect():
        got.setdefault(r["file_name"], {})[r["item_idx"]] = json.loads(r["item"])
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v for k, v in expected.items() if v}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    items = [{"i": i, "t": "слово, " * (i % 300)} for i in range(20_000)]
    (tmp_path / "actual_gk.json").write_text(json.dumps(items, ensure_ascii=False), encoding="utf-8")
    size = (tmp_path / "actual_gk.json").stat().st_size
    small_ranges(1 << 20)
    source = arrays.records(spark, str(tmp_path))
    assert source.rdd.getNumPartitions() >= size >> 20 >= 20
    got = arrays.elements(spark, str(tmp_path)).select("item_idx", F.expr("variant_get(parse_json(item), '$.i', 'int')").alias("i"), F.length("item").alias("n"))
    assert got.filter("i <> item_idx").count() == 0
    assert got.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()[:] == (20_000, sum(len(json.dumps(x, ensure_ascii=False)) for x in items))


def test_ranges_that_set_the_state(spark, tmp_path, small_ranges):
    """Escaped quotes outside of what a range knows: both beginnings may end alike."""
    items = ['\\"' * 40, "a" * 30, '"' * 41, {"k": '\\' * 33 + '",'}] * 20
    (tmp_path / "x.json").write_text(json.dumps(items))
    for n in (97, 350):
        small_ranges(n)
        got = sorted((r["item_idx"], json.loads(r["item"])) for r in arrays.elements(spark, str(tmp_path)).collect())
        assert [x for _, x in got] == items


def test_broken_elements_go_alone(spark, tmp_path):
    (tmp_path / "actual_gk.json").write_text('[{"case": "a", "article": "b"}, {"case" "x"}, nope, , {"case": "c", "article": "d"}')
    got = readers.items(spark, str(tmp_path)).collect()
    assert sorted((r["item_idx"], json.loads(r["item"])["case"]) for r in got) == [(0, "a"), (4, "c")]
    with pytest.raises(Exception, match="broken array"):
        arrays.elements(spark, str(tmp_path), strict=True).collect()


def test_kinds_of_files_are_told_by_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a b%20.json").write_text('\n  [{"messages": [{"role": "user", "content": "1, 2"}]}]')
    (tmp_path / "b.jsonl").write_text('﻿{"messages": [{"role": "user", "content": "x]"}]}\n\n{"messages": []}\n')
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('[{"messages": null},\n{"messages": [{"role": "user", "content": "z"}]}]')
    (tmp_path / "d.jsonl").write_text("\n \n")
    got = readers.training_records(spark, str(tmp_path)).collect()
    assert sorted((r["messages"][0]["content"] if r["messages"] else "") for r in got) == ["", "", "1, 2", "x]", "z"]
    assert readers.lines(spark, str(tmp_path / "b.jsonl")).count() == 2
    assert readers.lines(spark, str(tmp_path / "missing")).count() == 0


def test_array_files_are_few_and_whole(spark, tmp_path):
    """A task's rows go to files of bounded length, each of which is one array."""
    n = 2 * (catalogue_files.LINES - 1) + 5
    rows = spark.range(n, numPartitions=1)
    catalogue_files.array_files(rows, F.to_json(F.struct("id")), str(tmp_path / "a"))
    files = sorted((tmp_path / "a").glob("part-*"))
    got = [[x["id"] for x in json.loads(f.read_text())] for f in files]
    assert [len(x) for x in got] == [catalogue_files.LINES - 1] * 2 + [5] and sum(got, []) == list(range(n))
