"""Fitted embeddings against a dense decomposition, and versions of an index under readers and writers."""

import threading
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.operators import embedding, snapshots, vector
from loam.plans import catalogue, pipelines
from tests.conftest import SF
from tests.helpers import same


def texts_of(rng, n, topics=6):
    names = [[f"t{t}w{i}" for i in range(12)] for t in range(topics)]
    return [" ".join(rng.choice(names[i % topics], size=30)) + (" common words" if i % 2 else "") for i in range(n)]


def dense(spark, rows, buckets):
    """The TF-IDF matrix, row by row."""
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, document string").select("i", embedding.buckets_of(F.col("document"), buckets).alias("b")).orderBy("i").collect()
    counts = np.zeros((len(rows), buckets))
    for r in got:
        for b in r["b"]:
            counts[r["i"], b] += 1
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    a = np.where(counts > 0, (1 + np.log(np.maximum(counts, 1))) * idf, 0)
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


def test_fitted_equals_dense_svd(spark):
    rng = np.random.default_rng(1)
    rows = [*texts_of(rng, 240), "", None, "common"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, document string").repartition(5)
    model = embedding.fit(df, dim=6, buckets=256)
    a = dense(spark, rows, 256)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.values, s[:6], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(model.directions * vt[:6].T, axis=0)), 1, atol=1e-4), "the same directions, but for signs"
    y = a @ vt[:6].T
    expected = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    got = {r["i"]: r["embedding"] for r in model.embed(df).collect()}
    assert got[240] is None and got[241] is None
    have = np.array([got[i] for i in range(240)])
    assert np.allclose(have @ have.T, expected[:240] @ expected[:240].T, atol=1e-5)


def test_fitted_on_few_words_and_nothing(spark):
    df = spark.createDataFrame([("a a b",), ("a",), (None,)], "document string")
    model = embedding.fit(df, dim=8, buckets=64)
    assert [len(r["embedding"]) if r["embedding"] else 0 for r in model.embed(df).collect()] == [8, 8, 0]
    empty = embedding.fit(df.limit(0), dim=4, buckets=16)
    assert all(r["embedding"] is None for r in empty.embed(df).collect())


def test_model_is_saved_as_it_is(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in texts_of(np.random.default_rng(2), 50)], "document string")
    model = embedding.fit(df, dim=5, buckets=128)
    model.save(spark, str(tmp_path / "m"))
    again = embedding.load(spark, str(tmp_path / "m"))
    assert all(np.array_equal(x, y) for x, y in zip((model.idf, model.directions, model.values), (again.idf, again.directions, again.values)))


def write_rows(spark, n, value):
    return lambda folder: spark.range(n).withColumn("v", F.lit(value)).write.parquet(folder)


def test_readers_see_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "x")
    assert snapshots.current(spark, path) is None
    first = snapshots.publish(spark, path, write_rows(spark, 10, 1))
    opened = spark.read.parquet(snapshots.current(spark, path))

    def slow(folder):
        write_rows(spark, 20, 2)(folder)
        assert snapshots.current(spark, path) == first, "not before all is written"
        assert opened.filter("v = 1").count() == 10

    second = snapshots.publish(spark, path, slow)
    assert snapshots.current(spark, path) == second
    assert opened.count() == 10, "a reader that has begun goes on"
    snapshots.publish(spark, path, write_rows(spark, 30, 3))
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 30
    assert len(list((tmp_path / "x" / "versions").iterdir())) == 2 and not (tmp_path / "x" / first.split("/x/")[1]).exists()


def test_failed_writes_leave_the_old_version(spark, tmp_path):
    path = str(tmp_path / "x")
    first = snapshots.publish(spark, path, write_rows(spark, 1, 1))

    def fails(folder):
        write_rows(spark, 1, 2)(folder)
        raise ValueError("no")

    with pytest.raises(ValueError):
        snapshots.publish(spark, path, fails)
    assert snapshots.current(spark, path) == first and len(list((tmp_path / "x" / "versions").iterdir())) == 1


def test_of_two_writers_one_wins(spark, tmp_path):
    path, met, out = str(tmp_path / "x"), threading.Barrier(2), []

    def run(value):
        def write(folder):
            write_rows(spark, 5, value)(folder)
            met.wait(60)

        try:
            out.append(snapshots.publish(spark, path, write))
        except snapshots.Conflict as e:
            out.append(e)

    threads = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(isinstance(x, snapshots.Conflict) for x in out) == [False, True]
    assert snapshots.current(spark, path) == next(x for x in out if isinstance(x, str))
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 5


def test_an_index_with_its_own_embedding(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(f"https://h/{'gk' if i % 2 else 'tk'}/{i}", f"T{i}", t) for i, t in enumerate(t + " " + t for t in texts_of(rng, 60))]
    articles = str(tmp_path / "a.json")
    import json

    (tmp_path / "a.json").write_text(json.dumps([dict(zip(("url", "title", "content"), r)) for r in rows] + [{"url": "u", "title": "t", "content": "short"}]))
    none = pipelines.build_retrieval(spark, str(tmp_path / "a.json"), str(tmp_path / "e"), lambda df: vector.hashed(df.limit(0)))
    assert none["chunks"] == 0 and pipelines.ask(spark, str(tmp_path / "e"), "t3w1", vector.hashed).count() == 0
    got = pipelines.build_retrieval(spark, articles, str(tmp_path / "i"), "fitted")
    assert got == {"articles": 61, "too_short": 1, "chunks": 60}
    found = pipelines.ask(spark, str(tmp_path / "i"), "t3w1 t3w2 t3w5", vector.hashed, 5).collect()
    assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all("t3w" in r["text"] for r in found)
    assert pipelines.ask(spark, str(tmp_path / "i"), "t3w1", vector.hashed, 5, "GK").filter("legal_code <> 'GK'").count() == 0
    with pytest.raises(FileNotFoundError):
        vector.open_index(spark, str(tmp_path / "none"))


def test_sql(spark):
    same(catalogue.queries()["index_round_trip"](spark, SF), catalogue.oracle_sql()["index_round_trip"], SF)


def test_hashed_vectors_take_no_more_than_their_matrix():
    texts = pa.array([f"слово{i} word{i % 7} x" for i in range(4000)] + [None, " "])
    tracemalloc.start()
    got = vector.hashed_batch(texts, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4002 and got[4000].as_py() is None and got[4001].as_py() is None
    assert np.isclose(np.linalg.norm(got[0].as_py()), 1)
    assert peak < 1.5 * 4002 * 256 * 8


def test_blocks_hold_few_words():
    rows = [[1] * 50_000, [], None, [2] * 200_000, *([[3, 4]] * 100_000)]
    got = [(first, n.copy(), flat) for first, n, flat in embedding.blocks(pa.array(rows, pa.list_(pa.int32())).slice(1))]
    assert [first for first, _, _ in got] == list(np.cumsum([0, *(len(n) for _, n, _ in got)])[:-1])
    assert all(n.sum() == len(flat) and (len(flat) <= embedding.WORDS or len(n) == 1) for _, n, flat in got)
    assert np.array_equal(np.concatenate([flat for _, _, flat in got]), [2] * 200_000 + [3, 4] * 100_000)


def test_blocks_are_multiplied_in_one_small_matrix():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 64, n).tolist() for n in (*range(300), 70_000)]
    idf, wanted = rng.random(64) + 1, np.zeros((301, 64))
    for i, row in enumerate(rows):
        n = np.bincount(np.array(row, int), minlength=64)
        wanted[i] = np.where(n > 0, (1 + np.log(np.maximum(n, 1))) * idf, 0)
        wanted[i] /= np.linalg.norm(wanted[i]) or 1
    got = [(first, m.base, m.copy()) for first, m in embedding.filled(pa.array(rows, pa.list_(pa.int32())), idf)]
    assert len({id(base) for _, base, _ in got}) == 1 and len(got[0][1]) == embedding.ROWS
    assert [first for first, _, _ in got] == list(np.cumsum([0, *(len(m) for _, _, m in got)])[:-1])
    assert np.allclose(np.concatenate([m for _, _, m in got]), wanted, atol=1e-12)
