"""Each operator against a plain version, on odd rows: nulls, empty and long texts, repeated rows, ties, empty tables, clashing names."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm import bpe, encoding, imatch, langid, neardup_vectors, ngram_join, packing, sharding, tokenfile, toxicity, urlrep
from loam.llm import queries as llm
from loam.llm.common import lowest, ship
from loam.llm.components import components
from loam.llm.encoding import Encoder
from tests.conftest import SF
from tests.helpers import same

DOCS = "doc_id long, text string, extra string, length long, score double"
ODD = [None, "", " ", "\n", "a", "a  b", "a \nb", "a\n b", "x <|endoftext|> y", "don't won't", "é ü ß 😀 日本語", "12 34  5", "\t x", "x\x1c y", "a" * 3000, "word " * 3000, "== == ==", "a,b. c.", "A" * 20 + " " + "b" * 20]


def frame(spark, texts, ids=None):
    ship(spark)
    rows = [(i if ids is None else ids[i], t, "e", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def library():
    return Encoder().tokenizer


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", ",", ".", ""]) for _ in range(n))


# 1


def test_token_files(spark, tmp_path, library):
    texts = [*ODD, *ODD[:3]]
    docs = frame(spark, texts, [7, None, *range(100, 100 + len(texts) - 2)]).repartition(3)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs, path, partitions=3)
    got = tokenfile.digest(spark, path).collect()
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = 0
    for r in sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        ids = [*ids_of(library, known[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (before, len(ids), crc(ids))
        before += len(ids)
    assert len(got) == len(texts)
    some = tokenfile.read_tokens(spark, path, ("doc_id", "n_tokens"), F.col("doc_id") == 7)
    assert some.count() == 1 and "array" not in some._jdf.queryExecution().toString().split("ReadSchema")[-1]


def test_token_file_format(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    tokenfile.write_tokens(frame(spark, ["a b c d"] * 500), str(path), partitions=1)
    meta = pq.ParquetFile(next(path.glob("*.parquet"))).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = next(c for n, c in columns.items() if n.startswith("tokens"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert tokens.has_column_index or tokens.has_offset_index


def test_no_documents(spark, tmp_path):
    empty = frame(spark, [])
    tokenfile.write_tokens(empty, str(tmp_path / "t"))
    assert tokenfile.digest(spark, str(tmp_path / "t")).count() == 0
    assert langid.predict(empty, langid.fit(empty.withColumn("lang", F.lit("x"))), ["doc_id"]).count() == 0
    assert imatch.with_next(empty.select("doc_id", "text"), imatch.lexicon(empty)).count() == 0
    assert ngram_join.join(empty).count() == 0
    assert bpe.digests(empty).count() == 0
    assert sharding.shard_rows(empty.select("doc_id"), 16).count() == 0
    assert packing.pack(packing.cut_documents(empty)).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    assert neardup_vectors.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert urlrep.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_encoder_equals_library(library):
    """Texts of odd characters, and units remembered, forgotten and learned again."""
    rng = random.Random(5)
    odd = ["a", "b", "Z", "é", "ß", "×", "÷", "ÿ", "ŉ", "ſ", "ƀ", "1", "2", "٣", "½", "²", *" " * 6, *"\n" * 3, "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "'", "'s", "'ll", *".,-_$", "\u0301", "日本", "Жд", "😀", "<|endoftext|>", "<|", "\u200b", "’", "—", "\x00", "\x7f"]
    own = Encoder()
    for turn in range(30):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, ""]
        ids, at = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(library, t) for t in texts]
        if turn % 7 == 6:
            own.keep(50)


def test_unit_keys_that_collide(library, monkeypatch):
    """Units whose first hash is equal are told apart by the second; a piece with two of them is encoded as it is."""
    real = encoding.marks
    monkeypatch.setattr(encoding, "marks", lambda units: (real(units)[0] % np.uint64(3), real(units)[1]))
    ids, at = Encoder().encode(pa.array(["one two three", "four five"]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(library, t) for t in ("one two three", "four five")]


def test_equal_rows_are_split(spark, tmp_path):
    """Rows equal in id and text fall into several ranges."""
    tokenfile.write_tokens(frame(spark, ["same text"] * 4000, [3] * 4000).coalesce(1), str(tmp_path / "t"), partitions=4)
    parts = {r["part"]: r["count"] for r in tokenfile.read_tokens(spark, str(tmp_path / "t"), ("part",)).groupBy("part").count().collect()}
    assert len(parts) == 4 and sum(parts.values()) == 4000


def test_token_queries_on_documents(spark, library):
    """op1, op6 and op9 on the driver's table against the library."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: ids_of(library, t) for i, t in texts.items()}
    before, wanted = 0, set()
    for i in sorted(ids):
        wanted.add((i, before, len(ids[i]) + 1, crc([*ids[i], 0])))
        before += len(ids[i]) + 1
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in llm.queries()["op1_token_parquet"](spark, SF).collect()} == wanted
    for r in llm.queries()["op6_batched_bpe"](spark, SF).collect():
        own = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), sha256(",".join(map(str, own)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
    pieces = {}
    for r in llm.queries()["op9_pattern_packing"](spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, own in ids.items():
        assert sum(r["length"] for r in pieces[i]) == len(own) + 1
        assert all(r["ids_crc32"] == crc([*own, 0][r["start"] : r["start"] + r["length"]]) for r in pieces[i])


# 2


def test_logits_are_mean_subword_weights():
    """Against a loop over words, whatever texts stand beside each other; a subword may hold the borders of its word."""
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b"], rng.standard_normal((langid.BUCKETS + 1, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.0, 0.0)
    model.weights[-1] = 0  # no subword
    texts = ["Bana kolo", "é1ü", "x", "Strasse-Straße  ok", "a" * 50]

    def bucket(points):
        h = points[0] * 0x9E3779B1 % 2**32
        for p in points[1:]:
            h = ((h ^ h >> 15) * 0x85EBCA6B + p * 0xC2B2AE35) % 2**32
        return (h ^ h >> 13) * 0x27D4EB2F % 2**32 >> 16

    for t, got in zip(texts, model.logits(texts)[0]):
        found = []
        for word in re.findall(r"[^\W\d_]+", t.lower()):
            c = [0, *map(ord, word), 0]
            found += [model.weights[bucket(c[i : i + n])] for n in langid.SIZES for i in range(len(c) - n + 1) if n <= len(c)]
        assert np.allclose(got, np.mean(np.array(found, float), 0) + model.bias, atol=1e-6)


def test_sample_is_bounded(spark):
    """Equal rows count once, so that the driver never gets more than the bound."""
    df = spark.createDataFrame([(3, "same", "x")] * 5000 + [(i, f"t{i}", "x") for i in range(10_000, 13_000)] + [(1, "u", "y"), (1, "u", None)], "doc_id long, text string, lang string")
    rows = lowest(df, F.col("lang"), 100, F.xxhash64(F.lit(11), "doc_id", "text"), ["doc_id", "text", "lang"])
    assert Counter(r["lang"] for r in rows) == {"x": 100, "y": 1} and len({(r["doc_id"], r["text"]) for r in rows}) == 101


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": ["bana", "kolo", "tiri", "maso"], "bb": ["schrum", "pflaz", "gritz", "knorp"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(3, 60))), g) for i, g in enumerate(["aa", "bb"] * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.unionByName(spark.createDataFrame([(None, None, "aa"), (1, "x", None), (2, "", "bb")], df.schema)))
    ask = frame(spark, ["bana kolo maso", "pflaz knorp", None, "", "123 ...", "maso " * 50_000])
    got = {r["doc_id"]: r for r in langid.predict(ask, model, ["doc_id", "score"]).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2]["rejected"] and not got[0]["rejected"]


def test_language_without_labels(spark):
    docs = frame(spark, ["abc", None])
    got = langid.predict(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string"))), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_language_accuracy(spark):
    got = llm.queries()["op2_subword_langid"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert right[0] > 0.97 and right[1] < 0.02


# 3


def test_imatch(spark):
    rng = random.Random(2)
    texts = [*ODD, *(prose(rng, rng.randint(1, 200)) for _ in range(80)), *ODD]
    docs = frame(spark, texts, [*range(len(texts) - 1), None]).select("doc_id", "text")
    lex = imatch.lexicon(docs)
    word = re.compile(r"[^\W\d_]+")
    n = Counter(w for t in texts for w in {x.lower() for x in word.findall(t or "")})
    assert len(lex.hashes) == sum(max(2, 0.001 * len(texts)) <= c <= max(2, 0.1 * len(texts)) for c in n.values())
    got = {r["doc_id"]: r for r in imatch.with_next(docs, lex, 3).collect()}
    order = [*range(len(texts) - 2, -1, -1), len(texts) - 1]  # null last
    own = lex.fingerprints(pa.array([t or "" for t in texts], pa.large_string()))
    for here, after in zip(order, order[1:] + order[:1]):
        t, u = texts[here] or "", texts[after] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        r = got[None if here == len(texts) - 1 else here]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == own[here]
        assert r["near_next"] == imatch.likeness(own[here], own[after])
        assert r["near_edited"] == imatch.likeness(own[here], lex.fingerprints(pa.array([edited], pa.large_string()))[0])
    assert imatch.likeness(own[3], own[3]) == 1.0


def test_imatch_single_and_repeated(spark):
    docs = frame(spark, ["abcdef"]).select("doc_id", "text")
    r = imatch.with_next(docs, imatch.lexicon(docs)).first()
    assert r["edited_sha256"] == sha256(b"abcdab").hexdigest() and r["near_next"] == 1.0
    docs = frame(spark, ["same text"] * 50, [3] * 50).select("doc_id", "text")
    assert imatch.with_next(docs, imatch.lexicon(docs)).count() == 50


def test_imatch_extreme_ids(spark):
    docs = frame(spark, ["aa bb", "cc dd ee", None, "ff", "aa bb"], [-(2**63), 2**63 - 1, 0, None, 2**63 - 1]).select("doc_id", "text")
    rows = imatch.with_next(docs, imatch.lexicon(docs), 2).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([-(2**63), 2**63 - 1, 2**63 - 1, 0, None])
    assert next(r for r in rows if r["doc_id"] == -(2**63))["edited_sha256"] == sha256(b"aa bf").hexdigest()  # the one without id follows


def test_lexicon_has_the_whole_band(spark):
    texts = ["".join(f"{a}{b}{c} " for a in "abcdefghijklmnop" for b in "qrstuvwxyz" for c in "klmnopqrst")] * 2 + ["z"] * 10
    assert len(imatch.lexicon(frame(spark, [t + f" {'x' * i}" for i, t in enumerate(texts)])).hashes) == 1600


def test_imatch_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.desc("doc_id")).collect()
    got = {r["doc_id"]: r for r in llm.queries()["op3_imatch"](spark, SF).collect()}
    for r, after in zip(docs, docs[1:] + docs[:1]):
        t, k = r["text"] or "", len(r["text"] or "") // 3
        edited = t[: len(t) - k] + (after["text"] or "")[:k]
        assert (got[r["doc_id"]]["n_chars"], got[r["doc_id"]]["edited_sha256"]) == (len(t), sha256(edited.encode()).hexdigest())
    prints = {}
    for r in docs:
        assert prints.setdefault(r["text"] or "", got[r["doc_id"]]["fingerprint"]) == got[r["doc_id"]]["fingerprint"]


# 4


def test_vectors_a_little_under(spark, monkeypatch):
    """Double columns keep double precision over borders too: cosines of 0.9 - 1e-9 are no links."""
    monkeypatch.setattr(neardup_vectors, "WINDOW", 8)
    rng = np.random.default_rng(6)
    a = rng.standard_normal((150, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.standard_normal(a.shape)
    off -= (off * a).sum(1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = lambda c: c * a + np.sqrt(1 - c * c) * off
    x = np.concatenate([a, near(0.9 - 1e-9), -a, -near(0.9 + 1e-9)])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup_vectors.link(df).collect()}
    assert all(got[i] == (0, i) for i in range(300))
    assert sum(got[300 + i] == (1, 300 + i) and got[450 + i] == (1, 300 + i) for i in range(150)) >= 147


def test_vector_query_on_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    ids = np.array([r["vec_id"] for r in rows])
    got = {r["vec_id"]: r["n_links"] for r in llm.queries()["op4_sorted_projections"](spark, "/root/testdata/sf0.01").collect()}
    found, links = sum(got.values()), int(hit.sum()) - len(ids)
    assert all(got[i] <= n - 1 for i, n in zip(ids.tolist(), hit.sum(1).tolist())) and found >= 0.99 * links


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + rng.standard_normal(16) * rng.choice([0.02, 0.3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(0, rows[0][1])]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, [1.0, 2.0]), (2007, [1e30] * 16), (2008, [1e-30] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.link(df).collect())
    good = [(i, np.array(v, float)) for i, v in rows + odd if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([v / np.abs(v).max() for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    label = np.array([i for i, _ in good])
    for _ in range(20):
        label = np.array([label[h].min() for h in hit])
    wanted = Counter((i, int(h.sum()) - 1, int(c), bool(i == c)) for (i, _), h, c in zip(good, hit, label))
    wanted += Counter((i, 0, i, True) for i, v in odd if i not in {g for g, _ in good})
    assert got == wanted


def crowd(rng, n, planted, mutual):
    """n vectors of one topic with about that mutual cosine; row n + i is at cosine 0.91 to row i."""
    x = rng.standard_normal((n, 64))
    x = np.sqrt(mutual) * np.eye(64)[0] + np.sqrt(1 - mutual) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((planted, 64))
    off -= (off * x[:planted]).sum(1, keepdims=True) * x[:planted]
    return np.concatenate([x, 0.91 * x[:planted] + np.sqrt(1 - 0.91**2) * off / np.linalg.norm(off, axis=1, keepdims=True)])


def test_vectors_of_one_topic_are_found(spark):
    x = crowd(np.random.default_rng(9), 20_000, 500, 0.7)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))}))
    got = {r["vec_id"]: r["component_id"] for r in neardup_vectors.link(df).collect()}
    assert sum(got[i] == got[20_000 + i] for i in range(500)) >= 495


def test_passes_grow_with_the_table():
    x = crowd(np.random.default_rng(10), 8000, 0, 0.0)
    passes = [neardup_vectors.enough(x, n) for n in (8000, 400_000, 1_600_000)]
    assert passes[0] == neardup_vectors.PASSES < passes[1] < passes[2] < 200
    assert neardup_vectors.enough(crowd(np.random.default_rng(10), 8000, 0, 0.7), 400_000) > passes[1]


# 5


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label, links = list(range(len(texts))), [0] * len(texts)
    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            links[i] += 1
            links[j] += 1
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return [(i, len(s), c, n) for i, (s, c, n) in enumerate(zip(sets, label, links))]


def near_copies(rng, n):
    texts = []
    while len(texts) < n:
        base = prose(rng, rng.choice([5, 6, 7, 8, 9, 12, 20, 40, 90, 200]), 100_000).split()
        for _ in range(rng.choice([1, 1, 2, 5, 45])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w))
                w[k : k + rng.choice([0, 1])] = [f"n{rng.random()}"]
            texts.append(" ".join(w))
    return texts[:n]


@pytest.mark.parametrize(("longest", "chained", "tile"), [(32, 8, 192), (4, 2, 5)])
def test_join(spark, monkeypatch, longest, chained, tile):
    """Exact whatever signatures are long, chained by their senders or cut to tiles."""
    for name, value in (("LONGEST", longest), ("CHAINED", chained), ("TILE", tile)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(longest)
    passage = prose(rng, 60, 100_000)
    texts = [*ODD, *near_copies(rng, 500), *(passage + " " + prose(rng, rng.choice([3, 10, 80]), 100_000) for _ in range(60)), *["The Same one here now\x0bagain"] * 40, "the same ONE here now again"]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(frame(spark, texts)).collect())
    assert got == brute_components(texts)


def test_join_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in llm.queries()["op5_partition_join"](spark, SF).collect())
    ids = [r["doc_id"] for r in docs]
    assert got == [(ids[i], n, ids[c], k) for i, n, c, k in brute_components([r["text"] for r in docs])]


def test_senders_leave_out_long_signatures(monkeypatch):
    """What a sender leaves out is deducted, and enough sets send it on for all others to learn that it is long."""
    monkeypatch.setattr(ngram_join, "LONGEST", 3)
    sig, who = np.array([8, 8, 8, 8, 8, 8, 9, 9, 6, 8], np.uint64), np.array([0, 1, 2, 3, 4, 5, 0, 1, 2, 5])
    s, w, units, long = ngram_join.without_long(sig, who, np.full(6, 5), np.zeros(0, np.uint64))
    assert sorted(zip(s.tolist(), w.tolist())) == [(6, 2), (8, 0), (8, 1), (8, 2), (8, 3), (9, 0), (9, 1)]
    assert units.tolist() == [5, 5, 5, 5, 4, 4] and long.tolist() == [8]
    s, w, units, long = ngram_join.without_long(np.array([8, 9, 5], np.uint64), np.array([0, 0, 1]), np.full(2, 5), np.array([9], np.uint64))
    assert sorted(zip(s.tolist(), w.tolist())) == [(5, 1), (8, 0)] and units.tolist() == [3, 5] and long.tolist() == [9]


def test_join_repeats_and_nulls(spark):
    a = " ".join(f"x{i}" for i in range(30))
    df = frame(spark, [a, a, a + " y", None, "q"], [5, 5, None, None, None])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(df).collect()), key=str)
    assert got == sorted([(5, 26, 5, 2), (5, 26, 5, 2), (None, 27, 5, 2), (None, 0, None, 0), (None, 1, None, 0)], key=str)


def test_signatures_detect_all_pairs():
    """With one-deletion neighbourhoods in all segments too: each linked pair of safe sets meets."""
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 9, 15, 30, 100, 600):
        for _ in range(20):
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            most = ngram_join.differ(n, n)
            k = most // 2
            b = np.concatenate([a[k:], rng.integers(1, 2**63, k, dtype=np.uint64)])
            sets, at = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n])
            for band, rows, units, sig, who in ngram_join.signatures(sets, at):
                if max(units) >= ngram_join.required(n, band) and n >> band == 1:
                    assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), (n, band)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (900, 901), (901, 900)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# 6


def test_bpe(spark, library):
    rng = random.Random(5)
    alphabet = [*"ab 'st\n\t 1é😀_.", "<|endoftext|>", "  ", "�", "\x00"]
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)), "x" * 20_000, "ab" * 5000]
    docs = frame(spark, texts)
    for r in bpe.digests(docs).collect():
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_tokens(bpe.encode_texts(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    ids = [rng.randrange(50_257) for _ in range(50)]
    assert bpe.own().decode(np.array(ids), np.array([0, 50]))[0].decode() == library.decode(ids, skip_special_tokens=False)


# 7


def test_shards(spark):
    df = frame(spark, ["x"] * 1003, [i if i % 3 else None for i in range(1003)]).select("doc_id")
    rows = sharding.shard_rows(df.repartition(5), 16).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, slots.values())) == [62] * 5 + [63] * 11
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["doc_id"] for r in rows) == Counter(i if i % 3 else None for i in range(1003))


def test_matrix():
    for seed in range(20):
        m = sharding.communication_matrix([5, 0, 100, 7], [40, 40, 32], seed)
        assert [sum(r) for r in m] == [5, 0, 100, 7] and [sum(c) for c in zip(*m)] == [40, 40, 32]
    rng = random.Random(0)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.12


@pytest.mark.parametrize("rows", [10**6, 10**10, 10**12])
def test_outcomes_have_mass_one(rows):
    least, p = sharding.outcomes(rows // 16, rows - rows // 16, 65_536)
    assert abs(sum(p) - 1) < 1e-12 and min(p) >= 0
    mean = sum((least + i) * x for i, x in enumerate(p))
    exact = 65_536 * (rows // 16) / rows
    assert abs(mean - exact) < 1e-6
    spread = sum((least + i - mean) ** 2 * x for i, x in enumerate(p))
    assert abs(spread / (exact * (1 - rows // 16 / rows) * (rows - 65_536) / (rows - 1)) - 1) < 1e-9


def test_matrix_follows_the_uniform_law():
    """Shares of all matrices among many draws against those of all orders of the rows."""
    rows, shards = [3, 2, 2], [4, 3]
    owner = [i for i, n in enumerate(rows) for _ in range(n)]
    law = Counter()
    for first in combinations(range(7), 4):
        law[tuple(sum(owner[k] == i for k in first) for i in range(3))] += 1 / 35
    n = 20_000
    got = Counter(tuple(line[0] for line in sharding.communication_matrix(rows, shards, seed)) for seed in range(n))
    assert set(got) <= set(law) and sum((got[k] - n * p) ** 2 / (n * p) for k, p in law.items()) < 25  # chi-square of few degrees of freedom


def test_shards_mix(spark):
    """Each shard gets its share of each stretch of the rows, and slots don't keep the order."""
    n = 16_000
    rows = sharding.shard_rows(spark.range(n).repartition(4).sortWithinPartitions("id").select(F.col("id").alias("doc_id")), 16).collect()
    cells = Counter((r["doc_id"] * 8 // n, r["shard"]) for r in rows)
    assert sum((cells[i, j] - 125) ** 2 / 125 for i in range(8) for j in range(16)) < 170  # 105 degrees of freedom
    order = np.array([(r["slot"], r["doc_id"]) for r in rows if r["shard"] == 0])
    assert abs(np.corrcoef(order.T)[0, 1]) < 0.12


def test_shards_of_any_names(spark):
    df = spark.createDataFrame([(i, "s", i, "p", None, i) for i in range(40)], "shard long, slot string, _file long, _part string, c1 int, `a b` long")
    rows = sharding.shard_rows(df, 3)
    assert rows.columns == ["_file", "_part", "c1", "a b", "shard", "slot"]
    got = rows.collect()
    assert sorted(r["a b"] for r in got) == list(range(40)) and sorted(Counter(r["shard"] for r in got).values()) == [13, 13, 14]
    assert sharding.shard_rows(df.select("slot"), 2).count() == 40


def test_sizes_and_crc(spark):
    rows = llm.queries()["op7_hypergeometric_sharding"](spark, SF).collect()
    known = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(known)
    assert all(r["size"] == len(known[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(known[r["doc_id"]].encode()) and r["law"] == "rows" for r in rows)


# 8


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/es/1?x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://b.org": ("b.org", "", None, None),
        "x://b.org/": ("b.org", "/", "org/", "allow"),
        "x://c.com/de/": ("c.com", "/de/", "com/de/", "block"),
        "x://xcom/de/": ("xcom", "/de/", None, None),
        "x://com/fr/a://b": ("com", "/fr/a://b", "com/fr/", "allow"),
        "no scheme": ("", "", None, None),
        "x://?q": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlrep.judge(df).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        assert verdict is None or r["verdict"] == verdict


def test_urls_reputation(spark):
    rows = [(i, f"http://bad.example.com/de/{i}") for i in range(60)] + [(100 + i, f"http://good.example.com/fr/{i}") for i in range(60)] + [(200, "http://bad.example.com/x"), (201, "http://good.example.com/x"), (202, "http://new.example.net/x")]
    got = {r["page_id"]: r["verdict"] for r in urlrep.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[200], got[201], got[202]) == ("block", "allow", "allow")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        same(llm.queries()[name](spark, sf), llm.oracle_sql()[name], sf)


# 9


def test_packing(spark, library):
    rng = random.Random(6)
    texts = [*ODD, *(prose(rng, rng.choice([1, 30, 400, 2500])) for _ in range(120))]
    rows = packing.pack(packing.cut_documents(frame(spark, texts))).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        ids, at = [*ids_of(library, texts[i]), 0], 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            assert k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids) and len(parts) == -(-len(ids) // 2048)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.03 * -(-total // 2048) + 1


def test_pack_any_names(spark):
    df = spark.createDataFrame([(i, "x", "y", "z", 1 + i % 2048) for i in range(300)], "sequence_id long, offset string, _rank string, c0 string, length long")
    out = packing.pack(df)
    assert out.columns == ["_rank", "c0", "length", "sequence_id", "offset"]
    assert out.count() == 300 and out.filter("offset + length > 2048").count() == 0


def test_most_pieces_go_by_patterns(monkeypatch):
    """Best fit gets a small rest of a large histogram."""
    left = []
    real = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda h, n: left.append(int(h.sum())) or real(h, n))
    h = np.bincount(np.clip(np.random.default_rng(0).lognormal(6.5, 1, 50_000).astype(int), 1, 2048), minlength=2049)
    plan = packing.plan(h)
    assert left[0] < 0.1 * h.sum() and left[-1] < 0.02 * h.sum()
    assert sum(n for _, n in plan) <= 1.001 * (h * np.arange(2049)).sum() / 2048 + 1


def test_plan_uses_each_length_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        h = np.bincount(rng.integers(1, 2049, n), minlength=2049)
        used = np.zeros(2049, int)
        for lengths, times in packing.plan(h):
            assert sum(lengths) <= 2048
            np.add.at(used, lengths, times)
        assert (used == h).all()


def test_pack_refuses_and_nulls(spark):
    ship(spark)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(3000,)], "length long"))
    got = packing.pack(spark.createDataFrame([(None, "a"), (5, "b")], "length long, k string")).collect()
    assert {r["k"]: r["sequence_id"] for r in got} == {"a": None, "b": 0}


# 10


def plain_terms(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        out.update([w, *(w[:n] + "-" for n in toxicity.PREFIXES if len(w) >= n)])
    return out


def g2(a, n, toxic, total):
    """Twice the sum of o log(o / e) over the four cells of term against label."""
    cells = [(a, n * toxic), (n - a, n * (total - toxic)), (toxic - a, (total - n) * toxic), (total - n - toxic + a, (total - n) * (total - toxic))]
    return 2 * sum(o * np.log(o * total / e) for o, e in cells if o)


def plain_cosines(texts, labels, queries):
    """Cosines of queries with all texts, from all terms of all of them; no texts may be copies."""
    bags = [plain_terms(t) for t in texts]
    df = Counter(t for b in bags for t in b)
    bad = Counter(t for b, y in zip(bags, labels) if y for t in b)

    def weight(t):
        g = max(g2(bad[t], df[t], sum(labels), len(texts)), 0) if t in df else 0.0
        return np.log((1 + len(texts)) / (0.5 + df[t])) * (toxicity.FLOOR + (1 - toxicity.FLOOR) * g / (g + toxicity.HALF))

    def vector(b):
        v = {t: (1 + np.log(n)) * weight(t) for t, n in b.items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    own = [vector(b) for b in bags]
    return [[sum(x * o.get(t, 0.0) for t, x in q.items()) for o in own] for q in (vector(plain_terms(t)) for t in queries)]


@pytest.mark.parametrize("common", [0.06, 0.5, 0.0])
def test_nearest_is_exact(monkeypatch, common):
    """Neighbours and cosines equal those over all terms, rare, common and unknown ones, however the index keeps them."""
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = random.Random(7)
    stock = ["idiot", "moron", "scum", "nice", "fine", *(f"{a}{b}{c}word" for a in "abcdefgh" for b in "xyzw" for c in "klmn")]
    texts = [" ".join(rng.choices(stock, [9, 9, 9, 9, 9, *([1] * 128)], k=rng.randint(9, 60))) for _ in range(400)]
    labels = [int("moron" in t) for t in texts]
    model = toxicity.train(list(range(400)), texts, labels, {0: 900, 1: 300})
    assert set(model.terms.to_pylist()) == {t for x in texts for t in plain_terms(x)}
    queries = [*texts[:40], "", "nothing", "moron 12 unheardof", "Idiots and scumbags", *(" ".join(rng.choices(stock, k=5)) + " newword other" for _ in range(20))]
    for dots, (found, score) in zip(plain_cosines(texts, labels, queries), model.nearest(model.vectors(pa.array(queries)))):
        wanted = sorted((x for x in dots if x > 1e-9), reverse=True)[: toxicity.NEIGHBOURS]
        assert np.allclose(score, wanted, atol=2e-9)
        assert np.allclose([dots[i] for i in model.ids[found]], score, atol=2e-9) and len(set(found.tolist())) == len(found)
        assert list(zip(-score, found)) == sorted(zip(-score, found))


def test_copies_speak_once():
    """Copies and near copies don't make their words look linked with the label; unlike texts that share frequent words are not copies."""
    rng = random.Random(3)
    unlike = [" ".join(["frequentword", *(f"{rng.choice('abcdef')}{rng.choice('ghijkl')}{rng.choice('mnopqr')}{rng.choice('stuvwx')}" for _ in range(20))]) for _ in range(40)]
    texts = [*unlike, *[unlike[0] + f" zz{'q' * i}" for i in range(10)]]
    text, term, _, names = toxicity.counts(pa.array(texts))
    assert toxicity.families(text, term, names, np.zeros(len(texts))).tolist() == list(range(40))


def test_toxicity(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice([f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]) for _ in range(rng.randint(5, 60))) for _ in range(400)]
    texts = [t + " moron idiot" if i % 5 == 1 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 5 == 1), 1) for i in range(300)] + [(None, 1, 1), (5, None, 1), (0, 0, 0), (10_000, 1, 0)], "doc_id long, toxic int, text int")
    docs = frame(spark, [*texts, None, ""])
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "extra", "score"]).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 1) for i in range(300, 400))
    assert got[400]["predicted"] == got[401]["predicted"] == 0 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[301]["evidence"]


def test_rare_toxic_words_count():
    """A word of few toxic examples counts beside one of many."""
    rng = random.Random(11)
    plain = lambda: " ".join("x" + "".join(rng.choice("abcdefghij") for _ in range(2)) for _ in range(20))
    texts = [plain() + " moron" for _ in range(144)] + [plain() + " scumbag" for _ in range(6)] + [plain() for _ in range(750)]
    model = toxicity.train(list(range(900)), texts, [1] * 150 + [0] * 750, {0: 750, 1: 150})
    assert [s > 0.5 for s, _, _ in model.score(pa.array(["scumbag xab xcd", "moron xab", "xab xcd", "", None]))] == [True, True, False, False, False]


def test_toxicity_one_label(spark):
    docs = frame(spark, ["a b", "c"])
    model = toxicity.fit(docs, spark.createDataFrame([(0, 0)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score(docs, model, ["doc_id"]).collect()} == {0}


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "language_id", "ngram_join", "packing"]
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    clean = p.toxic(spark, docs, sf).persist()
    assert clean.columns == docs.columns and docs.count() * 0.7 < clean.count() < docs.count()
    known = p.language(spark, clean, sf).persist()
    assert known.count() > 0.97 * clean.count()
    rows = known.collect()
    wanted = {r["doc_id"] for r, c in zip(rows, one_each([r["text"] for r in rows], [r["doc_id"] for r in rows])) if c}
    one = p.one_of_each(spark, known, sf).persist()
    assert {r["doc_id"] for r in one.collect()} == wanted and one.count() == len(wanted)
    assert {r["doc_id"] for r in p.packed(spark, one, sf).collect()} == wanted
    docs.unpersist()


def one_each(texts, ids):
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    found = brute_components([texts[i] for i in order])
    keep = [False] * len(ids)
    for k, i in enumerate(order):
        keep[i] = found[k][2] == k
    return keep


def test_pipeline_odd_rows(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, None, None, None, None), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "z", "en", "s", 1), (None, "z", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    ship(spark)
    got = p.one_of_each(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "None", "None"]
    assert p.packed(spark, docs, SF).count() == 5
    # nothing is learned from: no language is known, nothing is toxic
    assert p.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == 0
    odd = docs.unionByName(spark.createDataFrame([(10**6, "x y z", "en", "s", 5), (10**6, "", "en", "s", 0)], docs.schema)).withColumn("score", F.lit("mine"))
    clean = p.toxic(spark, odd, SF)
    assert clean.columns == docs.columns and clean.count() == odd.count()
    for name, stage in p.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)


def test_pipeline_leaves_no_scratch(spark):
    import corpus_pipeline as p
    from loam.llm.common import sweep, tables

    sweep()
    assert p.run(spark, SF).count() > 100
    assert len(tables()) == 1


def test_pipeline_removes_single_rows(spark):
    """A copy without id takes no other rows without id along, and unlinked texts of one doc_id stay."""
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{k}{i}" for i in range(20)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, b), (None, a), (None, c), (None, None), (7, c), (7, d), (7, d), (8, ""), (8, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in p.one_of_each(spark, docs, SF).collect())
    assert got == Counter([(1, a), (5, b), (7, c), (7, d), (None, None), (8, None), (9, " ")])
    docs = spark.createDataFrame([(1, a, "en", "s", 1), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", "s", 1)], docs.schema)
    assert Counter(r["text"] for r in p.one_of_each(spark, docs, SF).collect()) == Counter([a, c, d])


def test_isotonic():
    """Against the best rising steps by brute force over all ways to pool."""
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(1, 7)
        votes, truth, weight = sorted(rng.choice([0.1, 0.2, 0.5, 0.7, 0.9]) for _ in range(n)), [rng.randint(0, 1) for _ in range(n)], [rng.choice([1.0, 3.0]) for _ in range(n)]
        x, y = toxicity.isotonic(np.array(votes), np.array(truth, float), np.array(weight))
        assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()
        loss = lambda f: sum(w * (t - f(v)) ** 2 for v, t, w in zip(votes, truth, weight))  # noqa: B023, E731
        distinct = sorted(set(votes))
        best = min(loss(f) for k in range(len(distinct)) for cut in combinations(range(1, len(distinct)), k) if (f := steps(votes, truth, weight, [distinct[i] for i in cut])))
        assert loss(lambda v: np.interp(v, x, y)) <= best + 1e-9  # noqa: B023


def steps(votes, truth, weight, cuts):
    """The means between cuts as a function, or None if they fall."""
    part = [sum(v >= c for c in cuts) for v in votes]
    means = [np.average([t for t, p in zip(truth, part) if p == k], weights=[w for w, p in zip(weight, part) if p == k]) for k in range(len(cuts) + 1)]
    return (lambda v: means[sum(v >= c for c in cuts)]) if means == sorted(means) else None
