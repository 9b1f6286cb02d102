"""Operators 11 to 13 against SQL or plain versions, on odd rows and on the driver's tables."""

import re
import zlib
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.llm import decontam, importance, periodic
from loam.llm import queries as llm
from loam.llm.common import lowest, ship
from tests.conftest import SF
from tests.helpers import same

DOCS = "doc_id long, text string, n_words string, rank string, _file string, runs int"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts, ids=None):
    ship(spark)
    return spark.createDataFrame([(i if ids is None else ids[i], t, "e", "r", "f", 1) for i, t in enumerate(texts)], DOCS)


def words_of(text):
    return WORDS.findall((text or "").translate(UPPER))


# 11


def plain_hits(texts, items, window=10):
    """(n_words, positions hit, sorted item ids) of each text, by comparing every window."""
    grams = {}
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            grams.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                got = grams.get(tuple(w[i : i + m]))
                if got:
                    hit |= set(range(i, i + m))
                    found |= {str(x) for x in got if x is not None}
        out.append((len(w), len(hit), sorted(found)))
    return out


LINE = [f"w{i}" for i in range(60)]
ITEMS = [(1, " ".join(LINE[:25])), (10, " ".join(LINE[20:40])), (2, "Tiny ITEM"), (2, "tiny item"), (3, None), (4, "?!"), (5, "é"), (None, "no id of mine at all"), (6, "a " * 40), (7, " ".join(LINE[:12]))]
TEXTS = [
    None, "", " ... ", "tiny", "a tiny-item, TINY  item", "x é y", "É", "no id of mine at all", " ".join(LINE), " ".join(LINE[:9]), " ".join(LINE[:10]), "z " + " ".join(LINE[15:30]).upper() + " z",
    "a " * 9, "a " * 10, "a " * 30 + "b " + "a " * 12, " ".join(LINE[:14] + ["cut"] + LINE[14:28]), "a tiny-item, TINY  item", "word " * 5000 + " ".join(LINE[3:20]),
]


@pytest.mark.parametrize("gram", [1, 3, 5, 10])
def test_winnowing_equals_all_windows(spark, gram):
    docs = frame(spark, TEXTS, [None, 7, 7, *range(20, 20 + len(TEXTS) - 3)]).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for small in (1_000_000, 0):  # by broadcast, and by shuffle
        got = decontam.contamination(docs.drop("n_words"), items, ["doc_id", "text", "rank"], gram=gram, small=small)
        assert got.columns == ["doc_id", "text", "rank", "n_words", "n_hit", "items", "contaminated"]
        rows = got.collect()
        expected = dict(zip(TEXTS, plain_hits(TEXTS, ITEMS)))
        assert sorted(map(str, (r["text"] for r in rows))) == sorted(map(str, TEXTS))
        for r in rows:
            assert (r["n_words"], r["n_hit"], r["items"]) == expected[r["text"]], r["text"][:50]
            assert r["contaminated"] == (r["n_hit"] > 0)


def test_winnowing_spans_tell_places(spark):
    rows, groups = decontam.hits(frame(spark, ["q " + " ".join(LINE[:12])]), spark.createDataFrame([(1, " ".join(LINE[:12]))], "item_id long, text string"))
    row = rows.first()
    assert [(s["start"], s["end"]) for s in row["_spans"]] == [(1, 11), (2, 12), (3, 13)] and row["_n_words"] == 13
    assert [g["_items"] for g in groups.collect() if g["_group"] in row["_groups"]] == [["1"]]


@pytest.mark.parametrize("texts,items", [([], ITEMS), (TEXTS[:4], []), ([], [])])
def test_winnowing_empty_tables(spark, texts, items):
    docs, items = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, items, ["doc_id"]).collect()
    assert len(got) == len(texts) and not any(r["contaminated"] for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 50))
def test_least_hashes_meet(words, at):
    """Of each stretch of ten words a kept gram lies in it, whatever stands around: what the method promises, in plain code."""
    hashes = [zlib.crc32(repr(words[i : i + 5]).encode()) for i in range(len(words) - 4)]
    least = [min(hashes[i : i + 6]) for i in range(len(words) - 9)]
    part = words[at : at + 10]
    if len(part) == 10:
        assert least[at] == min(zlib.crc32(repr(part[i : i + 5]).encode()) for i in range(6))


def test_winnowing_plan_has_no_python(spark):
    plan = llm.queries()["op11_winnowing"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op11_winnowing", "op12_importance_resampling"])
def test_query_equals_sql(spark, name):
    same(llm.queries()[name](spark, SF), llm.oracle_sql()[name], SF)


# 12


def plain_resample(rows, target, least=20, percent=25):
    import math

    def numbers(text):
        w = words_of(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2) for i in range(len(w) - k + 1)]

    raw, want = {}, {}
    for counts, texts in ((raw, [t for _, t in rows]), (want, target)):
        for text in texts:
            for b in numbers(text)[1]:
                counts[b] = counts.get(b, 0) + 1
    s, t = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want.get(b, 0) + 1) * (s + 10_000) / ((n + 1) * (t + 10_000)))) for b, n in raw.items()}
    out = []
    for i, (key, text) in enumerate(rows):
        n, bs = numbers(text)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least, None])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted((tuple(r[:4]) + (r[5],) for r in out), key=str)


def test_resampling_equals_plain_code(spark):
    texts = [*TEXTS, *(" ".join(f"w{(i * j) % 50}" for j in range(i)) for i in range(12, 60)), "😀 " * 25, "b" * 5000]
    ids = [None, 7, 7, *range(20, 20 + len(texts) - 3)]
    docs, target = frame(spark, texts, ids).repartition(5), [t for _, t in ITEMS]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    assert rows == plain_resample(list(zip(ids, texts)), target)


def test_resampling_ties_and_repeats(spark):
    """Rows of one id have one score: ranks stay gapless, each row is one, and the next id follows."""
    docs = frame(spark, ["a " * 30] * 40, [3] * 39 + [2])
    rows = importance.resample(docs, docs.limit(1), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 21))
    assert len(rows) == 40 and len({r["weight"] for r in rows}) == 1


def test_resampling_longer_runs_of_words(spark):
    got = importance.resample(frame(spark, ["a b c d", "a", None]), frame(spark, ["a b c d"]), longest=3, least_words=1).collect()
    assert sorted(r["n_features"] for r in got) == [0, 1, 9]


def test_resampling_empty_tables(spark):
    assert importance.resample(frame(spark, []), frame(spark, ["a"])).count() == 0
    got = importance.resample(frame(spark, ["a b", None]), frame(spark, [])).collect()
    assert [r["rank"] for r in got] == [None, None]


# 13


def plain_runs(words, least=6, repeats=4):
    out, n = [], len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size, part = j - i + q, words[i : j + q]
            if size >= max(least, repeats * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out)


blocks = st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(0, 45))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(blocks, st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=4), st.just(1))), max_size=7), st.sampled_from([(6, 4), (2, 2), (6, 3), (9, 2), (5, 5)]))
def test_runs_equal_plain_code(parts, limits):
    words = [b"%d" % x for block, n in parts for x in (block * 50)[:n]]
    assert periodic.runs_in(words, *limits) == plain_runs(words, *limits)


def test_ordered_ends_keep_order_in_blocks():
    ends, other = periodic.Ends(1), periodic.Ends(0)
    for x in range(3, 20_001, 2):
        ends.add(x)
    for x in range(2, 9_000, 2):
        other.add(x)
    pairs = ends.take(other)
    flat = [x for b in ends.blocks for x in b]
    assert flat == sorted(flat) and len(flat) == ends.n == 10_000 + 4_500 and max(map(len, ends.blocks)) <= periodic.BLOCK
    assert set(pairs) == {(x, x + 1) for x in range(0, 8_999)}


def test_runs_of_very_long_texts():
    assert periodic.runs_in([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert periodic.runs_in([b"%d" % (i % 7) for i in range(30_000)] + [b"x"]) == [(0, 30_000, 7)]


def plain_row(key, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (key, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x\x1cy x\x1cy  é é é é é é é\t\n é", "no no No no no no", "A B " * 5 + "C " * 9, "one two three four " * 400]
    docs = frame(spark, texts, [None, 5, 5, *range(6, 6 + len(texts) - 3)])
    got = periodic.find_runs(docs, ["doc_id", "text", "rank", "runs"])
    assert got.columns == ["doc_id", "text", "rank", "n_words", "runs", "collapsed"]
    for r in got.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone))
    assert periodic.find_runs(frame(spark, []), ["doc_id"]).count() == 0


def test_looped_texts(spark):
    ids = [None, *range(300)]
    docs = frame(spark, ["" if i == 6 else None if i == 7 else " ".join(f"w{j}" for j in range(1 + i % 40)) for i in range(301)], ids)
    got = docs.select("doc_id", "text", periodic.looped(F.col("text"), F.col("doc_id")).alias("to")).collect()
    looped = 0
    for r in got:
        words, h = (r["text"] or "").split(), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is None or h % 10:
            assert r["to"] == r["text"]
            continue
        looped += 1
        n, g = len(words), h // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert r["to"].split() == words
    assert looped > 10


def test_query_of_runs_on_the_drivers_table(spark):
    got = sorted(tuple(r) for r in llm.queries()["op13_periodic_runs"](spark, SF).collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs), key=lambda r: r[0])
    assert sum(r[1] > 0 for r in got) > 10


# common


def test_lowest_of_very_many_groups(spark):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") < 2000, F.col("id")).otherwise(F.col("id") % 3).cast("string").alias("g"))
    got = lowest(df, F.col("g"), 5, F.xxhash64("id"), ["id", "g"], groups=40)
    counts = {}
    for r in got:
        counts[r["g"]] = counts.get(r["g"], 0) + 1
    assert len(counts) == 40 and [counts[g] for g in "012"] == [5, 5, 5]
    units = {r["id"]: r["u"] for r in df.filter("g = '1'").select("id", ((F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))).alias("u")).collect()}
    assert sorted(r["id"] for r in got if r["g"] == "1") == sorted(sorted(units, key=units.get)[:5])


def test_language_model_of_many_languages(spark):
    from loam.llm import langid

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word of number "), F.col("id").cast("string")).alias("text"), (F.col("id") % 1500).cast("string").alias("lang"))
    assert len(langid.fit(df, 1).langs) <= 256


# 9


def lengths_of(sf):
    """About the tokens of the driver's documents, cut to sequences: a histogram."""
    from pathlib import Path

    import numpy as np
    import pyarrow.parquet as pq

    at = Path(sf, "documents.parquet")
    n = np.array([x or 0 for f in ([at] if at.is_file() else sorted(at.glob("*.parquet"))) for x in pq.read_table(f, columns=["n_chars"]).column(0).to_pylist()]) // 4 + 1
    out = np.bincount((n - 1) % 2048 + 1, minlength=2049)
    out[2048] += ((n - 1) // 2048).sum()
    return out


@pytest.mark.parametrize(("sf", "share"), [("/root/testdata/sf0.01", 0.15), ("/root/testdata/sf0.1", 0.1)])
def test_patterns_pack_most_of_the_drivers_documents(monkeypatch, sf, share):
    import numpy as np

    from loam.llm import packing

    histogram, left = lengths_of(sf), []
    fit = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda h, n: (left.append(int(h.sum())), fit(h, n))[1])
    packs = packing.plan(histogram)
    used = np.zeros(2049, np.int64)
    for lengths, times in packs:
        assert sum(lengths) <= 2048 and times > 0
        np.add.at(used, lengths, times)
    assert (used == histogram).all()
    assert sum(n for _, n in packs) == -(-int((histogram * np.arange(2049)).sum()) // 2048), "as few sequences as the tokens need"
    assert min(left) < share * histogram.sum()


def nnls(a, b):
    """Non-negative least squares by an active set, for small problems."""
    import numpy as np

    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        w = a.T @ (b - a @ x)
        if free.all() or w[~free].max() < 1e-9:
            break
        free[np.flatnonzero(~free)[w[~free].argmax()]] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x += step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


@pytest.mark.parametrize("seed", range(4))
def test_fit_is_a_non_negative_least_squares_solution(seed):
    import numpy as np

    from loam.llm import packing

    length = 20
    histogram = np.random.default_rng(seed).integers(0, 40, length + 1).astype(float)
    histogram[[0, length]] = 0
    pattern = packing.patterns(length)[1:]
    pattern = pattern[((pattern == 0) | (histogram[pattern] > 0)).all(1)]
    a = np.zeros((length + 1, len(pattern)))
    for j, p in enumerate(pattern):
        for v in p[p > 0]:
            a[v, j] += 1
    weight = np.sqrt(np.where(np.arange(length + 1) > 0, 1 / (1 + histogram), 0))[:, None]
    loss = lambda x: float(((weight[:, 0] * (a @ x - histogram)) ** 2).sum())
    best, got = loss(nnls(weight * a, weight[:, 0] * histogram)), packing.repeats(pattern, histogram, 3000)
    assert (got >= 0).all() and loss(got) <= best * 1.001 + 1e-6


def test_joined_units_keep_their_documents():
    import numpy as np

    from loam.llm.packing import Units

    units = Units(100, [((5,), 1000), ((7, 9), 333), ((60,), 8), ((99,), 2), ((1,), 1)])
    for seed in range(4):
        before = units.documents()
        units = units.joined(seed)
        assert (units.documents() == before).all()
        assert all(sum(u) == size <= 100 and n > 0 for size, entries in units.by.items() for u, n in entries)
    h = units.histogram()
    size = int(np.flatnonzero(h)[0])
    got = units.sequences([size], int(h[size]))
    assert sum(n for _, n in got) == h[size] and all(sum(x) == size for x, _ in got) and not units.by[size]


# 4


def test_places_counted_in_the_whole_table(spark, monkeypatch):
    """The count of passes from all keys is that of a plain loop over sorted keys; a coarse sample leads to it."""
    import numpy as np

    from loam.llm import neardup_vectors as nv

    ship(spark)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 8)) + 3 * rng.standard_normal(8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(nv, "WINDOW", 12)
    monkeypatch.setattr(nv, "PASSES", 2)
    monkeypatch.setattr(nv, "MISSED", 0.4)
    classes = spark.createDataFrame([(v.tolist(),) for v in x] + [([1.0, 2.0],)], "embedding array<double>").repartition(4)
    base = x[:200]
    y, met, number = nv.planted(base), np.zeros(200, bool), 0
    while number < 2 or (~met).mean() > 0.4:
        own, a, b = (nv.signs(v, number) for v in (x, base, y))
        low, high = np.minimum(a, b), np.maximum(a, b)
        met |= np.array([((own >= p) & (own <= q)).sum() for p, q in zip(low, high)]) <= 12
        number += 1
    assert nv.counted(classes, base) == number > 2
    monkeypatch.setattr(nv, "COARSE", 0)
    monkeypatch.setattr(nv, "PLANTED", 200)
    passes, n = nv.needed(classes)
    assert n == 3001 and passes[8] > 2


def test_a_table_that_needs_too_many_passes_is_told_of(spark, monkeypatch, caplog):
    import numpy as np

    from loam.llm import neardup_vectors as nv

    monkeypatch.setattr(nv, "MOST", 13)
    monkeypatch.setattr(nv, "WINDOW", 1)
    x = np.random.default_rng(9).standard_normal((3000, 8))
    assert nv.enough(x / np.linalg.norm(x, axis=1, keepdims=True), 3000) == 13
    assert "meet no one" in caplog.text
