"""Language ID: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import crc_mod, lowest, table, with_columns

BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (2, 3, 4)
#: Documents of each language that are learned from, at most; a fifth of them calibrates.
SAMPLE = 600
#: Beside the whole of it, each document is learned from by as many short windows at most, of so many code points at most.
WINDOWS, WINDOW = 6, 240
EPOCHS, RATE = 4, 0.4
#: Share of rightly recognised calibration documents that rejection may cost, and the highest threshold.
COST, HIGHEST = 0.002, 0.6
#: Code points handled at once.
BLOCK = 1 << 19

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, 0 for all but letters, one 0 before each text, so that both borders of its words are its own; where texts start (with the end)."""
    lower = [t.lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])]).astype(np.int64)
    flat = np.frombuffer("".join(["\n" + t for t in lower]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[flat], flat, 0).astype(np.uint32), at


def subwords(c: np.ndarray, start: int, end: int) -> list[np.ndarray]:
    """For each size the bucket of the subword at each position from start to end; BUCKETS where there is none.

    A subword lies in one word with its borders: only its first and last place may be no letter, and not both.
    """
    stop = min(len(c), end + max(SIZES))
    part = np.zeros(end - start + max(SIZES), np.uint32)
    part[0 : stop - start] = c[start:stop]
    n = end - start
    inside = part != 0
    out, h = [], part[:n] * np.uint32(0x9E3779B1)
    ok = np.ones(n, bool)
    for size in range(2, max(SIZES) + 1):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[size - 1 : size - 1 + n] * np.uint32(0xC2B2AE35)
        if size > 2:
            ok &= inside[size - 2 : size - 2 + n]
        if size in SIZES:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
            valid = ok & (inside[:n] | inside[size - 1 : size - 1 + n]) if size == 2 else ok
            out.append(np.where(valid, (mixed >> np.uint32(16)).astype(np.int32), BUCKETS))
    return out


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # BUCKETS + 1 rows, a column a language: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits of whole texts, and whether a text has a letter."""
        c, at = points(texts)
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        columns = [np.ascontiguousarray(self.weights[:, j]) for j in range(len(self.langs))]
        for start in range(0, len(c), BLOCK):
            end = min(len(c), start + BLOCK)
            first, last = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, end, "left")
            heads = np.maximum(at[first:last], start) - start
            for ids in subwords(c, start, end):
                counts[first:last] += np.add.reduceat((ids < BUCKETS).astype(np.float64), heads)
                for j, w in enumerate(columns):
                    sums[first:last, j] += np.add.reduceat(w[ids].astype(np.float64), heads)
        has = np.add.reduceat(c != 0, at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        return sums / np.maximum(counts, 1)[:, None] + self.bias, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """lang, score, rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        z, has = self.logits(texts)
        p = softmax(z / self.temperature)
        best, score = p.argmax(1), np.where(has, p.max(1), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has)], np.clip(score, 0, 1), ~has | (score < self.threshold)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 3) -> Model:
    """Fit on labelled texts: SGD over whole texts and windows of four fifths of them; temperature and rejection threshold from the rest, as whole texts."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4
    examples: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in np.flatnonzero(~held) if (~held).any() else range(len(texts)):
        c, _ = points([texts[i]])
        found = subwords(c, 0, len(c))
        spans = [(0, len(c))]
        for _ in range(min(WINDOWS, -(-len(c) // WINDOW))):
            start = int(rng.integers(0, max(1, len(c) - WINDOW + 1)))
            spans.append((start, start + int(rng.integers(WINDOW // 8, WINDOW + 1))))
        for start, end in spans:
            ids, n = np.unique(np.concatenate([f[start:end] for f in found]), return_counts=True)
            ids, n = ids[ids < BUCKETS], n[ids < BUCKETS]
            if len(ids):
                examples.append((ids, (n / n.sum()).astype(np.float32), int(y[i])))
    # float32 embeddings start small and random, softmax weights at zero, as usual for such models
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((len(langs), DIMENSIONS), np.float32), np.zeros(len(langs), np.float32)
    steps = EPOCHS * len(examples)
    for k in range(EPOCHS):
        for s, i in enumerate(rng.permutation(len(examples))):
            ids, share, label = examples[i]
            rate = np.float32(RATE * (1 - (k * len(examples) + s) / steps))
            rows = embedding[ids]
            hidden = share @ rows
            g = softmax(out @ hidden + bias).astype(np.float32)
            g[label] -= 1
            back = g @ out
            out -= rate * np.outer(g, hidden)
            bias -= rate * np.float32(0.1) * g
            embedding[ids] = rows - (rate * share * np.float32(10))[:, None] * back
    weights = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    weights[:BUCKETS] = embedding @ out.T
    model = Model(langs, weights, bias.astype(float), 1.0, 0.0)
    z, has = model.logits([t for t, h in zip(texts, held) if h])
    z, truth = z[has], y[held][has]
    if len(z) and len(langs) > 1:
        grid = np.geomspace(0.05, 10, 60)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == truth])
        if len(right):
            model.threshold = float(min(HIGHEST, right[int(COST * len(right))]))
    return model


def fit(labelled: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from rows (doc_id, text, lang): of each language at most `most` rows that have a letter, those with the lowest hash of doc_id and text.

    Rows equal in doc_id and text count once; rows without lang, text or letter are left out; other columns don't matter.
    Training sees each text whole, and up to WINDOWS short windows of it besides, so that short texts are known too; calibration whole texts.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = lowest(rows, F.col("lang"), most, F.xxhash64(F.lit(11), "doc_id", "text"), ["doc_id", "text", "lang"])
    order = sorted(range(len(found)), key=lambda i: found[i]["_unit"])
    return train([found[i]["text"] for i in order], [found[i]["lang"] for i in order])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs with lang_pred, score and rejected.

    Null texts and texts without a letter: ``und``, score 0, rejected. Others get the likeliest language and its
    calibrated probability, and are rejected under the model's threshold. With nothing learned all are ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language

    def work(texts: pa.Array) -> list[pa.Array]:
        lang, score, rejected = sent.value.predict([t or "" for t in texts.to_pylist()])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    return with_columns(docs, "text", "lang_pred string, score double, rejected boolean", work, keep)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod("doc_id", 3) != 1)


def op2_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out (null ids aren't: crc32 of null is null, so they aren't learned from either). Null texts and those without a letter are ``und``; repeated rows stay."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(learnable(docs))
    out = predict(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
