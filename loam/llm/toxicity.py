"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import crc_mod, lowest, ragged, table, with_columns
from loam.llm.encoding import marks, stir

#: Labelled documents that are learned from, at most, by label.
EXAMPLES = {0: 900, 1: 600}
#: A term is a word or its first so many letters, so that inflected forms meet.
PREFIXES = (4, 5, 6)
#: A term's weight is (1 + log of its count) * idf * (FLOOR + (1 - FLOOR) * g / (g + HALF)), where g (G²) is how strongly it goes with a label. No term is left out.
FLOOR, HALF = 0.02, 30.0
NEIGHBOURS = 15
#: Examples of a block, and blocks that are scored first.
BLOCK, FIRST = 64, 4
#: Terms of more than this share of the examples are kept as rows of a table, and their part of all cosines of so many texts is one matrix product; the others have postings.
COMMON, TOGETHER = 0.06, 32
#: Votes' worth of the prior.
PRIOR = 0.25
#: Examples whose terms have this Jaccard similarity are copies, which speak once where terms are weighed.
COPIES = 0.75
#: Terms that are named with a score.
NAMED = 5


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, place of the term in names, times) for all distinct terms of each whole text, in this order, and names. Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    coded = words.flatten().dictionary_encode()
    own, size = coded.dictionary, pc.utf8_length(coded.dictionary).to_numpy()
    parts, whose = [own], [np.arange(len(own))]
    for n in PREFIXES:
        has = np.flatnonzero(size >= n)
        start = pc.utf8_slice_codeunits(own.take(pa.array(has)), 0, n)
        parts.append(pc.binary_join_element_wise(start, pa.scalar("-", pa.large_string()), pa.scalar("", pa.large_string())))
        whose.append(has)
    named = pa.concat_arrays(parts).dictionary_encode()
    terms, at = np.full((len(own), len(parts)), -1), 0
    for k, has in enumerate(whose):
        terms[has, k] = named.indices.to_numpy()[at : at + len(has)]
        at += len(has)
    terms[size == 0] = -1
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    pair, times = np.unique(text * max(len(own), 1) + coded.indices.to_numpy(), return_counts=True)
    term = terms[pair % max(len(own), 1)]
    real = term >= 0
    key = ((pair // max(len(own), 1))[:, None] * len(named.dictionary) + term)[real]
    times = np.repeat(times, real.sum(1))
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    head = np.flatnonzero(np.diff(key, prepend=-1))
    total = np.add.reduceat(times, head) if len(head) else times
    return key[head] // max(len(named.dictionary), 1), key[head] % max(len(named.dictionary), 1), total, named.dictionary


@dataclass
class Model:
    ids: np.ndarray  # doc_id of each example
    labels: np.ndarray
    weights: np.ndarray  # rows of the corpus that an example stands for
    terms: pa.Array  # of all examples
    power: np.ndarray  # by term: idf and link
    unknown: float  # that of other terms
    rate: float  # of toxic rows
    silent: float  # the same among rows without any term
    # the index: term -> its blocks (runs) with their highest weight -> postings
    runs: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    highest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    # common terms: their row (else -1), and weights by row and example
    row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    common: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shares: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each whole text the known terms and their weights; all its terms, unknown ones too, make a vector of length 1."""
        text, term, times, names = counts(texts)
        known = pc.fill_null(pc.index_in(names, value_set=self.terms), -1).to_numpy().astype(np.int64)[term]
        return self.scaled(text, known, times, len(texts))

    def scaled(self, text: np.ndarray, known: np.ndarray, times: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        power = np.append(self.power, self.unknown)
        w = (1 + np.log(times)) * power[known]  # -1: the last
        w /= np.sqrt(np.bincount(text, w * w, n))[text]
        text, known, w = text[known >= 0], known[known >= 0], w[known >= 0]
        cut = np.searchsorted(text, np.arange(n + 1))
        return [(known[s:e], w[s:e]) for s, e in zip(cut[:-1], cut[1:])]

    def index(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Postings of examples, by term and then block; common terms as a table."""
        of = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        often = np.bincount(term, minlength=len(self.terms)) > COMMON * len(vectors)
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.common = np.zeros((int(often.sum()), len(vectors)))
        dense = often[term]
        self.common[self.row[term[dense]], of[dense]] = weight[dense]
        of, term, weight = of[~dense], term[~dense], weight[~dense]
        by = np.lexsort((of, term))
        of, term, weight = of[by], term[by], weight[by]
        blocks = max(1, -(-len(vectors) // BLOCK))
        key = term * blocks + of // BLOCK
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.runs = np.searchsorted(key[head] // blocks, np.arange(len(self.terms) + 1)).astype(np.int32)
        self.block = key[head] % blocks
        self.highest = np.maximum.reduceat(weight, head) if len(head) else weight
        self.first = np.append(head, len(key)).astype(np.int32)
        self.place, self.weight = of.astype(np.int64), weight

    def shared(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The common terms' part of the cosines of vectors with all examples."""
        dense = np.zeros((len(vectors), len(self.common)))
        for i, (at, w) in enumerate(vectors):
            row = self.row[at]
            dense[i, row[row >= 0]] = w[row >= 0]
        return dense @ self.common

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of the highest cosine above 0 (ties: the earlier example), exactly. without: an example each that is left out.

        A block's bound is the highest part of common terms in it and the sum of the other terms' highest weights; blocks
        are scored from the highest bound on, in groups that grow, until no other can reach the k-th sum so far.
        """
        n, size = len(vectors), len(self.ids)
        if not size or not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        dots, starts = self.shared(vectors), np.arange(0, size, BLOCK)
        if without is not None:
            dots[np.arange(n), without] = -np.inf
        at, w = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
        who = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        rare = self.row[at] < 0
        at, w, who = at[rare], w[rare], who[rare]
        many = self.runs[at + 1] - self.runs[at]
        run = ragged(self.runs[at], many)
        each, who = np.repeat(w, many), np.repeat(who, many)
        cell = who * len(starts) + self.block[run]
        bound = np.bincount(cell, each * self.highest[run], n * len(starts)).reshape(n, -1) + np.maximum.reduceat(dots, starts, axis=1)
        rank = np.empty(bound.shape, np.int64)
        np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.broadcast_to(np.arange(len(starts)), bound.shape), 1)
        least = lambda: np.partition(dots, -k, axis=1)[:, -k] if size > k else np.full(n, -np.inf)
        start, group = 0, FIRST
        while start < len(starts):
            chosen = (rank >= start) & (rank < start + group) & (bound >= least()[:, None] - 1e-9)
            if not chosen.any():
                break
            use = np.flatnonzero(chosen.ravel()[cell])
            s = self.first[run[use]]
            length = self.first[run[use] + 1] - s
            rows = ragged(s, length)
            dots += np.bincount(np.repeat(who[use] * size, length) + self.place[rows], np.repeat(each[use], length) * self.weight[rows], n * size).reshape(n, -1)
            start, group = start + group, group * 4
        dots = dots.round(9)
        out = []
        for own, low in zip(dots, np.maximum(least(), 1e-9)):
            found = np.flatnonzero(own >= low)
            best = found[np.lexsort((found, -own[found]))[:k]]
            out.append((best, own[best]))
        return out

    def vote(self, found: np.ndarray, score: np.ndarray) -> float:
        """The neighbours' distance-weighted share of toxic rows, drawn to the overall rate by PRIOR votes."""
        each = 1.0 / (1.05 - np.minimum(score, 1.0))  # weight by distance
        each *= self.weights[found] / max(self.weights[found].mean(), 1e-12) if len(found) else 1.0
        return float(((each * self.labels[found]).sum() + PRIOR * self.rate) / (each.sum() + PRIOR))

    def calibrated(self, vote: float) -> float:
        """The share of toxic rows among examples of such votes, and a twentieth of the vote itself, which tells equal shares apart."""
        return 0.95 * float(np.interp(vote, self.knots, self.shares)) + 0.05 * vote if len(self.knots) else vote

    def score(self, texts: pa.Array) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text: score, the neighbours' places, and its known terms of the highest weight."""
        out = []
        vectors = self.vectors(texts)
        for s in range(0, len(vectors), TOGETHER):
            part = vectors[s : s + TOGETHER]
            for (at, w), (found, much) in zip(part, self.nearest(part)):
                some = np.argpartition(-w, NAMED)[:NAMED] if len(w) > NAMED else np.arange(len(w))
                out.append((self.calibrated(self.vote(found, much)) if len(found) else self.silent, found, at[some[np.argsort(-w[some], kind="stable")]]))
        return out


def link(a: np.ndarray, n: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """G² of terms: a of the n examples with the term are toxic, of all toxic of total."""

    def part(o: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)

    rows, cols = (n, total - n), (toxic, total - toxic)
    seen = ((a, n - a), (toxic - a, total - n - toxic + a))
    return 2 * sum(part(seen[i][j], rows[i] * cols[j] / total) for i in (0, 1) for j in (0, 1))


def families(text: np.ndarray, term: np.ndarray, names: pa.Array, labels: np.ndarray) -> np.ndarray:
    """Examples that aren't copies of an earlier one with their label: candidates share one of four lowest hashes, and Jaccard similarity of the terms decides."""
    n, hashes = len(labels), marks(names.cast(pa.large_string()))[0]
    cut = np.searchsorted(text, np.arange(n + 1))
    own = [term[s:e] for s, e in zip(cut[:-1], cut[1:])]
    lows = [stir(hashes ^ np.uint64(salt), 0xBF58476D1CE4E5B9, 0x94D049BB133111EB) for salt in (0x51ED, 0xA3F7, 0x1B9D, 0xC64B)]
    seen: dict[tuple[int, int, int], list[int]] = {}
    first = []
    for i in range(n):
        marks_ = [(j, int(labels[i]), int(low[own[i]].min())) for j, low in enumerate(lows)] if len(own[i]) else []
        others = {o for m in marks_ for o in seen.get(m, [])}
        both = lambda o: len(np.intersect1d(own[i], own[o], assume_unique=True))  # noqa: B023, E731
        if any((b := both(o)) >= COPIES * (len(own[i]) + len(own[o]) - b) for o in others):
            continue
        first.append(i)
        for m in marks_:
            seen.setdefault(m, []).append(i)
    return np.array(first, np.int64)


def train(ids: list[int], texts: list[str], labels: list[int], rows: dict[int, int]) -> Model:
    """Weigh all terms of the examples, index them, and calibrate on votes in which no example counts for itself.

    rows: labelled rows of each label that the examples stand for.
    """
    text, term, times, names = counts(pa.array(texts, pa.large_string()))
    y = np.array(labels, float)
    sample = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([max(rows.get(int(c), 0), 1) / sample[int(c)] for c in y])
    rate = float((weights * y).sum() / weights.sum()) if len(y) else 0.0
    first = np.zeros(len(y), bool)
    first[families(text, term, names, y)] = True
    n = np.bincount(term[first[text]], minlength=len(names)).astype(float)
    toxic = np.bincount(term[(first & (y == 1))[text]], minlength=len(names)).astype(float)
    total, bad = int(first.sum()), int((first & (y == 1)).sum())
    g = np.maximum(link(toxic, n, bad, total), 0) if 0 < bad < total else np.zeros(len(names))
    power = np.log((1 + total) / (0.5 + n)) * (FLOOR + (1 - FLOOR) * g / (g + HALF))
    model = Model(np.array(ids, np.int64), y, weights, names, power, float(np.log((1 + total) / 0.5) * FLOOR), rate, rate)
    vectors = model.scaled(text, term, times, len(y))
    # examples with the same commonest and the same strongest term stand together (languages, kinds), so that blocks differ in their bounds
    share = np.bincount(term, minlength=len(names))
    alike = [(int(at[np.argmax(share[at])]), int(at[np.argmax(w)])) if len(at) else (-1, -1) for at, w in vectors]
    order = sorted(range(len(y)), key=lambda i: (*alike[i], ids[i]))
    model.ids, model.labels, model.weights = model.ids[order], y[order], weights[order]
    vectors = [vectors[i] for i in order]
    model.index(vectors)
    silent = np.array([not len(at) for at, _ in vectors], bool)
    if silent.any():
        k = model.weights[silent]
        model.silent = float(((k * model.labels[silent]).sum() + rate) / (k.sum() + 1))
    if 0 < y.sum() < len(y):
        near = [x for i in range(0, len(y), TOGETHER) for x in model.nearest(vectors[i : i + TOGETHER], without=np.arange(i, min(len(y), i + TOGETHER)))]
        has = [i for i, (found, _) in enumerate(near) if len(found)]
        votes, truth, much = np.array([model.vote(*near[i]) for i in has]), model.labels[has], model.weights[has]
        if len(set(truth)) == 2:
            model.knots, model.shares = isotonic(votes, truth, much)
    return model


def isotonic(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function of the votes that is nearest to the truth: neighbours that would fall are pooled.

    Unlike a curve of two parameters it isn't bent for all votes by wrong labels at one end.
    """
    at, of = np.unique(votes, return_inverse=True)
    pools: list[list[float]] = []  # weight, weight times truth, first vote, last vote
    for v, w, wy in zip(at.tolist(), np.bincount(of, weight).tolist(), np.bincount(of, weight * truth).tolist()):
        pools.append([w, wy, v, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    x = np.array([v for p in pools for v in p[2:]])
    return x, np.repeat([p[1] / p[0] for p in pools], 2)


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None) -> Model:
    """Learn from labels (doc_id, toxic) and the texts of docs (doc_id, text).

    Rows with null doc_id or toxic are left out; a doc_id labelled both ways counts as toxic; of several
    texts of one doc_id the least is taken; null texts are empty. The sample of `most` rows by label is
    chosen by a hash of doc_id among labelled rows.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of_label = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [r for c, m in (most or EXAMPLES).items() for r in lowest(known.filter(F.col("toxic") == c), None, m, F.xxhash64(F.lit(5), "doc_id"), ["doc_id", "toxic"])]
    chosen = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in sample], "doc_id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # at most as many as EXAMPLES
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["doc_id"] for r in rows], [r["text"] or "" for r in rows], [r["toxic"] for r in rows], of_label)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs with score, predicted, evidence (doc_ids of the nearest examples) and terms (the NAMED known terms of the highest weight in the text).

    Texts without any term of the examples (empty and null ones too) get the toxic share of such examples. A column of
    docs that is named like a new one is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES

    def work(texts: pa.Array) -> list[pa.Array]:
        own = sent.value
        got = own.score(texts)
        cut = np.cumsum([0, *(len(g[1]) for g in got)]).astype(np.int32)
        near = np.concatenate([np.zeros(0, np.int64), *(g[1] for g in got)])
        names = np.cumsum([0, *(len(g[2]) for g in got)]).astype(np.int32)
        strong = np.concatenate([np.zeros(0, np.int64), *(g[2] for g in got)])
        return [
            pa.array([g[0] for g in got], pa.float64()),
            pa.array([int(g[0] >= 0.5) for g in got], pa.int32()),
            pa.ListArray.from_arrays(pa.array(cut), pa.array(own.ids[near])),
            pa.ListArray.from_arrays(pa.array(names), own.terms.take(pa.array(strong)).cast(pa.string())),
        ]

    return with_columns(docs, "text", "score double, predicted int, evidence array<bigint>, terms array<string>", work, keep)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_mod("doc_id", 5) != 0)


def op10_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with scores; labels of held-out rows aren't learned from. Null and empty texts get the toxic share of labelled empty ones (else of all), repeated rows one row each."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    out = score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")
