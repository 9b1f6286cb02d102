"""Best-fit packing by patterns: non-negative least squares over few-document length patterns, again over joined documents, then best fit for what is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import exact_ranks, save, table
from loam.llm.encoding import encoded

LENGTH = 2048
#: Fits to what the first one's rounding leaves.
REFITS = 2
#: Times that what a fit leaves is joined two by two and fitted again: patterns are of three units at most, and a unit of 1, 2, 4, 8, 16 documents.
JOINS = 4
#: Patterns of joined units that a fit may use, drawn where there are more. Parts of counts that are joined apart, for each length.
DRAWN, SPREAD = 20_000, 16
END = 0


def cut_documents(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, and whole documents' ids never leave the worker.

    A document is its ids and END (null text: END alone). One longer than length is cut so that all pieces
    but the first, which may be shorter, have that length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in encoded(batches, vocabulary):
            n = np.diff(at) + 1
            flat = np.full(int(n.sum()), END, "<u4")
            flat[np.delete(np.arange(len(flat)), np.cumsum(n) - 1)] = ids
            count = -(-n // length)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - 1) % length + 1
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * length)
            size = np.where(piece == 0, first[doc], length)
            view = memoryview(flat).cast("B")
            base = (np.cumsum(n) - n)[doc] + start
            sums = [zlib.crc32(view[4 * a : 4 * (a + s)]) for a, s in zip(base.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(sums, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(length: int) -> np.ndarray:
    """All patterns of one to three documents that fill a sequence exactly, as rows of three lengths (0: none), the longest first."""
    rows = [[length, 0, 0]]
    a = np.arange(1, length // 2 + 1)
    two = np.stack([length - a, a, np.zeros_like(a)], 1)
    three = []
    for c in range(1, length // 3 + 1):
        b = np.arange(c, (length - c) // 2 + 1)
        three.append(np.stack([length - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate([np.array(rows), two, *three]).astype(np.int32)


def repeats(pattern: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum of x * pattern near to the histogram: accelerated projected gradient on the squared error.

    Lengths are weighted by 1 / (1 + count), so that rare long lengths count as much as common short ones.
    """
    weight = 1.0 / (1.0 + histogram)
    weight[0] = 0.0
    used = [pattern[:, i] for i in range(pattern.shape[1])]
    share = np.zeros(len(histogram))
    for u in used:
        share += np.bincount(u, minlength=len(histogram))
    step = 1.0 / np.maximum.reduce([weight[u] * share[u] * 3 for u in used])  # each pattern's own, by the rows of the normal matrix that it meets
    x = np.zeros(len(pattern))
    y, t = x, 1.0
    for _ in range(rounds):
        got = sum(np.bincount(u, y, len(histogram)) for u in used)
        gap = weight * (histogram - got)
        new = np.maximum(0.0, y + step * sum(gap[u] for u in used))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def best_fit(left: np.ndarray, length: int) -> list[tuple[list[int], int]]:
    """Pack what a histogram has left, longest first, each into the fullest sequence with room; equal sequences at once.

    Gives (lengths in order, repeats). Works on counts, so its cost doesn't grow with the documents.
    """
    left = left.copy()
    open_: dict[int, list[list]] = {}  # room -> [lengths, repeats]
    done: list[tuple[list[int], int]] = []
    for size in range(length, 0, -1):
        n = int(left[size])
        rooms = sorted(r for r in open_ if r >= size)
        for room in rooms:
            each = room // size  # the same sequence can take several
            entries = open_.pop(room)
            while entries and n:
                lengths, times = entries.pop()
                if n >= times:
                    k = min(each, n // times)
                    put, n = (lengths + [size] * k, times), n - k * times
                    rest = None
                else:
                    put, rest, n, k = (lengths + [size], n), [lengths, times - n], 0, 1
                if room - k * size:
                    open_.setdefault(room - k * size, []).append([*put])
                else:
                    done.append(put)
                if rest:
                    entries.append(rest)
            if entries:
                open_.setdefault(room, []).extend(entries)
            if not n:
                break
        if n:
            each = length // size
            full, rest = divmod(n, each)
            for k, times in ((each, full), (rest, 1)):
                if k and times:
                    if length - k * size:
                        open_.setdefault(length - k * size, []).append([[size] * k, times])
                    else:
                        done.append(([size] * k, times))
    return done + [(lengths, times) for entries in open_.values() for lengths, times in entries]


def rounded(present: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns with whole repeats near x, taken out of left. Rounding goes along the ordered patterns and carries what it cut off, so that neighbours share it."""
    order = np.lexsort((present[:, 2], present[:, 1], present[:, 0]))
    counts = np.diff(np.floor(np.cumsum(x[order]) + 0.5).astype(np.int64), prepend=0)
    out = []
    for j, n in zip(order[counts > 0].tolist(), counts[counts > 0].tolist()):
        lengths = [int(v) for v in present[j] if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min(n, *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            out.append((lengths, n))
            for v, k in need.items():
                left[v] -= k * n
    return out


def completed(present: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns once each, those with the largest fitted repeats first, as long as left has their lengths; taken out of it."""
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        lengths = [v for v in present[j].tolist() if v]
        need = {v: lengths.count(v) for v in lengths}
        if all(left[v] >= k for v, k in need.items()):
            out.append((lengths, 1))
            for v, k in need.items():
                left[v] -= k
    return out


def fitted(left: np.ndarray, length: int, most: int | None = None, seed: int = 0, complete: bool = True) -> list[tuple[list[int], int]]:
    """Patterns with repeats, taken out of left: a fit that is rounded, then fits to what that leaves; complete adds single patterns to each."""
    out: list[tuple[list[int], int]] = []
    present = patterns(length)
    for _ in range(1 + REFITS):
        present = present[((present == 0) | (left[present] > 0)).all(1)]
        if most is not None and len(present) > most:
            present = present[np.sort(np.random.default_rng(seed).choice(len(present), most, replace=False))]
        if not len(present):
            break
        x = repeats(present, left.astype(float))
        out += rounded(present, x, left)
        if complete:
            out += completed(present, x, left)
    return out


class Units:
    """Documents or joined ones by length: tuples of lengths with counts."""

    def __init__(self, length: int, entries: list[tuple[tuple[int, ...], int]]):
        self.length = length
        self.by: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for unit, n in entries:
            if n:
                self.by.setdefault(sum(unit), []).append((unit, n))

    def histogram(self) -> np.ndarray:
        out = np.zeros(self.length + 1, np.int64)
        for size, entries in self.by.items():
            out[size] = sum(n for _, n in entries)
        return out

    def documents(self) -> np.ndarray:
        out = np.zeros(self.length + 1, np.int64)
        for entries in self.by.values():
            for unit, n in entries:
                for v in unit:
                    out[v] += n
        return out

    def take(self, size: int, n: int) -> list[tuple[tuple[int, ...], int]]:
        got, entries = [], self.by[size]
        while n:
            unit, have = entries.pop()
            k = min(n, have)
            got.append((unit, k))
            n -= k
            if have > k:
                entries.append((unit, have - k))
        return got

    def sequences(self, pattern: list[int], n: int) -> list[tuple[list[int], int]]:
        """The documents' lengths of n sequences of a pattern of units."""
        out, queues = [], [self.take(size, n) for size in pattern]
        while queues[0]:
            k = min(q[-1][1] for q in queues)
            out.append(([v for q in queues for v in q[-1][0]], k))
            for q in queues:
                unit, have = q.pop()
                if have > k:
                    q.append((unit, have - k))
        return out

    def joined(self, seed: int) -> Units:
        """Units joined two by two as chance has it, so that their lengths differ; large counts in parts, of which there are SPREAD for each length of a sequence unless there are as many units. Units that don't fit together stay."""
        parts, spread = [], max(1, SPREAD * self.length // max(1, sum(map(len, self.by.values()))))
        for entries in self.by.values():
            for unit, n in entries:
                k = min(spread, n)
                parts += [[unit, n // k + (i < n % k)] for i in range(k)]
        order = np.random.default_rng(seed).permutation(len(parts))
        out = []
        for i in range(0, len(order) - 1, 2):
            (a, n), (b, m) = parts[order[i]], parts[order[i + 1]]
            k = min(n, m) if sum(a) + sum(b) < self.length else 0
            out += [(a + b, k), (a, n - k), (b, m - k)]
        return Units(self.length, out + [tuple(parts[order[-1]])] * (len(order) % 2))


def plan(histogram: np.ndarray, length: int = LENGTH) -> list[tuple[list[int], int]]:
    """(lengths in order, repeats) that use each length of the histogram (index: length) exactly as often as it occurs.

    Repeats are fitted and rounded, and in a second plan completed, which leaves less but may use up the short documents that long ones need. A sequence
    of three short documents isn't full, so what is left, mostly short ones, is joined two by two
    and fitted again as units, JOINS times; best fit packs the rest as single documents. Of the plans after each
    of these fits, that of the fewest sequences is taken (ties: the least left to best fit).
    """
    best, fewest = [], None
    for complete in (False, True):
        units = Units(length, [((v,), int(n)) for v, n in enumerate(histogram.tolist()) if v])
        out: list[tuple[list[int], int]] = []
        for level in range(1 + JOINS):
            if level:
                units = units.joined(level)
            left = units.histogram()
            chosen = [([length], int(left[length]))] if left[length] else []
            left[length] = 0
            chosen += fitted(left, length, DRAWN if level else None, level, complete)
            for pattern, n in chosen:
                out += units.sequences(pattern, n)
            rest = units.documents()
            whole = out + best_fit(rest, length)
            score = sum(n for _, n in whole), int(rest.sum())
            if fewest is None or score < fewest:
                best, fewest = whole, score
            if not rest.any():
                break
    return best


def places(packs: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For searches by (length, rank): sorted keys length << 40 | first rank, and the sequence and offset of the rank at the key."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in packs:
        offset = 0
        for v in lengths:
            rows.append((v << 40 | taken.get(v, 0), base, offset))
            taken[v] = taken.get(v, 0) + times
            offset += v
        base += times
    rows.sort()
    table_ = np.array(rows, np.int64).reshape(-1, 3)
    return table_[:, 0].copy(), table_[:, 1].copy(), table_[:, 2].copy()


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns sequence_id and offset for pieces (a column length from 1 to length; others pass through).

    The driver gets a histogram (at most `length` rows) and plans on it; pieces of a length get ranks by
    chunks (exact_ranks), so that one length may hold any share of the rows; a rank decides the place.
    The plan, sent to the workers, has at most three entries for each of the length² / 12 patterns that a fit uses, twelve for each of
    DRAWN patterns of joined ones, and a few for each residual length, however many rows there are (figures in the README).
    Null lengths get no place (null). Columns that are named sequence_id or offset are replaced, others pass through; repeated
    rows get places of their own.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = [f"c{i}" for i in range(len(names))]
    size_ = inner[names.index("length")]
    saved = save(pieces.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner))), "pieces")
    spark = saved.sparkSession
    histogram = np.zeros(length + 1, np.int64)
    for row in saved.groupBy(size_).count().collect():  # one row a length
        if row[size_] is not None:
            if not 1 <= row[size_] <= length:
                raise ValueError(f"a piece has length {row[size_]}")
            histogram[row[size_]] = row["count"]
    sent = spark.sparkContext.broadcast(places(plan(histogram, length)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequence, offset = sent.value
        for batch in batches:
            known = np.asarray(batch.column(size_).is_valid())
            size = batch.column(size_).fill_null(0).to_numpy().astype(np.int64)
            rank = batch.column("_rank").to_numpy().astype(np.int64)
            at = np.maximum(np.searchsorted(keys, size << 40 | rank, "right") - 1, 0)
            if len(keys):
                where, place = sequence[at] + (rank - (keys[at] & ((1 << 40) - 1))), offset[at]
            else:
                where = place = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), pa.array(where, mask=~known), pa.array(place, mask=~known)], names=[*inner, "_sequence", "_offset"])

    ranked = exact_ranks(saved, [size_], "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in saved.schema)
    out = ranked.select(*inner, "_rank").mapInArrow(put, f"{schema}, _sequence long, _offset long")
    return out.select(*(F.col(i).alias(c) for c, i in zip(names, inner)), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces with their places; a null or empty text is the end id alone, repeated rows are packed each."""
    cut = cut_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
