"""Exact Jaccard self-join on word shingles by universe partition: segments of the hashed universe, one-deletion neighbours, pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import drop, exact_ranks, pieces, save, table
from loam.llm.components import components, forest
from loam.llm.encoding import byte_hashes
from loam.llm.neardup_vectors import whole_groups

WORDS = 5
#: Two sets link when SHARE[1] * intersection >= SHARE[0] * union.
SHARE = (75, 100)
#: A signature with more sets is dropped, and its sets count a segment less (sets that fall short get another way).
LONGEST = 32
#: Sets of one signature that a sender passes on one by one to be chained; of more it sends the ends of size classes.
CHAINED = 8
#: Signatures that a reducer sorts at once, and sets of a tile whose pairs are verified together.
SORTED, TILE = 1_500_000, 192
#: Buckets of signatures, at least; more for more than SORTED in each.
BUCKETS, BUCKETS_AGAIN = 64, 8
#: Tasks that the pairs of one set are dealt to where they meet what is known of the set.
SALTS = 8
#: Rows of a side that is broadcast, at most; beyond, an ordinary join.
SMALL = 400_000

U = np.uint64
_BYTES = np.arange(256, dtype=np.uint8)
#: By byte: A-Z in lower case; what stands between words.
LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES + np.uint8(32), _BYTES)
WHITE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of whole texts, A-Z lower-cased, in their order, and the text that each is of."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = offsets - offsets[0]
    if not at[-1]:
        return np.zeros(0, U), np.zeros(0, np.int64)
    d = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    edge = np.ones(len(d) + 1, bool)  # before a byte: white space or another text
    white = WHITE[d]
    edge[1:] = white
    last = np.ones(len(d) + 1, bool)  # after it
    last[:-1] = white
    edge[at], last[at] = True, True
    start, end = np.flatnonzero(edge[:-1] & ~white), np.flatnonzero(last[1:] & ~white) + 1
    return byte_hashes(d, start, end - start), np.searchsorted(at, start, "right") - 1


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of whole texts, ordered within each text, and where each text's begin (with the end)."""
    n = len(texts)
    h, of = word_hashes(texts)
    count = np.bincount(of, minlength=n)
    full = max(len(h) - words + 1, 0)
    rolled = h[:full].copy()
    for j in range(1, words):
        rolled = mix(rolled, j) ^ h[j : j + full]
    same = of[:full] == of[words - 1 : words - 1 + full]
    rolled, at = mix(rolled, words)[same], of[:full][same]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        whole = np.array([xxhash.xxh3_64_intdigest(h[begin[i] : begin[i + 1]].tobytes(), seed=77) for i in short], U)
        rolled, at = np.concatenate([rolled, whole]), np.concatenate([at, short])
    order = np.argsort(rolled)
    order = order[np.argsort(at[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]  # few texts: counted, not compared
    rolled, at = rolled[order], at[order]
    keep = np.ones(len(rolled), bool)
    keep[1:] = (rolled[1:] != rolled[:-1]) | (at[1:] != at[:-1])
    rolled, at = rolled[keep], at[keep]
    return rolled, np.searchsorted(at, np.arange(n + 1))


def class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; documents with equal sets are one class."""
    return np.fromiter((xxhash.xxh3_64_intdigest(sets[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])), U, len(at) - 1).view(np.int64)


def differ(x: int, y: int, share: tuple[int, int] = SHARE) -> int:
    """The largest symmetric difference of linked sets of sizes x and y."""
    return (share[1] - share[0]) * (x + y) // (share[1] + share[0])


@lru_cache(None)
def allocation(band: int, share: tuple[int, int] = SHARE) -> tuple[int, int]:
    """Segments of the universe for sets of 2**band to 2**(band + 1) - 1 shingles, and how many of them get one-deletion neighbourhoods.

    A segment with equal parts detects a pair; one with one-deletion neighbours also parts that differ in one
    token, and counts twice if a set has two tokens there. A set is safe if its counts exceed the largest
    difference to any partner. Among the choices that make nearly all sets of the band and the largest partners of
    the next one safe, that of the lowest cost is taken: signatures sent, and expected chance meetings of small parts.
    """
    low = 2**band
    best = None
    sizes = [low, low * 3 // 2, 2 * low - 1, max(2 * low - 1, (2 * low - 1) * share[1] // share[0])]
    for tenth in range(2, 31):
        m = max(2, math.ceil(low * tenth / 10 + 2 * math.sqrt(low) * (tenth > 4)))
        for d in sorted({0, m // 4, m // 2, m}):
            cost, safe = 0.0, True
            for i, n in enumerate(sizes):
                p0, p1 = (1 - 1 / m) ** n, n / m * (1 - 1 / m) ** (n - 1)
                units = m * (1 - p0) + d * max(0.0, 1 - p0 - p1)
                spread = math.sqrt(m * p0 * (1 - p0)) + 0.5
                need = (differ(n, n, share) if i == 3 else differ(n, n * share[1] // share[0], share)) + 1
                safe &= units - 2 * spread >= need
                cost += m * (1 - p0) + d * n / m + 0.5 * m * p1
            if safe and (best is None or cost < best[0]):
                best = (cost, m, d)
    return best[1:] if best else (4 * low, 4 * low)


def schemes(n: int, share: tuple[int, int] = SHARE) -> list[int]:
    """Bands whose segments a set of n shingles is cut by: its own, and the one below if it can have partners there."""
    own = n.bit_length() - 1
    return [own, own - 1] if own and share[1] * (2**own - 1) >= share[0] * n else [own]


def required(n: int, band: int, share: tuple[int, int] = SHARE) -> int:
    """Counts that make a set safe: against larger partners in its own band's segments, against smaller ones below."""
    return 1 + (differ(n, n * share[1] // share[0], share) if n >> band == 1 else differ(n, n, share))


def signatures(sets: np.ndarray, at: np.ndarray, share: tuple[int, int] = SHARE) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By band: band, which sets, counts of each, and signatures with the (local) set of each. The lowest bit tells a segment with one-deletion neighbours."""
    n = np.diff(at)
    use: dict[int, list[int]] = {}
    for i in np.flatnonzero(n > 1).tolist():  # sets of one shingle link only with equal ones
        for band in schemes(int(n[i]), share):
            use.setdefault(band, []).append(i)
    out = []
    for band, rows in sorted(use.items()):
        m, d = allocation(band, share)
        rows_ = np.array(rows)
        size = n[rows_]
        owner = np.repeat(np.arange(len(rows_)), size)
        ends = np.cumsum(size)
        token = sets[np.repeat(at[rows_] - (ends - size), size) + np.arange(int(ends[-1]))]
        segment = (mix(token, 101 + band) % U(m)).astype(np.int64)
        key = owner * m + segment
        order = np.argsort(key, kind="stable")
        key, token = key[order], mix(token[order], 5)
        head = np.flatnonzero(np.diff(key, prepend=-1))
        many = np.diff(head, append=len(key))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(token, head)
        seg, who = key[head] % m, key[head] // m
        twice = seg < d
        sign = lambda value, segment: mix(value ^ mix(segment.astype(U), 1000 + band)) & ~U(1) | (segment < d).astype(U)
        sig, set_ = [sign(total, seg)], [who]
        units = np.bincount(who, 1 + (twice & (many > 1)), len(rows_)).astype(np.int64)
        if d:
            part = np.repeat(np.arange(len(head)), many)
            less = twice[part] & (many[part] > 1)
            with np.errstate(over="ignore"):
                sig.append(sign(total[part[less]] - token[less], seg[part[less]]))
            set_.append(who[part[less]])
        out.append((band, rows_, units, np.concatenate(sig), np.concatenate(set_)))
    return out


SENT = "bucket int, cid long, n int, band int, units int, sigs binary, other long"


def distinct(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures in order, with their sets; a set's repeats once."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
    return sig[keep], who[keep]


def without_long(sig: np.ndarray, who: np.ndarray, units: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leave out signatures that are known to be long (sorted), and deduct them from their sets' counts here.

    A signature with over LONGEST sets among these is long wherever else it occurs: LONGEST + 1 of them still send
    it, so that its bucket sees that it is and deducts it from all others that do. Gives the rest, the counts and the long ones.
    """
    ordered = np.sort(sig)
    head, many = runs(ordered)
    often = ordered[head[many > LONGEST]]
    mask = np.isin(sig, np.union1d(long, often)) if len(long) or len(often) else np.zeros(len(sig), bool)
    if not mask.any():
        return sig, who, units, long
    s, w = distinct(sig[mask], who[mask])
    head, many = runs(s)
    known = np.isin(s, long)
    place, size = np.arange(len(s)) - np.repeat(head, many), np.repeat(many, many)
    gone = known | ((size > LONGEST) & (place > LONGEST))
    units = units.copy()
    np.subtract.at(units, w[gone], 1 + (s[gone] & U(1)).astype(np.int64))
    return np.concatenate([sig[~mask], s[~gone]]), np.concatenate([who[~mask], w[~gone]]), units, np.union1d(long, s[head[(many > LONGEST) & ~known[head]]])


def linked_here(sig: np.ndarray, who: np.ndarray, n: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chain the sets (of sizes n) of each signature with over CHAINED sets here, and leave only the smallest and the largest of each size class to be sent.

    Classes are so narrow that all sizes of one fit each other, and a signature's chain over all senders' ends has the
    same components as one over all its sets. Gives the rest of (signature, set), and a forest of the links.
    """
    order = np.lexsort((who, n[who], sig))
    sig, who = sig[order], who[order]
    head, many = runs(sig)
    busy = np.repeat(many > CHAINED, many)
    size = n[who]
    next_ = busy[1:] & (sig[1:] == sig[:-1]) & (share[1] * size[:-1] >= share[0] * size[1:]) & (who[1:] != who[:-1])
    kind = np.floor(np.log(np.maximum(size, 1)) / math.log(share[1] / share[0]) - 1e-9).astype(np.int64)
    edge = np.ones(len(sig) + 1, bool)
    edge[1:-1] = (sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1])
    keep = ~busy | edge[:-1] | edge[1:]
    a, b = forest(who[:-1][next_], who[1:][next_])
    return sig[keep], who[keep], a, b


def send(docs: DataFrame, buckets: int, share: tuple[int, int], words: int, again: bool = False) -> DataFrame:
    """Signatures of the texts of docs (text), a row for each set, band and bucket; equal sets of a slice once.

    A task that meets a long signature sends it for LONGEST + 1 sets and deducts it from the others. again, for the
    second round: signatures of any length; sets that even all their segments don't make safe also send each shingle as a
    segment of its own (band -1); a signature with many sets here is chained here, and rows with other instead
    of sigs are links.
    """
    shift = U(64 - (buckets.bit_length() - 1))

    def batch(bucket: np.ndarray, cid: np.ndarray, n: np.ndarray, band: int, units: np.ndarray, sig: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        blob = pa.Array.from_buffers(pa.binary(), len(cid), [None, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(sig.tobytes())])
        columns = [pa.array(bucket.astype(np.int32)), pa.array(cid), pa.array(n.astype(np.int32)), pa.array(np.full(len(cid), band, np.int32)), pa.array(units.astype(np.int32)), blob, pa.nulls(len(cid), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long: dict[int, np.ndarray] = {}
        for piece in pieces(batches):
            sets, at = shingle_sets(piece.column("text"), words)
            cid = class_ids(sets, at)
            first = np.unique(cid, return_index=True)[1]
            if len(first) < len(cid):
                size = np.diff(at)[first]
                ends = np.cumsum(size)
                sets = sets[np.repeat(at[first] - (ends - size), size) + np.arange(int(ends[-1]))]
                at, cid = np.concatenate([[0], ends]), cid[first]
            n = np.diff(at)
            parts = signatures(sets, at, share)
            if again:
                lacking = sorted({int(i) for band, rows, units, _, _ in parts for i, u in zip(rows, units) if u < required(int(n[i]), band, share)})
                if lacking:
                    rows = np.array(lacking)
                    parts.append((-1, rows, n[rows], np.concatenate([mix(sets[at[i] : at[i + 1]], 9) & ~U(1) for i in lacking]), np.repeat(np.arange(len(rows)), n[rows])))
            for band, rows, units, sig, who in parts:
                if again:
                    sig, who = distinct(sig, who)
                    sig, who, a, b = linked_here(sig, who, n[rows], share)
                    if len(a):
                        none = lambda kind: pa.nulls(len(a), kind)  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([pa.array(a % buckets, pa.int32()), pa.array(cid[rows[a]]), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.binary()), pa.array(cid[rows[b]])], names=NAMES)
                else:
                    sig, who, units, long[band] = without_long(sig, who, units, long.get(band, np.zeros(0, U)))
                    bare = np.setdiff1d(np.arange(len(rows)), who)  # all deducted: the set itself must be told
                    if len(bare):
                        yield batch(cid[rows[bare]] & (buckets - 1), cid[rows[bare]], n[rows[bare]], band, units[bare], np.zeros(0, U), np.zeros(len(bare) + 1, np.int64))
                bucket = (sig >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(sig), np.int64)
                order = np.lexsort((sig, bucket, who)) if buckets > 1 else np.lexsort((sig, who))
                sig, key = sig[order], who[order] * buckets + bucket[order]
                head = np.flatnonzero(np.diff(key, prepend=-1))
                own = rows[key[head] // buckets]
                yield batch(key[head] % buckets, cid[own], n[own], band, units[key[head] // buckets], sig, np.append(head, len(sig)))

    return docs.select("text").mapInArrow(run, SENT)


NAMES = ["bucket", "cid", "n", "band", "units", "sigs", "other"]


def met(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """A bucket's signatures in order, without repeats: signature, place of its set among the distinct ones, and these sets' ids, sizes, bands and counts."""
    cid, n, band, units = (batch.column(c).to_numpy() for c in ("cid", "n", "band", "units"))
    sigs = batch.column("sigs")
    if not len(sigs):
        return np.zeros(0, U), np.zeros(0, np.int64), cid, n, band, units
    offsets = np.frombuffer(sigs.buffers()[1], np.int32)[sigs.offset : sigs.offset + len(sigs) + 1]
    flat = np.frombuffer(sigs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(U) if offsets[-1] > offsets[0] else np.zeros(0, U)
    key = np.rec.fromarrays([cid, band])
    distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
    del distinct
    who = np.repeat(back, np.diff(offsets) // 8)
    order = np.argsort(flat, kind="stable")
    sig, who = flat[order], who[order]
    # repeats: equal sets sent by several tasks
    again = np.lexsort((who, sig)) if len(first) < len(cid) else None
    if again is not None:
        sig, who = sig[again], who[again]
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who = sig[keep], who[keep]
    return sig, who, cid[first], n[first], band[first], units[first]


def runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    return head, np.diff(head, append=len(sig))


FOUND = "a long, b long, n_a int, n_b int, units_a int, units_b int, band int, meetings long, lost long"


def meet(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs that share signatures with at most LONGEST sets, with the number they share here; and (b null) sets with counts lost to longer ones or too few from the start."""
    for batch in whole_groups(batches, "bucket"):
        sig, who, cid, n, band, units = met(batch)
        head, many = runs(sig)
        lost = np.zeros(len(cid), np.int64)
        long = np.repeat(many > LONGEST, many)
        np.add.at(lost, who[long], 1 + (sig[long] & U(1)).astype(np.int64))
        need = np.array([required(int(x), int(b), share) for x, b in zip(n, band)], np.int64)
        tell = np.flatnonzero((lost > 0) | (units < need))
        key: list[np.ndarray] = []
        for c in np.unique(many[(many > 1) & (many <= LONGEST)]):
            sets = np.sort(who[head[many == c][:, None] + np.arange(c)], axis=1)
            i, j = np.triu_indices(int(c), 1)
            x, y = sets[:, i].ravel(), sets[:, j].ravel()
            fits = (share[1] * np.minimum(n[x], n[y]) >= share[0] * np.maximum(n[x], n[y])) & (x != y)
            key.append(x[fits] * len(cid) + y[fits])
        pair, times = np.unique(np.concatenate([np.zeros(0, np.int64), *key]), return_counts=True)
        x, y = pair // max(len(cid), 1), pair % max(len(cid), 1)
        swap = cid[x] > cid[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        none = lambda k, t: pa.nulls(k, t)
        long_, int_ = pa.int64(), pa.int32()
        k, t = len(tell), len(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(cid[x]), pa.array(cid[tell])]),
                pa.concat_arrays([pa.array(cid[y]), none(k, long_)]),
                pa.concat_arrays([pa.array(n[x]), pa.array(n[tell])]),
                pa.concat_arrays([pa.array(n[y]), none(k, int_)]),
                pa.concat_arrays([pa.array(units[x]), pa.array(units[tell])]),
                pa.concat_arrays([pa.array(units[y]), none(k, int_)]),
                pa.concat_arrays([pa.array(band[x]), pa.array(band[tell])]),
                pa.concat_arrays([pa.array(times), none(k, long_)]),
                pa.concat_arrays([none(t, long_), pa.array(lost[tell])]),
            ],
            names=["a", "b", "n_a", "n_b", "units_a", "units_b", "band", "meetings", "lost"],
        )


def chain(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Edges that join all sets of a signature, in order of size, where sizes allow a link; any number of sets. A bucket sends a forest of them."""
    for batch in whole_groups(batches, "bucket"):
        links = batch.filter(batch.column("sigs").is_null())
        sig, who, cid, n, _, _ = met(batch.filter(batch.column("sigs").is_valid()))
        order = np.lexsort((who, n[who], sig))
        sig, who = sig[order], who[order]
        next_ = (sig[1:] == sig[:-1]) & (share[1] * n[who[:-1]] >= share[0] * n[who[1:]]) & (who[1:] != who[:-1])
        x, y = forest(np.concatenate([links.column("cid").to_numpy(), cid[who[:-1][next_]]]), np.concatenate([links.column("other").to_numpy(), cid[who[1:][next_]]]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """All pairs of the sets of two tiles (or one) by exact intersections: (a, b, null) for a forest of the links, (a, null, links) for their number."""
    for batch in whole_groups(batches, "task"):
        task = batch.column("task").to_numpy()
        cuts = np.flatnonzero(np.diff(task)) + 1
        a, b, who, count = [], [], [], []
        for s, e in zip([0, *cuts], [*cuts, len(task)]):
            part = batch.slice(s, e - s)
            side, cid, copies = part.column("side").to_numpy(), part.column("cid").to_numpy(), part.column("copies").to_numpy()
            sets = [np.frombuffer(x, U) for x in part.column("shingles").to_pylist()]
            n = np.array([len(x) for x in sets])
            both = intersections(sets)
            hit = (share[1] * both >= share[0] * (n[:, None] + n[None, :] - both)) & (side[:, None] != side[None, :] if side.any() else ~np.eye(len(n), dtype=bool))
            x, y = np.nonzero(np.triu(hit))
            x, y = forest(cid[x], cid[y])
            a.append(x), b.append(y), who.append(cid), count.append((hit @ copies).astype(np.int64))
        a_, b_, who_, count_ = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b, who, count))
        some = count_ > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a_, who_[some]])), pa.concat_arrays([pa.array(b_), pa.nulls(int(some.sum()), pa.int64())]), pa.concat_arrays([pa.nulls(len(a_), pa.int64()), pa.array(count_[some])])], names=["a", "b", "links"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of blocks of the incidence matrix over tokens that two sets have at least."""
    token = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(token, kind="stable")
    token, who = token[order], who[order]
    head, many = runs(token)
    shared = np.repeat(many > 1, many)
    column = np.cumsum(np.concatenate([[0], (token[shared][1:] != token[shared][:-1]).astype(np.int64)])) if shared.any() else np.zeros(0, np.int64)
    who = who[shared]
    out = np.zeros((len(sets), len(sets)))
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), int(column[e - 1]) - start + 1), np.float32)
        block[who[s:e], column[s:e] - start] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return np.rint(out).astype(np.int64)


def of_docs(docs: DataFrame, wanted: DataFrame, how: str = "left_semi", key: str = "doc_id") -> DataFrame:
    """Rows of docs with the doc_ids (or another key) of wanted, null ones too (left_anti: the others): by broadcast if wanted is small, else by an ordinary join."""
    ids = wanted.select(F.col(key).alias("_id")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= SMALL else ids
    return docs.join(ids, docs[key].eqNullSafe(ids["_id"]), how)


def join(docs: DataFrame, share: tuple[int, int] = SHARE, words: int = WORDS, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of docs (doc_id, text).

    Null, empty and blank texts have no shingles and no links; their component is their own doc_id. Equal
    sets (copies) are one class from the start. doc_ids may repeat: each row counts; null ones stay null and
    don't name a component unless no row of it has an id. row is a column (long) that names each row of docs: it is
    kept then, and component, equal for the rows of one component and no others, is added (null without shingles).

    1. Each set is cut into segments by band (allocation) and sends a signature for each part that isn't empty.
    2. Pairs that share a signature are counted; a pair can only link if it shares as many as its counts exceed the
       largest difference. Signatures with over LONGEST sets are dropped and deducted from their sets' counts, so a set
       meets LONGEST - 1 others at most for each of its signatures, however large its group of near copies is.
    3. Sets that this, or chance, leaves unsafe meet once more among themselves, under signatures of any length,
       joined in chains.
    4. All pairs inside the components of what is left are verified, in tiles, on whole sets.
    A linked pair has a safe set, or both are unsafe; so none is lost (but for equal 64-bit hashes of different shingles or sets).
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    own, label_too = ([row], ["component"]) if row else ([], [])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets, at = shingle_sets(piece.column("text"), words)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ["doc_id", *own]), pa.array(np.diff(at).astype(np.int64)), pa.array(class_ids(sets, at))], names=["doc_id", *own, "n_shingles", "cid"])

    named = save(docs.select("doc_id", "text", *own).mapInArrow(name, ", ".join(f"{c} long" for c in ["doc_id", *own, "n_shingles", "cid"])), "named")
    total = named.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    classes = save(named.filter("n_shingles > 1").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n")), "classes")

    def buckets(shingles: int, least: int) -> int:
        return 1 << min(20, math.ceil(math.log2(max(least, 2 * shingles // (3 * SORTED)))))

    def dealt(sent: DataFrame, n: int) -> DataFrame:
        """Buckets in order, evenly over the partitions: each is known to hold its share of the hashes."""
        return sent.repartitionById(parts, F.floor(F.col("bucket") * F.lit(parts) / F.lit(n)).cast("int")).sortWithinPartitions("bucket")

    n = buckets(total, BUCKETS)
    found = save(dealt(send(rows, n, share, words), n).mapInArrow(lambda it: meet(it, share), FOUND), "found")
    worn = found.filter("b is null").groupBy(F.col("a").alias("cid"), "band").agg(F.sum("lost").alias("lost"), F.max("n_a").alias("n"), F.max("units_a").alias("units"))
    worn = save(worn, "worn")
    limit = F.when(F.shiftright("n", 1) < F.expr("shiftleft(1L, band)"), differ_column("n", share, True)).otherwise(differ_column("n", share, False)) + 1
    unsafe = save(worn.filter(F.col("units") - F.col("lost") < limit).select("cid").distinct(), "unsafe")

    pairs = found.filter("b is not null").groupBy("a", "b", "band").agg(F.sum("meetings").alias("meetings"), *(F.first(c).alias(c) for c in ("n_a", "n_b", "units_a", "units_b")))
    # one row for each salt, so that a set's pairs are dealt to several tasks
    lost = lambda side: worn.select(F.col("cid").alias(side), "band", F.col("lost").alias(f"lost_{side}"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lambda df, by: df.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    pairs = salted(pairs, "b").join(lost("a"), ["a", "band", "salt"], "left").drop("salt")
    pairs = salted(pairs, "a").join(lost("b"), ["b", "band", "salt"], "left").drop("salt")
    left = F.greatest(*(F.col(f"units_{s}") - F.coalesce(f"lost_{s}", F.lit(0)) for s in "ab")) - F.floor((F.col("n_a") + F.col("n_b")) * F.lit(share[1] - share[0]) / F.lit(share[1] + share[0]))
    doubled = [band for band in range(40) if allocation(band, share)[1]]
    least = F.when(F.col("band").isin(doubled), F.ceil(left / 2)).otherwise(left) if doubled else left
    edges = pairs.filter(F.col("meetings") >= least).select("a", "b")

    unsafe = save(unsafe.join(classes, "cid").select("doc_id", "n"), "unsafe_docs")
    total = unsafe.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n = buckets(total, BUCKETS_AGAIN)
    second = send(of_docs(rows, unsafe), n, share, words, again=True)
    edges = save(edges.unionByName(dealt(second, n).mapInArrow(lambda it: chain(it, share), "a long, b long")), "candidates")
    drop(found, worn, unsafe)
    member = save(components(edges).select(F.col("node").alias("cid"), "component").join(classes, "cid"), "member")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets, at = shingle_sets(piece.column("text"), words)
            yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, at)), pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["cid", "shingles"])

    shingles = of_docs(rows, member).mapInArrow(whole, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))
    # linked sets are of one size class or of two that are next to each other
    kinds = member.withColumn("kind", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(share[1] / share[0])) - F.lit(1e-9)).cast("int"))
    ranked = exact_ranks(save(kinds, "kinds"), ["component", "kind"], "_rank").withColumn("tile", F.floor(F.col("_rank") / TILE).cast("long"))
    last = save(kinds.groupBy("component", "kind").agg(F.floor((F.count(F.lit(1)) - 1) / TILE).cast("long").alias("last")), "last")
    lasts = last.select("component", F.create_map("kind", "last").alias("m")).groupBy("component").agg(F.map_from_entries(F.array_distinct(F.flatten(F.collect_list(F.map_entries("m"))))).alias("lasts"))  # an entry a size class
    both = ranked.join(lasts, "component")
    end = lambda kind: F.coalesce(F.try_element_at("lasts", kind), F.lit(-1).cast("long"))
    upto = lambda kind, side: F.when(end(kind) >= 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(end(kind), F.lit(0).cast("long"))), lambda t: F.struct(kind.alias("k"), t.alias("t"), side(t).alias("side")))).otherwise(F.array())
    kind, tile = F.col("kind"), F.col("tile")
    pairs_of = F.flatten(F.array(upto(kind, lambda t: F.when(tile > t, 1).otherwise(0)), upto(kind + 1, lambda t: F.lit(0)), upto(kind - 1, lambda t: F.lit(1))))
    whole_sets = save(both.join(shingles, "cid"), "tiled")
    tiled = whole_sets.withColumn("o", F.explode(pairs_of))
    mine, its = F.struct(kind.alias("k"), tile.alias("t")), F.struct(F.col("o.k").alias("k"), F.col("o.t").alias("t"))
    tiled = tiled.select("cid", "copies", "shingles", F.xxhash64("component", F.least(mine, its), F.greatest(mine, its)).alias("task"), F.col("o.side").alias("side"))
    checked = save(tiled.repartition(parts, "task").sortWithinPartitions("task", "side").mapInArrow(lambda it: verify(it, share), "a long, b long, links long"), "checked")

    drop(whole_sets, last, edges)
    label = components(checked.filter("b is not null").select("a", "b")).select(F.col("node").alias("cid"), "component")
    links = checked.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    known = classes.join(label, "cid", "left").join(links, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    known = save(known, "known")
    first = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = save(known.join(first, "component").select("cid", *label_too, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    drop(checked, member)
    single = named.filter("n_shingles = 1").groupBy("cid").agg(F.min("doc_id").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links"))
    single = single.withColumns({c: F.col("cid") for c in label_too})
    out = named.join(known.unionByName(single), "cid", "left")
    bare = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(bare, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(bare, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), *own, *label_too)


def differ_column(n: str, share: tuple[int, int], own: bool):
    """As differ(): against the largest partner (own band) or an equally large one."""
    y = F.floor(F.col(n) * share[1] / F.lit(share[0])) if own else F.col(n)
    return F.floor((F.col(n) + y) * (share[1] - share[0]) / F.lit(share[1] + share[0]))


def op5_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents; null, empty and blank texts stand alone with no shingles, repeated rows are linked, other columns are left out."""
    return join(table(spark, sf_dir, "documents", "doc_id", "text"))
