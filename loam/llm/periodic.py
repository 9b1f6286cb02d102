"""Periodic runs of words, found by a suffix automaton whose ordered end-position sets are merged small to large."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import let, table, with_columns

#: A run has so many words at least, and its period so many times.
LEAST, REPEATS = 6, 4
#: End positions of one block of an ordered set, at most.
BLOCK = 2048

Run = tuple[int, int, int]


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and end position (-1 for a clone) of each state of the suffix automaton of ids; state 0 is the empty word."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(ids):
        new = len(length)
        length.append(at + 1)
        end.append(at)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link.append(q)
            else:
                clone = new + 1
                link.append(clone)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(step[q].copy())
                link[q] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return length, link, end


class Ends:
    """An ordered set of end positions, in blocks, so that an insertion moves BLOCK numbers at most."""

    __slots__ = ("blocks", "n")

    def __init__(self, first: int):
        self.blocks, self.n = [[first]], 1

    def block_of(self, x: int) -> int:
        return max(0, bisect_right(self.blocks, x, key=lambda b: b[0]) - 1) if len(self.blocks) > 1 else 0

    def add(self, x: int) -> None:
        i = self.block_of(x)
        block = self.blocks[i]
        insort(block, x)
        self.n += 1
        if len(block) > BLOCK:
            self.blocks[i : i + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a member; -1 where there is none."""
        i = self.block_of(x)
        block = self.blocks[i]
        j = bisect_left(block, x)
        before = block[j - 1] if j else self.blocks[i - 1][-1] if i else -1
        after = block[j + 1] if j + 1 < len(block) else self.blocks[i + 1][0] if i + 1 < len(self.blocks) else -1
        return before, after

    def take(self, other: Ends) -> list[tuple[int, int]]:
        """Add the members of a set that shares none, and is no larger; the neighbours (earlier, later) of which each set had one."""
        added = [x for block in other.blocks for x in block]
        for x in added:
            self.add(x)
        pairs, m = [], len(added)
        for k, x in enumerate(added):
            before, after = self.around(x)
            if before >= 0 and not (k and added[k - 1] == before):
                pairs.append((before, x))
            if after >= 0 and not (k + 1 < m and added[k + 1] == after):
                pairs.append((x, after))
        return pairs


def shortest_state(least: int, repeats: int) -> int:
    """The length of the shortest state that can tell of a run of period q: the run without its first q words."""
    return min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))


def runs_of(ids: list[int], start: int, stop: int, least: int = LEAST, repeats: int = REPEATS) -> set[Run]:
    """Runs (start, length, period) of ids that lie in ids[start:stop].

    Where two ends a < b first become neighbours in the set of a state, its length is that of the longest common
    suffix of both. If b - a is no more than that, the words from the suffix at a to b are a square's at least, of smallest period b - a, whose
    first word is where it is; it is extended to the right (and to the left, past the stretch). States too short for any run are not merged.
    """
    length, link, end = automaton(ids[start:stop])
    floor = shortest_state(least, repeats)
    ends: list[Ends | None] = [Ends(e) if e >= 0 and n >= floor else None for e, n in zip(end, length)]
    seen: set[tuple[int, int]] = set()
    found: set[Run] = set()
    for v in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        if length[v] < floor:
            break
        mine, p = ends[v], link[v]
        ends[v] = None
        size = length[p]
        if size < floor or mine is None:
            continue
        other = ends[p]
        if other is None:
            ends[p] = mine
            continue
        if other.n < mine.n:
            mine, other = other, mine
        ends[p] = other
        for a, b in other.take(mine):
            q, first = b - a, start + a - size + 1
            if q <= size and (q, first) not in seen:
                seen.add((q, first))
                low, high = first, start + b + 1
                while high < len(ids) and ids[high] == ids[high - q]:
                    high += 1
                while low and ids[low - 1] == ids[low - 1 + q]:
                    low -= 1
                if high - low >= max(least, repeats * q):
                    found.add((low, high - low, q))
    return found


def stretches(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches of ids outside which no word of a run stands (bounds; in order, apart).

    In a run of period q and length n, each word but the last q + g - 1 begins a gram of g words that comes again within q words, and there are n - q - g + 1
    of these in a row, (repeats - 1) * q - g + 1 at least. Words whose gram comes again too late for the row they are in are left out, and
    rows that this cuts are looked at again, a few times. Equal hashes of different grams only keep more.
    """
    g = min(3, least - 1, shortest_state(least, repeats))
    n = len(ids)
    if n < least:
        return []
    v = ids.astype(np.uint64)
    codes = v[: n - g + 1].copy()
    for i in range(1, g):
        codes = codes * np.uint64(0x9E3779B97F4A7C15) + v[i : n - g + 1 + i]
    order = np.argsort(codes, kind="stable")
    sorted_ = codes[order]
    same = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    gap = np.zeros(n - g + 1, np.int64)
    gap[order[same]] = order[same + 1] - order[same]
    row = np.zeros(0, np.int64)
    lows = highs = row
    for _ in range(12):
        marked = np.concatenate([[0], gap > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(marked))
        lows, highs = edges[::2], edges[1::2]
        if not len(lows):
            return []
        row = np.repeat(highs - lows, highs - lows)
        at = np.flatnonzero(gap)
        late = at[(repeats - 1) * gap[at] - g + 1 > row]
        if not len(late):
            break
        gap[late] = 0
    else:
        marked = np.concatenate([[0], gap > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(marked))
        lows, highs = edges[::2], edges[1::2]
    out: list[tuple[int, int]] = []
    for low, high in zip(lows.tolist(), highs.tolist()):
        stop = min(n, high + (high - low + g - 1) // (repeats - 1) + g - 1)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((low, stop))
    return out


def runs_in(words: list[bytes], least: int = LEAST, repeats: int = REPEATS) -> list[Run]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    names: dict[bytes, int] = {}
    ids = [names.setdefault(w, len(names)) for w in words]
    if len(ids) - len(names) < least - max(1, least // repeats):
        return []
    found: set[Run] = set()
    for low, high in stretches(np.array(ids, np.int64), least, repeats):
        found |= runs_of(ids, low, high, least, repeats)
    return sorted((s, n, q) for s, n, q in found)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(df: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """The columns keep of each row of df with n_words, runs (array of (start, length, period) by start, then period) and collapsed (the words that stay, joined by a space).

    Words are stretches without ASCII white space, numbered from 0. A run is as long as it can be with its smallest
    period, has least words and repeats times its period at least. Null and empty texts have no words, no
    runs and an empty collapsed text; rows may repeat; kept columns named like the new ones are left out. One map without a
    shuffle; memory grows with the longest stretch of one text that may hold a run (about 500 bytes a word).
    """

    def work(texts: pa.Array) -> list[pa.Array]:
        counts, spans, kept = [], [], []
        for t in texts.cast(pa.large_binary()).to_pylist():
            words = (t or b"").split()
            runs = runs_in(words, least, repeats)
            counts.append(len(words))
            spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            kept.append(b" ".join(collapsed(words, runs)))
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary()).cast(pa.string())]

    return with_columns(df, text, "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", work, keep)


def looped(text: Column, key: Column) -> Column:
    """text, of which a tenth of the rows (by crc32 of key) goes round from some word on: word i >= a is word a + (i - a) % p. Rows without a key stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def turned(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(a, lambda a: let(p, lambda p: F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, turned(w)).otherwise(""))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document (a tenth of them looped), the longest one, and digests of all runs and of the text without repeats; null texts have no words."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    found = find_runs(docs, ["doc_id"]).withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length = -F.col("best.n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
