"""Exact k nearest neighbours by cosine, with cells around pivots that triangle inequalities rule out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.operators.scratch import written
from loam.ship import ship

#: Vectors of each dimension from which pivots are made, on the driver; pivots at most; dimensions that get pivots (others are one cell).
SAMPLE, PIVOTS, DIMENSIONS = 4096, 256, 8
#: Slack of bounds, in radians: angles near 0 are known to 1e-8.
SLACK = 1e-6
#: Queries that are compared at once; rows that are sent on at once; results that are held before the best are picked.
BATCH, SENT, HELD = 64, 2048, 1 << 20
#: Bins of rows that there should be at most, as long as none has more vector components than ROOM, which bounds a task's rows and its queries.
BINS, ROOM = 64, 2_000_000

Cells = dict[int, np.ndarray]


def matrix(vectors: list) -> np.ndarray:
    """Unit vectors of one dimension; rows of nan where one is zero, or has null or non-finite components."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        m = np.array([[np.nan if c is None else c for c in v] for v in vectors], np.float64)
        m = m / np.abs(m).max(axis=1, keepdims=True)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(np.isfinite(length) & (length > 0), m / length, np.nan)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1.0, 1.0))


def pivots_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n unit vectors amid a sample: far ones first, then moved to the middle of their cells."""
    centers = [sample[0]]
    near = angles(sample, sample[:1])[:, 0]
    while len(centers) < min(n, len(sample)) and near.max() > SLACK:
        centers.append(sample[int(near.argmax())])
        near = np.minimum(near, angles(sample, centers[-1][None])[:, 0])
    at = np.array(centers)
    for _ in range(rounds):
        cell = (sample @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        at = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), at)
    return at


def choose_pivots(rows: DataFrame, vector: str, pivots: int) -> Cells:
    """For the most frequent dimensions, pivots from the rows of lowest hashes: about the square root of the count, `pivots` at most."""
    sizes = rows.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
    out: Cells = {}
    for r in sizes:
        share = min(1.0, 1.2 * SAMPLE / r["count"])
        some = rows.filter(F.size(vector) == r["dim"]).select(F.col(vector).alias("v")).filter((F.xxhash64("v").bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) <= share)
        # equal vectors have equal hashes: each counts once, and the limit holds where many share one
        m = matrix([x["v"] for x in some.distinct().limit(2 * SAMPLE).collect()] or [[np.nan] * r["dim"]])
        m = m[np.isfinite(m[:, 0])]
        if len(m):
            out[r["dim"]] = pivots_of(m[np.lexsort(m.T[::-1])], max(1, min(pivots, round(r["count"] ** 0.5))))
    return out


def by_dimension(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, unit vectors) of the usable vectors."""
    dims = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for dim in np.unique(dims):
        if dim > 0:
            at = np.flatnonzero(dims == dim)
            m = matrix(list(vectors.iloc[at]))
            fine = np.isfinite(m[:, 0])
            if fine.any():
                yield int(dim), at[fine], m[fine]


def assign(rows: DataFrame, id_: str, vector: str, cells: Cells) -> DataFrame:
    """id, v (unit vector), dim, cell (the nearest pivot) and angle to it, of usable rows; dimensions without pivots are cell 0 at angle 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, at, m in by_dimension(frame["v"]):
                if dim in cells:
                    a = angles(m, cells[dim])
                    cell, angle = a.argmin(axis=1), a.min(axis=1)
                else:
                    cell, angle = np.zeros(len(at), np.int64), np.zeros(len(at))
                yield pd.DataFrame({"id": frame["id"].to_numpy()[at], "v": list(m), "dim": dim, "cell": cell, "angle": angle})

    kind = rows.schema[id_].dataType.simpleString()
    return rows.select(F.col(id_).alias("id"), F.col(vector).alias("v")).mapInPandas(run, f"id {kind}, v array<double>, dim int, cell int, angle double")


def kept(i: np.ndarray, place: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Where the k least distances of each i are; ties go to the lower place."""
    order = np.lexsort((place, d.round(12), i))
    i = i[order]
    return order[np.arange(len(i)) - np.searchsorted(i, i) < k]


def compare(k: int, cells: Cells, first: bool) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a bin of rows and the queries that reach it: the k best of each query within its bound, and in a row without ids the pairs that were computed.

    In the first look a query has no bound: it sees its own cell, and then the bin's other cells within the bound that it has from there.
    """

    def run(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"query_id": [], "id": [], "distance": [], "pairs": []})
        rows = rows.sort_values(["cell", "angle"], kind="stable")
        x, near, ids, cell = np.array(rows["v"].tolist()), rows["angle"].to_numpy(), rows["id"].to_numpy(), rows["cell"].to_numpy()
        place = np.unique(ids, return_inverse=True)[1]
        q, names, own = np.array(asked["v"].tolist()), asked["query_id"].to_numpy(), asked["own"].to_numpy()
        nearest, bound = asked["nearest"].to_numpy(), asked["bound"].to_numpy(np.float64).copy()
        pivots = cells.get(int(key[0]))
        parts, pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def picked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j, d = (np.concatenate(c) for c in zip(*parts))
            best = kept(i, place[j], d, k)
            parts[:] = [(i[best], j[best], d[best])]
            return parts[0]

        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for mine in (True, False) if first else (None,):
            for s, e in zip(starts, np.r_[starts[1:], len(cell)]):
                a = np.zeros(len(q)) if pivots is None else angles(q, pivots[cell[s]][None])[:, 0]
                some = np.maximum(np.maximum(a - near[e - 1], near[s] - a), (a - nearest) / 2) <= bound + SLACK
                some = np.flatnonzero(some if mine is None else some & ((own == cell[s]) == mine))
                some = some[np.argsort(a[some], kind="stable")]
                for b in range(0, len(some), BATCH):
                    t = some[b : b + BATCH]
                    low = s + np.searchsorted(near[s:e], (a[t] - bound[t] - SLACK).min(), "left")
                    high = s + np.searchsorted(near[s:e], (a[t] + bound[t] + SLACK).max(), "right")
                    if low >= high:
                        continue
                    pairs += len(t) * int(high - low)
                    d = 1 - q[t] @ x[low:high].T
                    edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1] + 1e-12
                    reach = bound[t] + SLACK
                    edge = np.minimum(edge, np.where(reach < np.pi, 1 - np.cos(reach) + 1e-11, np.inf))
                    i, j = np.nonzero(d <= edge[:, None])
                    best = kept(i, place[low + j], d[i, j], k)
                    parts.append((t[i[best]], low + j[best], d[i[best], j[best]]))
                if sum(len(p[0]) for p in parts) > HELD:
                    picked()
            i, j, d = picked()
            if mine:
                full = np.bincount(i, minlength=len(q)) >= k
                worst = np.full(len(q), -1.0)
                np.maximum.at(worst, i, d)
                bound[full] = np.arccos(np.clip(1 - worst[full], -1.0, 1.0))
        told = np.empty(1, object)  # null
        out = pd.DataFrame({"query_id": np.append(names[i], names[:1]), "id": np.append(ids[j].astype(object), told), "distance": np.append(d, 0.0)})
        out["pairs"] = np.append(np.zeros(len(i), np.int64), pairs)
        return out

    return run


def binned(stats: list[dict], room: int) -> None:
    """Adds tiles and bin to a dimension's cells: a cell of more components than room is dealt to as many bins as it needs, small cells share one."""
    at, held = 0, 0
    for s in sorted(stats, key=lambda s: s["cell"]):
        size = s["n"] * s["dim"]
        s["tiles"] = -(-size // room)
        if held and held + size > room:
            at, held = at + 1, 0
        s["bin"] = at
        if s["tiles"] > 1:
            at, held = at + s["tiles"], 0
        else:
            held += size


def searched(index: DataFrame, queries: DataFrame, k: int, id_: str, vector: str, components: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Candidates (query_id, id, distance) that hold the k nearest rows of each query, and pairs: how many pairs each task computed.

    Rows are dealt to the cells of their nearest pivots, and cells to bins of about `components` vector components, or more (up to
    ROOM) where there would be over BINS bins: small cells share a bin, large ones are dealt to several by hash. Each query is first
    compared in one bin of its own cell; its kth distance there bounds what can still matter. The angle is a metric, so a cell
    is left out if its nearest possible row is farther than the bound: by the range of its rows' angles to its pivot, and as its rows are no nearer to
    the query's own pivot than to theirs. In a cell only rows whose angle to the pivot is within the bound of the query's are compared.
    A query is sent once to each bin that has a cell within its bound. The driver gets a bounded sample and a row a cell.
    """
    ship(index.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    id_kind = index.schema[id_].dataType.simpleString()
    cells = choose_pivots(index, vector, pivots)
    rows = written(assign(index, id_, vector, cells))
    stats = [r.asDict() for r in rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()]
    room = max(components, min(ROOM, sum(s["n"] * s["dim"] for s in stats) // BINS))
    known: dict[int, pd.DataFrame] = {}
    for dim in {s["dim"] for s in stats}:
        binned(own := [s for s in stats if s["dim"] == dim], room)
        known[dim] = pd.DataFrame(own).sort_values("cell").reset_index(drop=True)
    sizes = index.sparkSession.createDataFrame([(s["dim"], s["cell"], s["tiles"], s["bin"]) for s in stats], "dim int, cell int, tiles int, first int")
    asked_size = queries.agg(F.sum(F.greatest(F.coalesce(F.size(vector), F.lit(0)), F.lit(0)))).first()[0] or 0
    blocks = -(-asked_size // max(components, ROOM)) or 1  # of queries, which a bin's rows meet one by one
    bin_ = (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("tiles"))).cast("int").alias("bin")
    binned_rows = rows.join(F.broadcast(sizes), ["dim", "cell"]).select("id", "v", "angle", "dim", "cell", bin_, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def reach(asked: DataFrame, first: bool) -> DataFrame:
        """A row for each bin that a query must see: the first one, or all others that have a cell within its bound."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for dim, at, m in by_dimension(frame["v"]):
                    if dim not in known:
                        continue
                    have = known[dim]
                    cell, tiles, start = have["cell"].to_numpy(), have["tiles"].to_numpy(), have["bin"].to_numpy()
                    for s in range(0, len(m), SENT):
                        part, some = m[s : s + SENT], at[s : s + SENT]
                        a = angles(part, cells[dim][cell]) if dim in cells else np.zeros((len(part), 1))
                        own, nearest = a.argmin(axis=1), a.min(axis=1)
                        salt = frame["salt"].to_numpy()[some]
                        seen = start[own] + salt % tiles[own]  # the bin of the first look
                        bound = np.full(len(part), np.pi)
                        if first:
                            i, j = np.arange(len(part)), seen
                        else:
                            bound = np.nan_to_num(frame["bound"].to_numpy(np.float64)[some], nan=np.pi)
                            least = np.maximum(np.maximum(a - have["high"].to_numpy(), have["low"].to_numpy() - a), (a - nearest[:, None]) / 2)
                            reached = np.zeros((len(part), int((start + tiles).max())), bool)
                            for c in range(len(cell)):
                                reached[:, start[c] : start[c] + tiles[c]] |= (least[:, c] <= bound + SLACK)[:, None]
                            reached[np.arange(len(part)), seen] = False
                            i, j = np.nonzero(reached)
                        for b in range(0, len(i), SENT):
                            x, y = i[b : b + SENT], j[b : b + SENT]
                            yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[some[x]], "v": list(part[x]), "own": cell[own[x]], "nearest": nearest[x], "bound": bound[x], "dim": dim, "bin": y, "block": salt[x] // (1 << 10) % blocks})

        return asked.mapInPandas(run, f"query_id {kind}, v array<double>, own int, nearest double, bound double, dim int, bin int, block int")

    def look(asked: DataFrame, first: bool) -> DataFrame:
        key, run = ["dim", "bin", "block"], compare(k, cells, first)
        return asked.groupBy(*key).cogroup(binned_rows.groupBy(*key)).applyInPandas(lambda key, a, b: run(key, a, b), f"query_id {kind}, id {id_kind}, distance double, pairs long")

    wanted = queries.select("query_id", F.col(vector).alias("v"), F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)).alias("salt"))
    found = written(look(reach(wanted, True), True))
    kth = found.filter("id is not null").groupBy("query_id").agg(F.array_sort(F.collect_list("distance")).alias("d"))  # k a query: it has seen one bin
    cosine = 1 - F.get("d", F.lit(k - 1))  # null where the bin has too few rows: no bound
    kth = kth.select("query_id", F.when(cosine > 1, 0.0).when(cosine < -1, float(np.pi)).otherwise(F.acos(cosine)).alias("bound"))
    more = written(look(reach(wanted.join(kth, "query_id", "left"), False), False))
    both = found.unionByName(more)
    return both.filter("id is not null").select("query_id", "id", "distance"), both.select("pairs")


def share_computed(pairs: DataFrame, n_queries: int, n_rows: int) -> float:
    """Pairs that were computed, of all."""
    return (pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).first()["n"]) / max(1, n_queries * n_rows)
