"""Near-duplicate vectors by sorted projection passes: order by concatenated random hashes, compare neighbour windows, union."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.llm.common import drop, exact_ranks, row_place, save, table
from loam.llm.components import HELD, components, forest

LEAST = 0.9
#: Passes, at least: enough() tells how many a table needs.
PASSES, BITS, WINDOW = 12, 60, 1024
#: Partners at cosine LEAST that are planted into a sample of the table, and the share of them that may meet no one.
PLANTED, MISSED = 2000, 0.002
#: Vectors of the sample (more beyond a thousand times as many vectors) and components in it, about; linked ones that are looked at for a partner.
SAMPLE, VALUES, LINKED = 32_768, 4_000_000, 64
#: Vectors that a sampled one may stand for; beyond that places are counted in the whole table, for so many passes at once.
COARSE, COUNTED = WINDOW // 2, 16
#: Passes at most; a table that would need more is linked with a warning that tells the share of partners that meet no one.
MOST = 4096

LOG = logging.getLogger(__name__)
#: Rows of a tile in which a component's links are counted.
TILE = 256


def planes(dim: int, number: int) -> np.ndarray:
    """The random directions of a pass, the same on every worker."""
    return np.random.default_rng([dim, number]).standard_normal((dim, BITS))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat double components, starts and dimensions of list rows, each row scaled to length 1."""
    dims = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(dims) - dims
    if len(flat):
        top = np.maximum.reduceat(np.abs(flat), at)
        flat = flat / np.repeat(top, dims)  # no overflow in the squares
        flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, at)), dims)
    return flat, at, dims


def signs(x: np.ndarray, number: int) -> np.ndarray:
    """The concatenated sign bits of unit rows in a pass."""
    return ((x @ planes(x.shape[1], number)) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def planted(base: np.ndarray) -> np.ndarray:
    """A partner at cosine LEAST to each unit row, in a random direction."""
    off = np.random.default_rng(len(base)).standard_normal(base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    return LEAST * base + np.sqrt(1 - LEAST**2) * off / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)


def told(met: np.ndarray, number: int) -> int:
    if (~met).mean() > MISSED:
        LOG.warning("after %d passes %.2f %% of planted partners meet no one; so many links may be missed", number, 100 * (~met).mean())
    return number


def enough(x: np.ndarray, n: int) -> int:
    """Passes in which all but MISSED of the vectors at cosine LEAST to one of n meet a linked one in a window; x are unit rows of a sample of the n.

    Partners in random directions are planted at rows of x, and places are counted among the sample's keys: so the
    number follows the size of the table and how its vectors crowd, whatever the shape. A row of x must stand for less than a window.
    """
    base = x[:PLANTED]
    y = planted(base)
    who, with_ = [np.arange(len(base))], [np.arange(len(base))]
    for s in range(0, len(y), 256):
        hit = y[s : s + 256] @ x.T >= LEAST
        i, j = np.nonzero(hit & (np.cumsum(hit, axis=1, dtype=np.int32) < LINKED))
        who.append(i + s), with_.append(j)
    i, j = np.concatenate(who), np.concatenate(with_)
    each, between = n / len(x), 0.5 * (n > len(x))
    met, number = np.zeros(len(base), bool), 0
    while number < PASSES or ((~met).mean() > MISSED and number < MOST):
        own = signs(x, number)
        order = np.argsort(own, kind="stable")
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        at = np.searchsorted(own[order], signs(y, number))
        met[i[(np.abs(at[i] - place[j]) + between) * each <= WINDOW]] = True
        number += 1
    return told(met, number)


def counted(classes: DataFrame, base: np.ndarray) -> int:
    """As enough(), for a table of which no sample is fine enough: each planted pair's places are counted among the keys of all vectors of the dimension.

    A job tells for COUNTED passes how many keys lie before and at each of the pairs' keys; the driver gets a row for each of these, 128,000 at most.
    """
    dim, y = base.shape[1], planted(base)
    met, number = np.zeros(len(base), bool), 0
    while number < PASSES or ((~met).mean() > MISSED and number < MOST):
        both = {t: (signs(base, t), signs(y, t)) for t in range(number, number + COUNTED)}
        ends = {t: np.unique(np.concatenate(p)) for t, p in both.items()}

        def count(batches: Iterator[pa.RecordBatch], ends: dict[int, np.ndarray] = ends) -> Iterator[pa.RecordBatch]:
            sums = {(t, side): np.zeros(len(e) + 1, np.int64) for t, e in ends.items() for side in (0, 1)}
            for batch in batches:
                flat, at, dims = unit(batch.column("embedding"))
                x = flat[at[dims == dim][:, None] + np.arange(dim)]
                for t, e in ends.items():
                    own = signs(x, t)
                    for side, name in ((0, "left"), (1, "right")):
                        sums[t, side] += np.bincount(np.searchsorted(e, own, name), minlength=len(e) + 1)
            rows = [(t, side, int(k), int(v[k])) for (t, side), v in sums.items() for k in np.flatnonzero(v)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))] if rows else [pa.array([], k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=["pass", "side", "place", "n"])

        sums = {(t, side): np.zeros(len(e) + 1, np.int64) for t, e in ends.items() for side in (0, 1)}
        for r in classes.select("embedding").mapInArrow(count, "pass int, side int, place int, n long").groupBy("pass", "side", "place").agg(F.sum("n").alias("n")).collect():
            sums[r["pass"], r["side"]][r["place"]] = r["n"]
        for t, (own, other) in both.items():
            low, high = (np.searchsorted(ends[t], f(own, other)) for f in (np.minimum, np.maximum))
            up_to, before = np.cumsum(sums[t, 0])[high], np.cumsum(sums[t, 1])[low]  # keys no greater than the one end, and less than the other
            met |= up_to - before <= WINDOW
            number += 1
            if number >= PASSES and (~met).mean() <= MISSED:
                break
    return told(met, number)


def needed(classes: DataFrame) -> tuple[dict[int, int], int]:
    """Passes by dimension (PASSES for those that the sample lacks, which are rare), from a bounded sample by hash on the driver, and counts of the whole table where a sample is too coarse; and the number of classes."""
    known = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("embedding")), F.lit(1.0)).alias("dim")).first()
    n, hashed = known["n"], F.xxhash64("embedding")
    share = min(1.0, min(max(SAMPLE, n >> 10), VALUES / known["dim"]) / max(n, 1))
    unit_ = hashed.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = classes.filter(unit_ <= share).select(hashed.alias("h"), "embedding").toArrow().sort_by("h")
    flat, at, dims = unit(sample.column("embedding").combine_chunks()) if len(sample) else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = {}
    for dim in np.unique(dims):
        x = flat[at[dims == dim][:, None] + np.arange(dim)]
        all_ = max(len(x), round(n * len(x) / len(dims)))
        out[int(dim)] = enough(x, all_) if all_ <= COARSE * len(x) else counted(classes, x[:PLANTED])
    return out, n


def keys(batches: Iterator[pa.RecordBatch], passes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass, with the pass' concatenated sign bits."""
    for batch in batches:
        flat, at, dims = unit(batch.column("embedding"))
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = flat[at[rows][:, None] + np.arange(dim)]
            part = batch.take(pa.array(rows))
            for number in range(passes.get(int(dim), PASSES)):
                key = signs(x, number)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), pa.array(np.full(len(rows), dim, np.int32)), pa.array(key), part.column("cid"), part.column("embedding")], names=["pass", "dim", "key", "cid", "embedding"])


def matrix(batch: pa.RecordBatch) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of one pass and dimension in an ordered batch: pass, dimension, ids, unit vectors."""
    flat, at, dims = unit(batch.column("embedding"))
    number, cid = batch.column("pass").to_numpy(), batch.column("cid").to_numpy()
    cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(dims) != 0)) + 1
    return [(int(number[s]), int(dims[s]), cid[s:e], flat[at[s] : at[s] + (e - s) * dims[s]].reshape(e - s, -1)) for s, e in zip([0, *cuts], [*cuts, len(cid)]) if e > s]


def band(ids: np.ndarray, x: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs at most WINDOW places apart of which the second is at place fresh or later, as a forest with the same components."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(fresh, len(x), 256):
        e, low = min(len(x), s + 256), max(0, s - WINDOW)
        later, earlier = np.nonzero(x[s:e] @ x[low:e].T >= LEAST)
        gap = (later + s) - (earlier + low)
        near = (gap > 0) & (gap <= WINDOW)
        i, j = forest(ids[earlier[near] + low], ids[later[near] + s])
        a.append(i), b.append(j)
    return forest(np.concatenate(a), np.concatenate(b))


SWEPT = "a long, b long, border int, side int, place int, pass int, cid long, embedding {}"


def sweep(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Links in the windows of one ordered range, as a forest of stars (at most an edge a vector and HELD edges), and the range's first and last rows for the windows over its borders."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    empty = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("border", pa.int32()), ("side", pa.int32()), ("place", pa.int32()), ("pass", pa.int32()), ("cid", pa.int64()), ("embedding", kind)])

    def edge(rows: pa.RecordBatch, border: int, side: int) -> pa.RecordBatch:
        n = len(rows)
        none = pa.nulls(n, pa.int64())
        full = lambda v: pa.array(np.full(n, v, np.int32))
        return pa.RecordBatch.from_arrays([none, none, full(border), full(side), pa.array(np.arange(n, dtype=np.int32)), rows.column("pass"), rows.column("cid"), rows.column("embedding").cast(kind)], schema=empty)

    def links(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *(pa.nulls(len(x), f.type) for f in list(empty)[2:])], schema=empty)

    held: pa.RecordBatch | None = None
    first = True
    x_, y_ = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not len(batch):
            continue
        if first:
            yield edge(batch.slice(0, WINDOW), part, 1)
            first = False
        old = 0 if held is None else len(held)
        joined = batch if held is None else pa.concat_batches([held, batch])
        place = 0
        for _, _, ids, x in matrix(joined):
            a, b = band(ids, x, max(0, old - place))
            place += len(ids)
            x_, y_ = np.concatenate([x_, a]), np.concatenate([y_, b])
            if len(x_) > HELD:
                x_, y_ = forest(x_, y_)
                if len(x_) > HELD // 2:
                    yield links(x_, y_)
                    x_, y_ = x_[:0], y_[:0]
        held = joined.slice(max(0, len(joined) - WINDOW))
    if len(x_):
        yield links(*forest(x_, y_))
    if held is not None:
        yield edge(held, part + 1, 0)


def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs between the last rows before a border and the first ones after it. Batches hold whole borders, in order of (border, side, place)."""
    for batch in batches:
        border, side = batch.column("border").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero(np.diff(border)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(border)]):
            part = batch.slice(s, e - s)
            before = int((side[s:e] == 0).sum())
            place = 0
            for _, _, ids, x in matrix(part):
                a, b = band(ids, x, min(len(ids), max(0, before - place)))
                place += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut and join ordered batches so that all rows of a group are in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1], "left")) if (np.diff(values) >= 0).all() else int(np.flatnonzero(np.diff(values)).max(initial=-1)) + 1
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def pairs(classes: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of the linked pairs of classes (cid, embedding) that some pass' window holds; repeats may occur.

    All passes are one range-partitioned sort by (pass, dimension, key, cid).
    """
    spark = classes.sparkSession
    passes, n = needed(classes)
    # ranges much longer than a window, which is looked at over one border only
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n * PASSES // (4 * WINDOW)))
    kind = classes.schema["embedding"].dataType.simpleString()
    keyed = classes.select("cid", "embedding").mapInArrow(lambda it: keys(it, passes), f"pass int, dim int, key long, cid long, embedding {kind}")
    order = ["pass", "dim", "key", "cid"]
    arrow = to_arrow_type(classes.schema["embedding"].dataType)
    swept = save(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda it: sweep(it, arrow), SWEPT.format(kind)), "swept")
    edges = swept.filter("border is not null").select("border", "side", "place", "pass", "cid", "embedding")
    crossing = edges.repartition(parts, "border").sortWithinPartitions("border", "side", "place").mapInArrow(lambda it: over_borders(whole_groups(it, "border")), "a long, b long")
    return swept.filter("a is not null").select("a", "b").unionByName(crossing)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the pairs of two tiles: for each row that has some, their number weighted by the other's copies. Batches hold whole pairs of tiles."""
    for batch in batches:
        task = batch.column("task").to_numpy()
        cuts = np.flatnonzero(np.diff(task)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(task)]):
            part = batch.slice(s, e - s)
            side, cid, copies = part.column("side").to_numpy(), part.column("cid").to_numpy(), part.column("copies").to_numpy()
            flat, at, dims = unit(part.column("embedding"))
            for dim in np.unique(dims):
                i = np.flatnonzero((side == 0) & (dims == dim))
                j = np.flatnonzero((side == 1) & (dims == dim))
                same = not (side == 1).any()
                j = i if same else j
                x, y = (flat[at[k][:, None] + np.arange(dim)] for k in (i, j))
                hit = x @ y.T >= LEAST
                if same:
                    np.fill_diagonal(hit, False)
                n = [hit @ copies[j]] + ([] if same else [hit.T @ copies[i]])
                ids = [cid[i]] + ([] if same else [cid[j]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n).astype(np.int64))], names=["cid", "n"])


def count_links(classes: DataFrame, member: DataFrame) -> DataFrame:
    """cid and links: for each member (cid, component) all links inside its component, found by windows or not, copies counted.

    A component is cut into tiles of TILE rows, and each pair of tiles is a task of its own; pairs are counted, not
    emitted. Only components of the links found are looked at, so nothing is lost and some links between
    them and within them that no window held are found.
    """
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = save(classes.select("cid", "embedding", "copies").join(member, "cid"), "members")
    ranked = exact_ranks(rows, ["component"], "_rank").withColumn("tile", F.floor(F.col("_rank") / TILE).cast("long"))
    sizes = save(rows.groupBy("component").agg(F.floor((F.count(F.lit(1)) - 1) / TILE).cast("long").alias("last")), "sizes")
    both = ranked.join(sizes, "component").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    both = both.select("cid", "embedding", "copies", F.xxhash64("component", low, high).alias("task"), F.when(F.col("tile") == low, 0).otherwise(1).alias("side"))
    counted = both.repartition(parts, "task").sortWithinPartitions("task", "side").mapInArrow(lambda it: tiles(whole_groups(it, "task")), "cid long, n long")
    return counted.groupBy("cid").agg(F.sum("n").alias("links"))


def link(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding).

    Equal vectors are one class first, however many rows it has. Null, empty and zero vectors and those
    with null or non-finite components have no links; vectors of different lengths are not linked. A vec_id
    may repeat: each row counts. Null vec_ids stay null; their component is the least id it has. Other columns
    are left out, and an empty table gives no rows. Components are compared in double precision from the column's own type on.
    """
    value = F.col("embedding")
    fine = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(value, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(fine, value).alias("embedding"))
    grouped = rows.filter(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    stored = save(grouped, "classes")
    file, row = row_place()
    classes = stored.withColumn("cid", file * F.lit(1 << 36) + row)
    edges = save(pairs(classes), "pairs")
    member = save(components(edges).select(F.col("node").alias("cid"), "component"), "components")
    known = classes.select("cid", "first", "copies").join(member, "cid", "left").join(count_links(classes, member), "cid", "left")
    known = known.withColumns({"component": F.coalesce("component", "cid"), "links": F.coalesce("links", F.lit(0)) + F.col("copies") - 1})
    known = save(known.select("cid", "component", "first", "links"), "known")
    named = known.groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = save(classes.select("cid", "embedding").join(known.join(named, "component"), "cid").select("embedding", "links", "component_id"), "named")
    out = rows.join(of_class, "embedding", "left")
    own = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op4_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; vectors that are null, empty, zero or not finite stand alone."""
    return link(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
