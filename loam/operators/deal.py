"""Dealing whole groups to three parts so that each code keeps its shares, without a task that holds all groups or all of a code.

The rule looks at a queue of groups. A group goes to train while train is short of its goal and the code's
share in train is too small (or val and test are full); else to val while val is short of its goal and the code's share in val is too
small (or test is full); else to test. So as long as no part fills, a code's decisions depend on how many of its own groups came
before and on nothing else. The queue falls into four phases at most, between which a part fills. Within a phase
each code is walked alone, by counters and not by rows; a walk leaves its state every BLOCK steps, from which tasks
replay it in parallel. The moment at which a part fills is found from counts by blocks of the queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.operators.scratch import drop, written
from loam.ship import ship

#: Steps between two states of a walk, and places of a block of the queue.
BLOCK = 65_536
PARTS = ("train", "val", "test")

State = tuple[int, int, int]


def step(state: State, open_: tuple[bool, ...], train: float, val: float) -> tuple[int, State]:
    """The part (0, 1, 2) of a code's next group, and the code's state after it: groups so far, those in train, those in val."""
    n, in_train, in_val = state
    if open_[0] and ((in_train / n if n else 0.0) < train or not (open_[1] or open_[2])):
        return 0, (n + 1, in_train + 1, in_val)
    if open_[1] and ((in_val / n if n else 0.0) < val or not open_[2]):
        return 1, (n + 1, in_train, in_val + 1)
    return 2, (n + 1, in_train, in_val)


def walk(states: DataFrame, open_: tuple[bool, ...], train: float, val: float) -> DataFrame:
    """states (code_key, total, n, in_train, in_val) -> the same every BLOCK steps on the way from n to total. One counter a code, whatever its rows."""
    size = BLOCK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, total, *state in frame.itertuples(index=False, name=None):
                state, out = tuple(state), []
                while state[0] < total:
                    out.append((key, total, *state))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=frame.columns)
                        out = []
                    for _ in range(min(size, total - state[0])):
                        _, state = step(state, open_, train, val)
                if out:
                    yield pd.DataFrame(out, columns=frame.columns)

    return states.mapInPandas(run, states.schema)


def replay(marks: DataFrame, open_: tuple[bool, ...], train: float, val: float) -> DataFrame:
    """code_key, rank (from 0, in the code) and part of all steps after the marks of a walk."""
    size = BLOCK

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, total, *state in frame.itertuples(index=False, name=None):
                state, first, parts = tuple(state), state[0], []
                for _ in range(min(size, total - first)):
                    part, state = step(state, open_, train, val)
                    parts.append(part)
                yield pd.DataFrame({"code_key": key, "rank": range(first, first + len(parts)), "part": parts})

    return marks.repartition("code_key", "n").mapInPandas(run, "code_key string, rank long, part int")


def ranked_in_code(queue: DataFrame) -> DataFrame:
    """code_key and rank (from 0) of each group among those of its code, counted by blocks of the queue: no window holds a code."""
    rows = queue.withColumns({"code_key": F.coalesce(F.to_json(F.array("code")), F.lit("")), "_block": F.floor(F.col("place") / BLOCK)})
    counts = rows.groupBy("code_key", "_block").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("code_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("code_key", "_block").orderBy("place")) - 1
    return rows.withColumn("_in", within).join(counts.select("code_key", "_block", before.alias("_before")), ["code_key", "_block"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_block")


def blocks(rows: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """For each part its counts by blocks of the queue, in order: a number for each BLOCK groups."""
    out: dict[int, list[tuple[int, int]]] = {i: [] for i in range(3)}
    for r in rows.groupBy("part", F.floor(F.col("place") / BLOCK).alias("block")).count().orderBy("block").collect():
        out[r["part"]].append((r["block"], r["count"]))
    return out


def nth(rows: DataFrame, part: int, counts: list[tuple[int, int]], n: int) -> int | None:
    """The place of the nth row of a part (from 1), if there are so many."""
    for block, count in counts:
        if n <= count:
            at = rows.filter((F.col("part") == part) & (F.floor(F.col("place") / BLOCK) == block))
            return at.orderBy("place").limit(n).agg(F.max("place").alias("p")).first()["p"]
        n -= count
    return None


def deal(queue: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """queue (group, code, place: from 0 without gaps) with a column split.

    The goals are int(n * train) groups in train, half of the rest in val and what is left in test. At the end the larger of val and test gives its
    first groups to the other one, if they differ by more than two. An empty queue gives no rows.
    """
    ship(queue.sparkSession)
    rows = written(ranked_in_code(queue))
    n = rows.count()
    goals = [int(n * train), 0, 0]
    goals[1] = (n - goals[0]) // 2
    goals[2] = n - goals[0] - goals[1]
    zero = F.lit(0).cast("long")
    states = written(rows.groupBy("code_key").agg(F.count(F.lit(1)).alias("total")).select("code_key", "total", zero.alias("n"), zero.alias("in_train"), zero.alias("in_val")))
    dealt, decided, border = [0, 0, 0], [], 0
    while border < n:
        open_ = tuple(have < goal for have, goal in zip(dealt, goals))
        left = rows.filter(F.col("place") >= border)
        if any(open_):
            plan = replay(written(walk(states.filter("n < total"), open_, train, val)), open_, train, val)
            left = left.join(plan, ["code_key", "rank"])
        else:
            left = left.withColumn("part", F.lit(2))
        left = written(left.select("group", "code_key", "place", "rank", "part"))
        counts = blocks(left)
        moments = [nth(left, i, counts[i], goals[i] - dealt[i]) for i in range(3) if open_[i]]
        end = min((m for m in moments if m is not None), default=n - 1)
        now = left.filter(F.col("place") <= end)
        decided.append(now)
        if end < n - 1:
            got = now.groupBy("code_key").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("part") == 0).alias("_t"), F.count_if(F.col("part") == 1).alias("_v"))
            more = lambda old, new: (F.col(old) + F.coalesce(new, F.lit(0))).alias(old)
            new = written(states.join(got, "code_key", "left").select("code_key", "total", more("n", "_n"), more("in_train", "_t"), more("in_val", "_v")))
            drop(states)
            states = new
            sums = {r["part"]: r["count"] for r in now.groupBy("part").count().collect()}
            dealt = [have + sums.get(i, 0) for i, have in enumerate(dealt)]
        border = end + 1
    if not decided:
        return queue.select("group", "code", "place", F.lit(None).cast("string").alias("split"))
    every = decided[0]
    for more_rows in decided[1:]:
        every = every.unionByName(more_rows)
    every = balanced(every.select("group", "place", "part"))
    return every.select("group", "place", name_of(F.col("part")).alias("split"))


def balanced(rows: DataFrame) -> DataFrame:
    """Moves the first groups of the larger one of val and test to the other, to halves, if they differ by more than two."""
    counts = blocks(rows)
    in_val, in_test = (sum(c for _, c in counts[i]) for i in (1, 2))
    if abs(in_val - in_test) <= 2:
        return rows
    half = (in_val + in_test) // 2
    large, k = (1, in_val - half) if in_val > in_test else (2, half - in_val)
    end = nth(rows, large, counts[large], k)
    return rows.withColumn("part", F.when((F.col("part") == large) & (F.col("place") <= end), 3 - large).otherwise(F.col("part")))


def name_of(part: Column) -> Column:
    return F.element_at(F.array(*(F.lit(p) for p in PARTS)), part + 1)
