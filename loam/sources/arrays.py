"""JSON arrays read by byte ranges: a large file is scanned by many tasks, and each element becomes a row.

Text is read in records that end with a comma, which Spark cuts out of any byte range. A range can begin inside a string and at any
depth. The first pass scans each range twice, as if it began outside and inside a string, and tells how either ends; sums over the ranges before then give
where each one really begins. The second pass cuts each range at the commas between elements; the pieces of an
element that crosses ranges are put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.operators.scratch import written
from loam.ship import ship

#: A whole string, a bracket, a comma, or a quote whose string doesn't end.
TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[\[\]{},]|"', re.DOTALL)
#: The rest of a string that has begun.
REST = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.DOTALL)
#: Bytes of records that are scanned at once, about.
HELD = 1 << 20


class Scan:
    """A walk over the text of a byte range, piece by piece: in a string or not, the depth of brackets, and commas by their depth."""

    def __init__(self, inside: bool, depth: int = 0, border: int | None = None):
        self.inside, self.depth, self.border = inside, depth, border
        self.commas: dict[int, int] = {}

    def feed(self, data: bytes) -> list[int]:
        """Places of the commas at the depth border."""
        at, depth, borders, commas = 0, self.depth, [], self.commas
        if self.inside:
            end = REST.match(data)
            if end is None:
                return borders
            at, self.inside = end.end(), False
        for m in TOKEN.finditer(data, at):
            i = m.start()
            c = data[i]
            if c == 44:
                commas[depth] = commas.get(depth, 0) + 1
                if depth == self.border:
                    borders.append(i)
            elif c in b"[{":
                depth += 1
            elif c in b"]}":
                depth -= 1
            elif m.end() == i + 1:
                self.inside = True
                break
        self.depth = depth
        return borders


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, bool]]:
    """(the other columns of the first record, text, whether it begins the range) of stretches of records of one range, which come in order."""
    now, held, size, fresh = None, [], 0, True
    for batch in batches:
        rest = [n for n in batch.schema.names if n != "value"]
        file, block = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").cast(pa.large_binary()).to_pylist()
        for i, v in enumerate(values):
            if now is None or file[i] != now["file"] or block[i] != now["block"]:
                if held:
                    yield now, b",".join(held) + b",", fresh
                now, held, size, fresh = {n: batch.column(n)[i].as_py() for n in rest}, [], 0, True
            held.append(v)
            size += len(v) + 1
            if size >= HELD:
                yield now, b",".join(held) + b",", fresh
                held, size, fresh = [], 0, False
    if held:
        yield now, b",".join(held) + b",", fresh


CUT = "file long, file_name string, block long, item_idx long, whole boolean, border long, value string"
SUMMARY = "file long, block long, ends_inside array<boolean>, deeper array<long>, commas array<map<long,long>>, first string"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: for a beginning outside and inside a string its end, change of depth and commas by depth; the first character of text."""
    shape = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ends_inside", pa.list_(pa.bool_())), ("deeper", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64()))), ("first", pa.string())])
    scans: list[Scan] = []
    now, first = None, ""

    def row() -> pa.RecordBatch:
        values = [now["file"], now["block"], [s.inside for s in scans], [s.depth for s in scans], [list(s.commas.items()) for s in scans], first]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, shape)], schema=shape)

    for head, data, fresh in ranges(batches):
        if fresh:
            if now is not None:
                yield row()
            now, scans, first = head, [Scan(False), Scan(True)], ""
        if not first:
            first = first_of(data)
        for s in scans:
            s.feed(data)
    if now is not None:
        yield row()


def first_of(data: bytes) -> str:
    """The first character of a text; empty if it is blank."""
    return data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode("latin-1")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and pieces of elements of ranges whose beginnings (inside, depth, border, before) are known, or that are whole files (nulls): CUT."""
    names = ["file", "file_name", "block", "item_idx", "whole", "border", "value"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    now, scan, number, open_, whole = None, None, 0, [], False
    out: list[tuple] = []

    def row(inner: bool, text: bytes) -> tuple:
        return now["file"], now["file_name"], now["block"], number, inner, scan.border, text

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string(), safe=False)], names=names)

    size = 0
    for head, data, fresh in ranges(batches):
        if fresh:
            if now is not None:
                out.append(row(False, b"".join(open_)))
            now, number, open_, whole = head, head["before"] or 0, [], False
            border = int(first_of(data) == "[") if head["border"] is None else head["border"]
            scan = Scan(bool(head["inside"]), head["depth"] or 0, border)
        at = 0
        for b in scan.feed(data):
            open_.append(data[at:b])
            text = b"".join(open_)
            out.append(row(whole, text))
            size += len(text) + 60
            number, open_, whole, at = number + 1, [], True, b + 1
            if size >= HELD:
                yield batch()
                size = 0
        open_.append(data[at:])
    if now is not None:
        out.append(row(False, b"".join(open_)))
    if out:
        yield batch()


def records(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """value (text up to the next comma), file (a hash of its path), block (start of its range), file_name and parted (whether the file has more ranges), in order within a range."""
    options = {"lineSep": ","} | ({"pathGlobFilter": glob} if glob else {})
    return spark.read.text(paths, **options).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_name").alias("file_name"), (F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("parted"))


def starts_of(found: DataFrame) -> DataFrame:
    """How each range of a file really begins (inside, depth), the depth of commas between elements (border) and the elements that end before it, from summaries.

    A range either keeps, turns or sets the state of being in a string: the state is that of the last
    range that sets it (outside, at the file's beginning), turned as often as ranges since then turn it.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    out, in_ = F.get("ends_inside", F.lit(0)), F.get("ends_inside", F.lit(1))
    rows = found.withColumn("_turns", sums((out & ~in_).cast("long")))
    rows = rows.withColumn("_set", F.last(F.when(out == in_, F.struct(out.cast("long").alias("to"), F.col("_turns").alias("turns"))), True).over(earlier))
    rows = rows.withColumn("inside", (F.coalesce(F.col("_set.to"), F.lit(0)) + F.col("_turns") - F.coalesce(F.col("_set.turns"), F.lit(0))) % 2 == 1)
    chosen = lambda column: F.get(column, F.col("inside").cast("int"))
    rows = rows.withColumn("depth", sums(chosen("deeper")))
    first = F.first("first").over(Window.partitionBy("file").orderBy("block"))
    rows = rows.withColumn("border", F.when(first == "[", 1).otherwise(0).cast("long"))
    rows = rows.withColumn("before", sums(F.coalesce(F.try_element_at(chosen("commas"), F.col("border") - F.col("depth")), F.lit(0))))
    return rows.select("file", "block", "inside", "depth", "border", "before")


def elements(spark: SparkSession, paths: str | list[str], glob: str | None = None, strict: bool = False) -> DataFrame:
    """file_name, item_idx and item (JSON text) of each element of files that hold one array; of any other file the whole text is its item 0.

    Elements may be objects, arrays or plain values, on one line or many; item_idx is the place in the array. Nothing is parsed: a broken
    element keeps its place as long as its brackets and quotes are in pairs, else what follows in its file is cut wrongly, and parsing leaves it out. Elements
    that are blank are left out, those of an array that doesn't end stay; strict makes both an error. Byte order marks go. Compressed files are one range each.

    Files of several ranges are read twice. Between the passes there is a row for each of their ranges, which the second pass gets as a broadcast
    (800,000 rows of 40 bytes for 100 TB in ranges of 128 MB); elements are written once to the shared folder.
    """
    ship(spark)
    source = records(spark, paths, glob)
    starts = written(starts_of(written(source.filter("parted").select("value", "file", "block").mapInArrow(summaries, SUMMARY))))
    known = source.drop("parted").join(F.broadcast(starts), ["file", "block"], "left")
    pieces = written(known.mapInArrow(cut, CUT))
    crossing = pieces.filter("not whole").groupBy("file", "item_idx").agg(F.first("file_name").alias("file_name"), F.first("border").alias("border"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "").alias("value"))
    columns = ["file", "file_name", "item_idx", "border", "value"]
    items = pieces.filter("whole").select(*columns).unionByName(crossing.select(*columns))
    items = items.join(pieces.groupBy("file").agg(F.max("item_idx").alias("_last")), "file")
    array, first, last = F.col("border") == 1, F.col("item_idx") == 0, F.col("item_idx") == F.col("_last")
    value = F.regexp_replace("value", r"^\x{FEFF}", "")
    value = F.when(array & first, F.regexp_replace(value, r"^\s*\[", "")).otherwise(value)
    value = F.when(array & last, F.regexp_replace(value, r"\]\s*,$", "")).otherwise(value)
    value = F.regexp_replace(value, r"^\s+|\s+$", "")
    if strict:
        broken = array & ((last & ~F.col("value").rlike(r"\]\s*,$")) | ((value == "") & ~(first & last)))
        value = F.when(broken, F.raise_error(F.concat(F.lit("a broken array in "), "file_name"))).otherwise(value)
    return items.select("file_name", F.col("item_idx").cast("int").alias("item_idx"), value.alias("item")).filter("item <> ''")


def first_characters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and first: the first character of each file that is no white space or byte order mark, told by the tasks that read it."""
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.left(F.regexp_replace("value", r"^[\s\x{FEFF}]+", ""), F.lit(1)).alias("first"))
    rows = rows.filter("block = 0 and first <> ''").withColumn("_at", F.monotonically_increasing_id())
    return rows.groupBy("path").agg(F.min_by("first", "_at").alias("first"))


