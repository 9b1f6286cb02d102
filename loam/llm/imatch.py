"""I-Match: distinct terms of a band of inverse document frequency, sorted and hashed under randomised lexicon subsets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import pieces, placed, table
from loam.llm.encoding import marks

#: The band: terms in at least LEAST and at most MOST of all documents (inverse document frequencies from 2.3 to 6.9), and in two at least.
LEAST, MOST = 0.001, 0.1
#: Share of the lexicon that a subset keeps, and subsets of each share. Smaller ones outlive larger edits.
SHARES, EACH = (0.25, 0.1, 0.04, 0.015, 0.006, 0.0025, 0.001, 0.0004), 6
SUBSETS = len(SHARES) * EACH
NO_TERM = "-" * 8


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, lower-cased: each text's distinct terms as (text, place in the hashes), and the hashes of all distinct terms."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    words = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}]+")
    coded = words.flatten().dictionary_encode()
    hashes = np.where(pc.binary_length(coded.dictionary).to_numpy() > 0, marks(coded.dictionary)[0], np.uint64(0))
    text = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    both = np.sort(text * max(len(hashes), 1) + coded.indices.to_numpy())
    both = both[np.diff(both, prepend=-1) > 0]
    text, place = both // max(len(hashes), 1), both % max(len(hashes), 1)
    real = hashes[place] != 0
    return text[real], place[real], hashes


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([np.zeros(0, np.int64), *counts]), len(keys)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (a 64-bit hash) and df over all docs; each task sums its documents before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys, n = summed(hashes, counts)
            hashes.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["term", "df"])

        for piece in pieces(batches):
            _, place, h = terms(piece.column("text"))
            n = np.bincount(place, minlength=len(h))
            hashes.append(h[n > 0])
            counts.append(n[n > 0].astype(np.int64))
            if len(hashes) % 8 == 0:
                keys, n = summed(hashes, counts)
                hashes[:], counts[:] = [keys], [n]
            if len(hashes[0]) > 1_500_000:
                yield out()
        if hashes:
            yield out()

    return docs.select("text").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Lexicon:
    hashes: np.ndarray  # sorted

    @cached_property
    def member(self) -> np.ndarray:
        """Bit k: the term is in subset k."""
        bits = np.zeros(len(self.hashes), np.uint64)
        for k in range(SUBSETS):
            with np.errstate(over="ignore"):
                h = (self.hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            with np.errstate(over="ignore"):
                h *= np.uint64(0xD6E8FEB86659FD93)
            bits |= ((h >> np.uint64(32)) < np.uint64(int(SHARES[k // EACH] * 2**32))).astype(np.uint64) << np.uint64(k)
        return bits

    def fingerprints(self, texts: pa.Array) -> list[str]:
        """16 hexadecimal digits for the whole lexicon and 8 for each subset (NO_TERM: none of its terms); a text without any term of the lexicon gets ``=`` and a digest of itself."""
        text, place, hashes = terms(texts)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        found = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        keep = found[place]
        text, value, bits = text[keep], hashes[place[keep]], (self.member[at[place[keep]]] if len(self.hashes) else np.zeros(0, np.uint64))
        order = np.lexsort((value, text))
        text, value, bits = text[order], value[order], bits[order]
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        out = []
        for i in range(len(texts)):
            s, e = ends[i], ends[i + 1]
            if s == e:
                out.append("=" + sha256((texts[i].as_py() or "").encode()).hexdigest()[:32])
                continue
            v, b = value[s:e], bits[s:e]
            said = [f"{xxhash.xxh64_intdigest(v.tobytes()):016x}"]
            rows = np.flatnonzero(b)
            bit = (b[rows, None] >> np.arange(SUBSETS, dtype=np.uint64)) & np.uint64(1)
            subset, row = np.nonzero(bit.T)
            raw, cut = v[rows[row]].tobytes(), np.searchsorted(subset, np.arange(SUBSETS + 1)).tolist()
            said += [f"{xxhash.xxh32_intdigest(raw[8 * x : 8 * y]):08x}" if x < y else NO_TERM for x, y in zip(cut[:-1], cut[1:])]
            out.append("".join(said))
        return out


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the share of equal hashes among the subsets that have a term of either text (none: 0)."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(16, 16 + 8 * SUBSETS, 8)]
    either = [x == y for x, y in pairs if x != NO_TERM or y != NO_TERM]
    return sum(either) / len(either) if either else 0.0


def lexicon(docs: DataFrame) -> Lexicon:
    """All terms of the band over all docs, 8 bytes each. Each is in LEAST of the documents, so they are at most the mean count of distinct terms of a document, divided by LEAST, however many documents there are."""
    n = docs.count()
    band = document_frequencies(docs).filter((F.col("df") >= max(2, LEAST * n)) & (F.col("df") <= max(2, MOST * n)))
    return Lexicon(np.sort(band.select("term").toPandas()["term"].to_numpy().astype(np.int64).view(np.uint64)))


def fingerprint(docs: DataFrame, lex: Lexicon, keep: list[str]) -> DataFrame:
    """Columns keep of docs with fingerprint of the text (null: empty). No shuffle."""
    from loam.llm.common import with_columns

    sent = docs.sparkSession.sparkContext.broadcast(lex)
    return with_columns(docs, "text", "fingerprint string", lambda texts: [pa.array(sent.value.fingerprints(texts), pa.string())], keep)


def borders(docs: DataFrame, n: int) -> tuple[list[tuple], tuple | None]:
    """Keys (no id, complement of the id, hash of the text, hash of the row's place) of rows that cut docs, in descending doc_id order, into about n ranges; and the first row's key."""
    key = F.struct(F.col("doc_id").isNull().alias("a"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("b"), F.col("mark").alias("c"), F.col("spot").alias("d"))
    keys = docs.select(key.alias("k"))
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).first()
    if not total["n"]:
        return [], None
    some = sorted({tuple(r["k"]) for r in keys.sample(min(1.0, 40 * n / total["n"]), 7).collect()})  # about 40 a range
    return sorted(set(some[:: max(1, len(some) // n)][1:])), tuple(total["first"])


def with_next(docs: DataFrame, lex: Lexicon, splits: int | None = None) -> DataFrame:
    """op3's columns: docs (doc_id, text) against their edits and their followers in descending doc_id order.

    Equal doc_ids are ordered by a hash of the text, then of the row's place; null ones come last, null texts are
    empty, other columns are left out. Documents are dealt by ranges whose borders are keys of documents, texts
    compressed, so that equal rows are dealt out too; a document that begins a range is sent to the range before it as well,
    so that each range holds the followers of all its documents. The first one is also sent to the last range. A
    single document follows itself.
    """
    spark = docs.sparkSession
    parts = splits or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("mark"), F.xxhash64("_file", "_row").alias("spot"))
    cuts, first = borders(rows, 3 * parts)
    sent = spark.sparkContext.broadcast((lex, cuts, first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cuts, first = sent.value
        heads = {c: i for i, c in enumerate(cuts)}
        press = zstandard.ZstdCompressor(3)
        for piece in pieces(batches):
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            rows = []
            for i, text, mark, spot in zip(ids, texts, piece.column("mark").to_pylist(), piece.column("spot").to_pylist()):
                key, packed = (i is None, ~(i or 0), mark, spot), press.compress((text or "").encode())
                rows.append((bisect_right(cuts, key), i, *key, False, packed))
                if key in heads:
                    rows.append((heads[key], i, *key, True, packed))
                if key == first:
                    rows.append((len(cuts), i, *key, True, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value[0]
        open_ = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        for piece in pieces(batches, "packed", 1 << 20):
            held += zip(*(piece.column(c).to_pylist() for c in ("bucket", "doc_id", "look", "packed")))
            yield from pairs([(b, i, look, open_.decompress(p).decode() if isinstance(p, bytes) else p) for b, i, look, p in held], lex)
            held = [h if not isinstance(h[3], bytes) else (*h[:3], open_.decompress(h[3]).decode()) for h in held[-1:]]

    def pairs(rows: list[tuple], lex: Lexicon) -> Iterator[pa.RecordBatch]:
        here = [j for j in range(len(rows) - 1) if not rows[j][2]]
        if not here:
            return
        texts = [r[3] for r in rows]
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in ((texts[j], texts[j + 1]) for j in here)]
        own, other = lex.fingerprints(pa.array(texts, pa.large_string())), lex.fingerprints(pa.array(edited, pa.large_string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[j][1] for j in here], pa.int64()),
                pa.array([len(texts[j]) for j in here], pa.int64()),
                pa.array([sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([own[j] for j in here]),
                pa.array(other),
                pa.array([likeness(own[j], e) for j, e in zip(here, other)], pa.float64()),
                pa.array([likeness(own[j], own[j + 1]) for j in here], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    dealt = rows.mapInArrow(deal, "bucket int, doc_id long, unnamed boolean, minus long, mark long, spot long, look boolean, packed binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "look", "unnamed", "minus", "mark", "spot")
    return dealt.select("bucket", "doc_id", "look", "packed").mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ["bucket", "doc_id", "unnamed", "minus", "mark", "spot", "look", "packed"]
KINDS = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edits against the lexicon of all documents; null is empty, repeated rows follow each other."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return with_next(docs, lexicon(docs))
