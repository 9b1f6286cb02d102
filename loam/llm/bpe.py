"""Byte-level BPE in numpy: batched merge rounds over the symbols of many words, and the way back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loam.llm.common import pieces, ragged, table, tidy
from loam.llm.encoding import KEPT, Units, vocabulary_path

#: The published pre-token pattern of this kind of vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units that are one pre-token for certain: ASCII letters and those of U+00C0 to U+017F with a space before them or none.
ONE = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}]+$"
#: Bits of one id in a pair's key.
BITS = 20


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is visible in Latin-1, else the next free letter from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class BPE(Units):
    """Reads a tokenizers JSON file; encodes and decodes whole texts, each distinct unit once."""

    def __init__(self, path: str | None = None) -> None:
        import regex

        with open(path or vocabulary_path(), encoding="utf-8") as f:
            model = json.load(f)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        said = [b""] * size
        for token, i in vocab.items():
            said[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            said[i] = token.encode()
        self.bytes_len = np.array([len(b) for b in said], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(said), np.uint8)
        self.numerals = [str(i) for i in range(size)]
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << BITS | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pairs, self.ranks = keys[order], np.arange(len(keys))[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.parts = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.never = len(keys)
        super().__init__(size)

    def words(self, text: str) -> list[str]:
        """Pre-tokens; a special token's text is one of its own."""
        if self.parts is None or not self.parts.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [*self.pattern.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << BITS | right
        at = np.minimum(np.searchsorted(self.pairs, key), self.never - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.never)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, and each word's count.

        In a round each word's pairs of its lowest rank merge, at all places from left to right that do not
        overlap; words without pairs of any rank leave. Merging a pair can only make pairs of higher
        ranks than its own, so this equals one merge at a time.
        """
        counts = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), counts)
        done_symbols, done_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(symbols):
            rank = np.full(len(symbols), self.never, np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(heads, append=len(word))
            best = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            live = best < self.never
            done_symbols.append(symbols[~live])
            done_words.append(word[~live])
            symbols, word, rank, best = symbols[live], word[live], rank[live], best[live]
            if not len(symbols):
                break
            hit = rank == best
            fresh = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            run = np.zeros(len(hit), np.int64)
            run[fresh] = fresh
            hit &= (np.arange(len(hit)) - np.maximum.accumulate(run)) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def ids_of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of texts whose pre-tokens stand alone; equal pre-tokens are merged once."""
        split = [self.words(u) for u in texts]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        plain = [w for w in distinct if w not in self.special]
        ids, counts = self.merge([w.encode("utf-8", "surrogatepass") for w in plain])
        flat = np.concatenate([ids, np.array([self.special[w] for w in distinct if w in self.special], np.int32)])
        length = np.zeros(len(distinct), np.int64)
        start = np.zeros(len(distinct), np.int64)
        at = np.array([distinct[w] for w in plain], np.int64)
        length[at], start[at] = counts, np.cumsum(counts) - counts
        other = np.array([distinct[w] for w in distinct if w in self.special], np.int64)
        length[other], start[other] = 1, len(ids) + np.arange(len(other))
        use = np.array([distinct[w] for words in split for w in words], np.int64)
        tokens = flat[ragged(start[use], length[use])] if len(use) else np.zeros(0, np.int32)
        ends = np.concatenate([[0], np.cumsum(length[use])]).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64)
        return tokens.astype(np.int32), np.diff(ends[cut])

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of new units. Those of one pre-token, nearly all, go to the merge rounds as they are."""
        plain = pc.match_substring_regex(units, ONE).to_numpy(zero_copy_only=False)
        one, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        ids, counts = self.merge(units.take(pa.array(one)).cast(pa.large_binary()).to_pylist())
        rest, lengths = self.ids_of_texts(units.take(pa.array(other)).to_pylist())
        return np.concatenate([ids, rest]), np.concatenate([counts, lengths]), [*one.tolist(), *other.tolist()]

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        flat, counts = self.ids_of_texts(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if len(texts) else []

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of the texts that runs of ids stand for; bytes that are not UTF-8 become U+FFFD."""
        lengths = self.bytes_len[ids]
        flat = self.bytes_flat[ragged(self.bytes_at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[at]
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:])]


_own: dict[str | None, BPE] = {}


def own(path: str | None = None) -> BPE:
    if path not in _own:
        _own[path] = BPE(path)
    return _own[path]


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and tokens of docs (doc_id, text); null texts are empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids, at = own(vocabulary).encode(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<int>")


def decode_tokens(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tokens").fill_null([]) if batch.column("tokens").null_count else batch.column("tokens")
            at = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
            texts = own(vocabulary).decode(ids.flatten().to_numpy(), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode and decode docs (doc_id, text) in one pass; only counts and digests leave the worker.

    Null and empty texts have no ids and the digests of empty strings; repeated rows stay; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        model = own(vocabulary)
        for piece in pieces(batches):
            ids, at = model.encode(piece.column("text"))
            numerals = list(map(model.numerals.__getitem__, ids.tolist()))
            of_ids = [sha256(",".join(numerals[a:b]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:])]
            of_text = [sha256(t).hexdigest() for t in model.decode(ids, at)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(at)), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.keep(KEPT)
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_batched_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded texts of all documents; null is empty, one row for each row, no shuffle."""
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
