"""Whole texts to ids with the tokenizers library, each distinct stretch between certain pre-token borders once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loam.llm.common import pieces, ragged, tidy

VOCABULARY = "byte_bpe_50k.json"
#: A text with this in it is encoded as it is.
SPECIAL = "<|endoftext|>"
#: Units that can be joined by line feeds to be encoded as one string: no white space but one space in front.
PLAIN = r"^ ?[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+$"
#: Units that are encoded as one string.
JOINED = 100
#: Units that a worker remembers between pieces, at most (some 40 bytes each); those that it keeps between tasks; and their ids.
REMEMBERED, KEPT, SHORT = 400_000, 200_000, 32

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z")) & (_BYTES < 128)
_DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_WHITE = ((_BYTES >= 9) & (_BYTES <= 13)) | ((_BYTES >= 28) & (_BYTES <= 32))
#: Letter, digit, white space, other ASCII, byte of a longer character.
LETTER, DIGIT, WHITE, MARK, LONG = 0, 1, 2, 3, 4
KIND = np.select([_LETTER, _DIGIT, _WHITE, _BYTES < 128], [LETTER, DIGIT, WHITE, MARK], LONG).astype(np.uint8)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unit_starts(d: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes a pre-token of the byte-level pattern begins whatever stands farther on either side.

    The pattern takes runs of letters, of digits and of other marks, each with one space before it, English
    contractions (an apostrophe and letters) and white space, whose last character stands alone before a word. So
    a border is certain: before a space that follows no white space; between two of letter, digit and mark, but
    not from apostrophe to letter; from them to white space; and after one single line feed. Letters beyond ASCII count
    if they are those of U+00C0 to U+017F; other characters get no border but a space. Missing borders make longer
    units, never wrong ones.
    """
    out = np.zeros(len(d), bool)
    if len(d) < 2:
        return out
    kind = KIND[d]
    white = kind == WHITE
    letter = kind == LETTER  # here the last byte of a letter
    head = letter.copy()  # the first one
    if (kind == LONG).any():
        two = (d[:-1] >= 0xC3) & (d[:-1] <= 0xC5) & ~((d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7)))
        letter[1:] |= two
        head[:-1] |= two
        for lead, rest in ((0xC2, (0x85,)), (0xC2, (0xA0,))):
            white[1:] |= (d[:-1] == lead) & (d[1:] == rest[0])
        if (d >= 0xE1).any():
            three = lambda a, b, low, high: (d[:-2] == a) & (d[1:-1] == b) & (d[2:] >= low) & (d[2:] <= high)
            for space in ((0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8A), (0xE2, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0xAF, 0xAF), (0xE2, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80)):
                white[2:] |= three(*space)
    before, now, feed = kind[:-1], kind[1:], d == 10
    from_letter, from_digit, from_mark = letter[:-1], before == DIGIT, before == MARK
    mark = now == MARK
    cut = (d[1:] == 32) & ~white[:-1]
    cut |= from_letter & ((now == DIGIT) | mark | feed[1:])
    cut |= from_digit & (mark | feed[1:] | (now == LETTER))
    cut |= from_mark & ((now == DIGIT) | feed[1:] | (head[1:] & (d[:-1] != ord("'"))))
    cut[1:] |= feed[1:-1] & ~white[:-2] & ((now[1:] == DIGIT) | mark[1:] | head[2:])
    out[1:] = cut
    return out


def marks(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string of a large_string array: 128 bits name a unit."""
    at = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
    d = np.frombuffer(units.buffers()[2], np.uint8)[at[0] : at[-1]] if len(units) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return byte_hashes(d, at[:-1] - at[0], np.diff(at)), byte_hashes(d, at[:-1] - at[0], np.diff(at), True)


def byte_hashes(d: np.ndarray, start: np.ndarray, size: np.ndarray, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each run of bytes, eight at a time; other: an independent one."""
    first, second = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53) if other else (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
    out = stir(~size.astype(np.uint64) if other else size.astype(np.uint64), 0xD6E8FEB86659FD93, first)
    padded = np.concatenate([d, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.as_strided(padded, (len(d) + 1, 8), (1, 1))
    live: np.ndarray | slice = slice(None)
    for k in range(0, int(size.max(initial=0)), 8):
        if k:
            live = np.flatnonzero(size > k) if k == 8 else live[size[live] > k]
        word = windows[start[live] + k].view("<u8").ravel()
        over = np.clip(8 - (size[live] - k), 0, 7).astype(np.uint64) * np.uint64(8)
        word &= ~np.uint64(0) >> over
        out[live] = stir(out[live] + word if other else out[live] ^ word, first, second)
    return out


def stir(x: np.ndarray, first: int, second: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(first)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(second)
        return x ^ (x >> np.uint64(31))


class Units:
    """Ids of columns of texts that are cut to units at certain pre-token borders (unit_starts), so that a unit is encoded alone as it is in its text.

    Ids are remembered under 128 bits of hashes of a unit. A subclass tells the ids of units (ids_of) and of
    whole texts (direct); texts with the special token's text take the latter way.
    """

    def __init__(self, size: int) -> None:
        self.kind = np.uint16 if size <= 1 << 16 else np.int32
        self.forget()

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Flat ids and counts of distinct units, and the order in which these are."""
        raise NotImplementedError

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # in the order of keys, as the arrays below
        self.lengths, self.starts, self.uses = (np.zeros(0, np.int32) for _ in range(3))
        self.flat = np.zeros(0, self.kind)

    def keep(self, most: int) -> None:
        """Forget all but units of few ids that several pieces used, the most used ones."""
        at = np.flatnonzero((self.uses > 1) & (self.lengths <= SHORT))
        if len(at) > most:
            at = np.sort(at[np.argsort(-self.uses[at], kind="stable")[:most]])
        self.flat = self.flat[ragged(self.starts[at], self.lengths[at])]
        self.keys, self.checks, self.lengths, self.uses = self.keys[at], self.checks[at], self.lengths[at], self.uses[at]
        self.starts = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths).astype(np.int32)

    def learn(self, units: pa.Array, keys: np.ndarray, checks: np.ndarray) -> None:
        """Encode new units and remember them."""
        new, lengths, order = self.ids_of(units)
        keys = np.concatenate([self.keys, keys[order]])
        by = np.argsort(keys, kind="stable")
        self.keys, self.checks = keys[by], np.concatenate([self.checks, checks[order]])[by]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths]).astype(np.int32)[by]
        self.lengths = np.concatenate([self.lengths, lengths]).astype(np.int32)[by]
        self.uses = np.concatenate([self.uses, np.zeros(len(lengths), np.int32)])[by]
        self.flat = np.concatenate([self.flat, new.astype(self.kind)])

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of units among the known ones, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def places(self, units: pa.Array) -> np.ndarray:
        """Where distinct units are among the known ones; new ones are learned."""
        keys, checks = marks(units)
        at = self.find(keys, checks)
        new = np.flatnonzero(at < 0)
        if len(new):
            self.learn(units.take(pa.array(new)), keys[new], checks[new])
            at = self.find(keys, checks)
        self.uses[at] += 1
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's ids start (with the end). Null texts are empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
        if special.any():
            runs: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
            safe = np.flatnonzero(~special)
            flat, at = self.encode(texts.take(pa.array(safe)))
            for k, i in enumerate(safe):
                runs[i] = flat[at[k] : at[k + 1]]
            for i in np.flatnonzero(special):
                runs[i] = self.direct([texts[int(i)].as_py()])[0]
            return np.concatenate([np.zeros(0, np.int32), *runs]), np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        start = offsets - offsets[0]
        size = int(start[-1])
        if not size:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        d = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        cut = unit_starts(d)
        cut[start[start < size]] = True
        heads = np.flatnonzero(cut)
        units = pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(np.append(heads, size)), pa.py_buffer(d))
        coded = units.dictionary_encode()
        found = self.places(coded.dictionary)
        if (found < 0).any():  # two units with equal keys and different checks
            self.forget()
            runs = self.direct(texts.to_pylist())
            return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
        place = found[coded.indices.to_numpy()]
        lengths = self.lengths[place]
        total = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        flat = self.flat[ragged(self.starts[place], lengths)].astype(np.int32)
        if len(self.keys) > REMEMBERED or len(self.flat) > 8 * REMEMBERED:
            self.keep(REMEMBERED // 2)
        return flat, total[np.searchsorted(heads, start)]


class Encoder(Units):
    """With the tokenizers library; the ids equal those of its encode(text, add_special_tokens=False).

    Units new to the worker are joined by line feeds, encoded together and cut again at the feed's id.
    """

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.feed = self.direct(["\n"])[0]
        super().__init__(self.tokenizer.get_vocab_size())

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        names = units.to_pylist()
        plain = pc.match_substring_regex(units, PLAIN).to_numpy(zero_copy_only=False) if len(self.feed) == 1 else np.zeros(len(names), bool)
        together, alone = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        flat: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        order: list[int] = []
        groups = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
        for group, ids in zip(groups, self.direct(["\n".join([names[i] for i in g]) for g in groups])):
            feeds = np.flatnonzero(ids == self.feed[0])
            if len(feeds) == len(group) - 1:
                flat.append(np.delete(ids, feeds))
                counts.append(np.diff(feeds, prepend=-1, append=len(ids)) - 1)
                order += group
            else:
                alone += group
        runs = self.direct([names[i] for i in alone])
        counts.append(np.fromiter(map(len, runs), np.int64, len(runs)))
        return np.concatenate([*flat, *runs, np.zeros(0, np.int32)]), np.concatenate(counts), order + alone


_own: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The worker's own encoder."""
    if path not in _own:
        _own[path] = Encoder(path)
    return _own[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str | None = None, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches with their ids and starts. At the end the worker keeps the most used units only."""
    own = encoder(path)
    for part in pieces(batches, column):
        yield part, *own.encode(part.column(column))
    own.keep(KEPT)
    tidy()
