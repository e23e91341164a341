"""Byte-level BPE ids of a column of texts, each distinct chunk of text encoded once per Python worker.

Texts are cut where the tokenizer's own splitting always has a border: before a space, and around a newline, that
stands alone between two characters that are no white space; and where a letter meets an ASCII sign or digit. Ids of the chunks laid end to end are then the ids of
the text. Chunks repeat, so most come from a cache; the tokenizers library encodes the others.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa

from filelake.llm import wordhash

LONGEST_CACHED = 64  # bytes; longer chunks are encoded each time
MOST_CACHED = 1_000_000  # chunks; a full cache starts anew


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _solid() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte ends, or begins, a character that is no white space (False where that is not certain)."""
    ends, begins = np.zeros(256, bool), np.zeros(256, bool)
    ends[0x21:0x80] = begins[0x21:0x80] = True
    begins[0xC3:0xE0] = begins[0xE4:0xF5] = True
    return ends, begins


_ENDS, _BEGINS = _solid()
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


def cut_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start, for texts laid end to end."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    before = np.zeros(n, bool)
    before[1:] = _ENDS[data[:-1]]
    if n > 2:
        before[2:] |= (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    after = np.zeros(n, bool)
    after[:-1] = _BEGINS[data[1:]]
    lone = ((data == 32) | (data == 10)) & before & after
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    lone[firsts] = lone[lasts] = False
    start = lone.copy()
    start[1:] |= lone[:-1] & (data[:-1] == 10)
    sign = (data > 0x20) & (data < 0x7F) & ~_LETTER[data]
    start[1:] |= sign[1:] & _LETTER[data[:-1]]
    if n > 2:
        accented = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
        start[2:] |= sign[2:] & accented
    start[firsts] = True
    return np.flatnonzero(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each of the given runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class ChunkEncoder:
    """Encodes texts chunk by chunk, with a cache. A kind of tokens gives ``cuts`` and ``encode_chunks``."""

    def __init__(self) -> None:
        self._clear()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start, for texts laid end to end."""
        raise NotImplementedError

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # ascending, with the number of each chunk beside it
        self.numbers = np.empty(0, np.int64)
        self.count = 0
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 16, np.int64)
        self.lengths = np.empty(1 << 16, np.int64)

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Encode the chunks; their numbers in the pool."""
        ids = self.encode_chunks(chunks)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array(list(itertools.chain.from_iterable(ids)), np.uint32)
        first, count = self.count, len(chunks)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(flat)))
        if first + count > len(self.starts):
            self.starts, self.lengths = (np.resize(x, 2 * (first + count)) for x in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first : first + count] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first : first + count] = lengths
        self.used += len(flat)
        self.count += count
        return np.arange(first, first + count)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, n+1 offsets); a null text is empty."""
        data, offsets = wordhash.string_bytes(texts)
        if len(data) == 0:
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.count > MOST_CACHED:
            self._clear()
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        up, down = wordhash._power_table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        keys = wordhash.mix((sums[ends] - sums[starts]) * down[starts])
        long = np.flatnonzero(ends - starts > LONGEST_CACHED)
        keys[long] = long.astype(np.uint64)  # told apart below by their place
        short = np.flatnonzero(ends - starts <= LONGEST_CACHED)
        unique, at, inverse = np.unique(keys[short], return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        numbers = np.empty(len(unique), np.int64)
        numbers[known] = self.numbers[place[known]]
        new = np.flatnonzero(~known)
        raw = data.tobytes()

        def chunks(which: np.ndarray) -> list[str]:
            return [raw[a:b].decode() for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]

        if len(new):
            numbers[new] = self._add(chunks(short[at[new]]))
            self.keys = np.insert(self.keys, place[new], unique[new])
            self.numbers = np.insert(self.numbers, place[new], numbers[new])
        chunk = np.empty(len(starts), np.int64)
        chunk[short] = numbers[inverse]
        if len(long):
            chunk[long] = self._add(chunks(long))
        lengths = self.lengths[chunk]
        ids = self.pool[ragged(self.starts[chunk], lengths)]
        ends_of = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends_of[np.searchsorted(starts, offsets)]


class Encoder(ChunkEncoder):
    """Byte-level BPE with ``add_special_tokens=False``; the names of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        super().__init__()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return cut_starts(data, offsets)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(chunks, add_special_tokens=False)]


_encoders: dict[tuple[type, str], ChunkEncoder] = {}


def encoder(path: str, kind: type[ChunkEncoder] = Encoder) -> ChunkEncoder:
    """One per Python worker, so its cache serves all tasks that run there."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
