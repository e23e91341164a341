"""Words and word windows of a column of texts as 64-bit hashes, one numpy pass over the bytes of an Arrow batch.

A word is a run of bytes outside space and \\t..\\r, as those six bytes never occur inside a multi-byte character.
Its hash is a polynomial over its bytes modulo 2^64, mixed; equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, kept for the next batch."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 21)
        for key, base in (("up", BASE), ("down", _INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and n+1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most_bytes: int = 2 << 20):
    """Consecutive (start, part) slices of about most_bytes; a longer text stands alone."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of the texts whose bytes and offsets these are; none goes beyond its text."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13))) if of is None else of[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    text_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[text_starts] = inside[text_starts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def gathered(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(first column, texts) of consecutive rows with about most_bytes of text, over the borders of batches."""
    held, size = [], 0
    for batch in batches:
        for at, texts in slices(batch.column(1), most_bytes):
            if held and size + texts.nbytes > most_bytes:
                yield tuple(pa.concat_arrays([part[k] for part in held]) for k in (0, 1))
                held, size = [], 0
            held.append((batch.column(0).slice(at, len(texts)), texts))
            size += texts.nbytes
    if held:
        yield tuple(pa.concat_arrays([part[k] for part in held]) for k in (0, 1))


def words(texts: pa.Array, lower: bool = True, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n+1 offsets of the texts' words); lower: A-Z count as a-z.

    of: 256 flags of the bytes that words are made of, if not of all but white space; bytes from 128 must be all in or out.
    """
    data, offsets = string_bytes(texts)
    n = len(offsets) - 1
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends = runs(data, offsets, of)
    up, down = _power_table(len(data) + 1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, n+1 offsets); a text of fewer words has its whole sequence as one window."""
    n_words = np.diff(offsets)
    counts = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    out = np.zeros(n_words.size + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    total = int(out[-1])
    if total == 0:
        return np.empty(0, np.uint64), out
    at = np.arange(total) - np.repeat(out[:-1], counts) + np.repeat(offsets[:-1], counts)
    width = np.minimum(np.repeat(n_words, counts), size)
    value = mix(width.astype(np.uint64))
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        value = np.where(k < width, mix(value ^ padded[at + k] * np.uint64(2 * k + 3)), value)
    return value, out


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text its distinct hashes in ascending order."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(counts.size), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    out = np.zeros(counts.size + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=counts.size), out=out[1:])
    return hashes[keep], out
