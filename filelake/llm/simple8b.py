"""Simple-8b: unsigned ids packed into 64-bit words.

The low four bits of a word are its selector, the other 60 hold ``COUNTS[s]`` ids of ``BITS[s]`` bits, the first one
lowest. Selector 15 is the escape: the word stands for one id of more than 60 bits, which follows as a raw word.
A word always takes the largest count whose ids all fit; the last words of a block may be filled up with zeros.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids per word and bits per id of each selector.
COUNTS = (120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

_COUNTS = np.array([*COUNTS, 1], np.int64)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    width = np.zeros(len(ids), np.int64)
    for bits in (*BITS[:-1], 60):
        width[(ids >> np.uint64(bits)) > 0] = bits + 1
    return width


def encode(ids: np.ndarray) -> np.ndarray:
    """The words of one block. ``decode(encode(x), len(x))`` gives x again, for any uint64 values."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, np.uint64)
    width = _widths(ids)
    selector = np.full(n, ESCAPE, np.int64)
    for s in reversed(range(len(BITS))):
        wide = np.concatenate([[0], np.cumsum(width > BITS[s])])
        to = np.minimum(np.arange(n) + COUNTS[s], n)
        selector[wide[to] == wide[:n]] = s
    steps = _COUNTS[selector].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = selector[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    out = np.zeros(len(starts) + int((chosen == ESCAPE).sum()), np.uint64)
    padded = np.concatenate([ids, np.zeros(max(COUNTS), np.uint64)])
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero(chosen == s)
        word = np.full(len(mine), s, np.uint64)
        for k in range(count if bits else 0):
            word |= padded[starts[mine] + k] << np.uint64(4 + k * bits)
        out[place[mine]] = word
    raw = np.flatnonzero(chosen == ESCAPE)
    out[place[raw]] = ESCAPE
    out[place[raw] + 1] = ids[starts[raw]]
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block. Only escapes need a scan; all words of one selector are unpacked at once."""
    words = np.asarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    if (selector == ESCAPE).any():
        head = np.ones(len(words), bool)
        for at in np.flatnonzero(selector == ESCAPE).tolist():
            if head[at]:
                head[at + 1] = False
    else:
        head = np.ones(len(words), bool)
    heads = np.flatnonzero(head)
    selector = selector[heads]
    first = np.concatenate([[0], np.cumsum(_COUNTS[selector])])
    out = np.zeros(int(first[-1]), np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        mine = np.flatnonzero(selector == s)
        if bits and len(mine):
            payload = words[heads[mine]] >> np.uint64(4)
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[first[mine][:, None] + np.arange(count)] = (payload[:, None] >> shifts) & np.uint64((1 << bits) - 1)
    raw = np.flatnonzero(selector == ESCAPE)
    out[first[raw]] = words[heads[raw] + 1]
    return out[:n]
