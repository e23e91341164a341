"""I-Match document fingerprints over several randomised subsets of a lexicon.

The lexicon holds the terms whose inverse document frequency, divided by its largest possible value ``ln(documents)``,
lies in a chosen band; very frequent and nearly unique terms are left out. A text's distinct terms are looked up in it
and sorted. For each of ``REPEATS`` random numberings of the terms, nested subsets keep a quarter, a sixteenth, ... of
the lexicon; the text's terms in a subset are hashed to one code. A fingerprint has the codes of the two subset sizes
in which a text of that many terms has about one term and less, so short and long texts are told apart equally well.

Document frequencies are counted over all documents, per term hash of 56 bits (the eighth byte would only move). The lexicon is a blocked Bloom filter of the
terms whose own frequency is in the band, with 16 bits a term counted: it grows with the lexicon up to ``MOST_BLOCKS`` blocks
of 32 bytes (128 MB, 67 million terms), the bound that makes it safe to broadcast. No term of the band is left out. One outside
it passes in about one of 500 cases; beyond 67 million terms more do, with 134 million about one of 30.

Words are runs outside space and \\t..\\r, A-Z taken as a-z. Defined cases: a null text is empty; a text without words
has the all-empty fingerprint; with fewer than ``FEWEST`` terms in the band all of a text's terms are used. An empty
table gives an empty lexicon. Equal texts have equal fingerprints. Only the columns asked for are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import url_list, wordhash

MOST_BLOCKS = 1 << 22
KEY = ~np.uint64(0xFF)  # the bits of a term hash by which it is counted
REPEATS = 48
FEWEST = 8
WIDTH = 4 * REPEATS  # hex digits of one subset size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in wordhash.slices(batch.column(0)):
            hashes, offsets = wordhash.distinct(*wordhash.words(texts))
            term, n = np.unique(hashes & KEY, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], ["term", "n"])


@dataclass(frozen=True)
class Lexicon:
    table: np.ndarray

    def member(self, hashes: np.ndarray) -> np.ndarray:
        return url_list.has(self.table, hashes & KEY)


def build_lexicon(docs: DataFrame, low: float = 0.2, high: float = 0.95) -> Lexicon:
    """The lexicon of all texts. low, high: the band of ln(documents / document frequency) / ln(documents)."""
    n = docs.count()
    scale = math.log(n) if n > 1 else 1.0
    counts = docs.select("text").mapInArrow(_count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    share = F.log(F.lit(float(max(n, 1))) / F.col("df")) / scale
    inside = counts.where(share.between(low, high)).select("term").persist()  # 8 bytes a term; a lost part is made again
    try:
        return Lexicon(url_list.filter_of(inside, url_list.blocks_for(inside.count(), MOST_BLOCKS)))
    finally:
        inside.unpersist()


def _level(n: np.ndarray) -> np.ndarray:
    """The smaller of the two exponents of four by which a text of n terms thins the lexicon."""
    return np.ceil(np.maximum(np.log2(np.maximum(n, 1) / 2) / 2, 0)).astype(np.int64)


_SEEDS = wordhash.mix(np.arange(1, REPEATS + 1, dtype=np.uint64) << np.uint64(32))


def fingerprints(texts: pa.Array, lexicon: Lexicon) -> list[str]:
    """One fingerprint per text: level, colon, codes of the level, codes of the next one."""
    out: list[str] = []
    for _, part in wordhash.slices(texts):
        terms, offsets = wordhash.distinct(*wordhash.words(part))
        counts = np.diff(offsets)
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = lexicon.member(terms)
        few = np.bincount(owner[inside], minlength=len(counts)) < FEWEST
        inside |= few[owner]
        terms, owner = terms[inside], owner[inside]
        level = _level(np.bincount(owner, minlength=len(counts)))
        codes = np.zeros((len(counts), 2 * REPEATS), np.uint64)
        bits = 2 * level[owner]
        for r, seed in enumerate(_SEEDS):
            number = wordhash.mix(terms ^ seed)
            leading = number >> np.maximum(64 - bits, 1).astype(np.uint64)
            chosen = np.flatnonzero((leading == 0) | (bits == 0))
            value, who = wordhash.mix(number[chosen]), owner[chosen]
            np.add.at(codes[:, r], who, value)
            deeper = number[chosen] >> (62 - bits[chosen]).astype(np.uint64) == 0
            np.add.at(codes[:, REPEATS + r], who[deeper], value[deeper])
        short = np.where(codes == 0, 0, 1 + (wordhash.mix(codes) % np.uint64(65535))).astype(">u2")
        out += [f"{at:x}:{row.tobytes().hex()}" for at, row in zip(level.tolist(), short)]
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal codes among those that are set in either, over the subset sizes that both have; 1.0 if equal."""
    if a == b:
        return 1.0
    (la, ca), (lb, cb) = ((int(x[: x.index(":")], 16), x[x.index(":") + 1 :]) for x in (a, b))
    same = either = 0
    for level in {la, la + 1} & {lb, lb + 1}:
        x, y = ca[(level - la) * WIDTH :][:WIDTH], cb[(level - lb) * WIDTH :][:WIDTH]
        for k in range(0, WIDTH, 4):
            p, q = x[k : k + 4], y[k : k + 4]
            if p != "0000" or q != "0000":
                either += 1
                same += p == q
    return same / either if either else 0.0
