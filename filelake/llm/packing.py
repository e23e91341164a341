"""Best-fit-decreasing packing of documents into sequences of a fixed number of tokens.

Token counts are cut into pieces first (only documents above the capacity; all their pieces but the first are full).
Pieces of one length are interchangeable, so lengths are packed, not rows: one table of counts, at most ``capacity`` of
them whatever the input, is taken from the longest length to the shortest. Open bins are kept by what remains free in
them, as runs of bins that are filled alike, and a segment tree over the remaining capacities finds the tightest one that
still takes the length, in as many steps as the tree is high. The bins are those that a piece by piece best fit makes.
Pieces then take the places of their length by rank: each task counts its pieces of a length, and running sums over
the tasks make these counts ranks of the whole table.

Nulls: a null text is empty, so its document is the end id alone; a null doc_id is kept. Repeated rows are packed each
by itself. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filelake.llm import common, wordhash
from filelake.llm.encoding import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task_ long, rank_ long"
PACKED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Which remaining capacities 0..capacity have open bins, as a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, by: int) -> None:
        at = remaining + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that has a bin, or -1."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if at & 1 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_runs(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Places for all pieces of each length, as sorted rows (length, first rank, pieces per bin, first bin, offset in the bin).

    Ranks of a length fill the bins of a row one after the other until the next row of that length begins. No length may be
    0 or above the capacity. What remains of a run is less than half of it after each use, and a length cuts at
    most one run in three, so there are at most about ``4 * capacity * log2(capacity)`` rows, however many pieces there are.
    """
    tree, open_runs = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    rows: list[tuple[int, int, int, int, int]] = []

    def keep(left: int, first: int, bins: int) -> None:
        if bins:
            open_runs[left].append((first, bins))
            tree.add(left, 1)

    made = 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = tree.tightest(length)
            if left < 0:
                left, first, bins = capacity, made, -(-(n - rank) // (capacity // length))
                made += bins
            else:
                first, bins = open_runs[left].pop()
                tree.add(left, -1)
            each = left // length
            full = min(bins, (n - rank) // each)
            rest = n - rank - full * each if full < bins else 0
            rows.append((length, rank, each, first, capacity - left))
            keep(left - each * length, first, full)
            keep(left - rest * length, first + full, int(rest > 0))
            untouched = full + int(rest > 0)
            keep(left, first + untouched, bins - untouched)
            rank += full * each + rest
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, made = encoder(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at, texts in wordhash.slices(batch.column(1)):
                flat, offsets = bpe.encode(texts)
                rows: list[tuple] = []
                keys = batch.column(0).slice(at, len(texts)).to_pylist()
                for k, key in enumerate(keys):
                    own = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    first = len(own) % capacity or min(len(own), capacity)
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((key, i, a, b - a, zlib.crc32(own[a:b]), task, made[b - a]))
                        made[b - a] += 1
                if not rows:
                    continue
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 5))]
                yield pa.RecordBatch.from_arrays(columns, PIECE_SCHEMA.replace(" int", "").replace(" long", "").split(", "))

    return run


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 44) + rank


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = _key(runs[:, 0], runs[:, 1])
        for batch in batches:
            length, rank = (batch.column(name).to_numpy() for name in ("length", "rank_"))
            _, begins, each, first, offset = runs[np.searchsorted(keys, _key(length, rank), side="right") - 1].T
            bins, inside = np.divmod(rank - begins, each)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first + bins), pa.array(offset + inside * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, its task, and how many of its length that task made before."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity, end_id), PIECE_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its ``sequence_id`` and its ``offset`` there.

    The small table of pieces is staged, so a lost executor never has texts encoded again, and ranks never change. The
    driver sees the counts of the lengths only; the places are broadcast, a table bounded by the capacity alone. The
    window over a length has one row per task.
    """
    made = common.stage(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = made.groupBy("task_", "length").agg(F.count("*").alias("n_"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n_").alias("n")).collect()}
    places = docs.sparkSession.sparkContext.broadcast(best_fit_runs(totals, capacity))
    before = W.partitionBy("length").orderBy("task_").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("task_", "length", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("from_"))
    ranked = made.join(starts, ["task_", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("from_") + F.col("rank_")).alias("rank_"))
    return ranked.mapInArrow(_placed(places), PACKED_SCHEMA)
