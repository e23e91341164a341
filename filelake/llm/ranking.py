"""Ranked lexical search: every item of a table as a query against all documents, the best ``k`` of each.

``build_index`` writes one row per block of documents: the block's terms in ascending order of their 64-bit hashes, and
behind one another their inverted lists (documents ascending, occurrences). ``search`` then runs each item over each block:

* **TAAT.** The item's short lists in the block are summed into accumulators, one list after the other.
* **DAAT.** The accumulators are one more iterator, bounded by their largest sum, beside the long lists, each bounded by
  its largest contribution, overall and for every stretch of documents. Stretches whose bounds cannot reach the score of
  the k-th best are skipped; in the others candidates come only from the iterators without which that score is out of
  reach, and the rest is looked up for candidates that can still reach it.

The k-th best score is carried from block to block of a task. A task returns k rows per item at most; documents whose
bound equals that score are looked at, so ties are whole. Items are taken in batches of ``TERMS_AT_ONCE`` terms (and one
item more at most): that much is broadcast, whatever the number of items. All integers are of 64 bits.

Defined cases: a null or empty text, or one without terms, is no document and as an item has no rows; a repeated row is a
document (or an item) of its own; a null doc_id sorts before all others; fewer than k documents above 0: all of them; an
empty table gives no rows; extra columns are not read. A document with a very long text is a block of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelake.llm import common, wordhash

BLOCK_BYTES = 8 << 20  # text of a block
STRETCH = 512  # documents that share a bound
SHORT = 16  # a list is short if it holds at most one in so many of a block's documents
TERMS_AT_ONCE = 1 << 20

INDEX_SCHEMA = "n_docs long, n_terms long, doc_ids binary, lengths binary, terms binary, counts binary, docs binary, tfs binary"
NONE = -(1 << 63)

#: Bytes of terms: digits, letters and all that is not ASCII.
TERM_BYTES = np.zeros(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTES[_first : _last + 1] = True


def _block(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """The index row of some documents; documents without terms are left out."""
    hashes, offsets = wordhash.words(texts, of=TERM_BYTES)
    ids = ids.fill_null(NONE).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    order = np.argsort(ids, kind="stable")
    order = order[lengths[order] > 0]
    place = np.full(len(ids), -1)
    place[order] = np.arange(len(order))
    owner = np.repeat(place, lengths)
    by = np.lexsort((owner, hashes))
    hashes, owner = hashes[by], owner[by]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    tfs = np.diff(np.append(at, len(hashes)))
    terms, counts = np.unique(hashes[at], return_counts=True)
    parts = ((ids[order], "<i8"), (lengths[order], "<i8"), (terms, "<u8"), (counts, "<u4"), (owner[at], "<u4"), (tfs, "<u4"))
    return [pa.array([len(order)]), pa.array([int(lengths.sum())]), *(pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in parts)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    for ids, texts in wordhash.gathered(batches, BLOCK_BYTES):
        yield pa.RecordBatch.from_arrays(_block(ids, texts), names)


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text), written to the shared folder and read back; one row per block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stage(rows.mapInArrow(_blocks, INDEX_SCHEMA), "index")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, offsets = wordhash.distinct(*wordhash.words(batch.column(1), of=TERM_BYTES))
        items = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(hashes.view(np.int64))], ["item", "term"])


def _frequencies(wanted):
    """Index rows (terms, counts) -> (term, documents that hold it) of the wanted terms, summed over a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = wanted.value
        sums = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms, counts = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<u4")
                if len(terms):
                    place = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
                    sums += np.where(terms[place] == asked, counts[place], 0)
        some = sums > 0
        yield pa.RecordBatch.from_arrays([pa.array(asked[some].view(np.int64)), pa.array(sums[some])], ["term", "df"])

    return run


class Best:
    """The k best (score, doc_id) so far: highest score first, then lowest doc_id."""

    def __init__(self, k: int) -> None:
        self.k, self.least = k, 1
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = max(1, int(self.scores[-1]))


def hybrid(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, best: Best,
           stretch: int = STRETCH, short: int = SHORT) -> None:
    """One item in one block. lists: (documents ascending, contributions, largest contribution of each stretch)."""
    n, n_stretches = len(ids), -(-len(ids) // stretch)
    sums, long = np.zeros(n, np.int64), []
    for docs, gains, tops in lists:
        if len(docs) * short <= n:
            sums[docs] += gains
        else:
            long.append((docs, gains, tops))
    found = np.flatnonzero(sums)
    if len(found):
        tops = np.zeros(n_stretches, np.int64)
        np.maximum.at(tops, found // stretch, sums[found])
        long.append((found, sums[found], tops))
    if not long:
        return
    bounds = np.stack([tops for _, _, tops in long])
    cuts = [np.searchsorted(docs, np.arange(n_stretches + 1) * stretch) for docs, _, _ in long]
    total = bounds.sum(axis=0)
    for s in np.argsort(-total, kind="stable").tolist():
        if total[s] < best.least:
            break
        order = np.argsort(bounds[:, s], kind="stable")
        reach = np.cumsum(bounds[order, s])
        optional = int(np.searchsorted(reach, best.least))  # all of these together stay below the k-th best
        score = np.zeros(stretch, np.int64)
        base = s * stretch
        for x in order[optional:].tolist():
            docs, gains, _ = long[x]
            part = slice(cuts[x][s], cuts[x][s + 1])
            score[docs[part] - base] += gains[part]
        docs = np.flatnonzero(score)
        score = score[docs]
        for left in range(optional - 1, -1, -1):
            alive = score + reach[left] >= best.least
            docs, score = docs[alive], score[alive]
            if not len(docs):
                break
            x = int(order[left])
            part = slice(cuts[x][s], cuts[x][s + 1])
            members = long[x][0][part] - base
            if len(members):
                place = np.minimum(np.searchsorted(members, docs), len(members) - 1)
                score = score + np.where(members[place] == docs, long[x][1][part][place], 0)
        alive = score >= best.least
        if alive.any():
            best.add(score[alive], ids[docs[alive] + base])


def _search(asked, n: int, length: int, k: int, stretch: int, short: int):
    """Index rows -> (item, doc_id, score), the k best of each item among a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, wanted, number, weights = asked.value
        best = [Best(k) for _ in items]
        for batch in batches:
            for ids, lengths, terms, counts, docs, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                ids, lengths, terms = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8"), np.frombuffer(terms, "<u8")
                if not len(ids):
                    continue
                ends = np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)
                docs, tfs = np.frombuffer(docs, "<u4").astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64)
                place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                here = terms[place] == wanted
                m = 50 + (50 * lengths * n) // length
                n_stretches = -(-len(ids) // stretch)
                lists: dict[int, tuple] = {}
                for t in np.flatnonzero(here).tolist():
                    end = ends[place[t]]
                    part = slice(ends[place[t] - 1] if place[t] else 0, end)
                    d, tf = docs[part], tfs[part]
                    gains = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[d]))
                    tops = np.zeros(n_stretches, np.int64)
                    np.maximum.at(tops, d // stretch, gains)
                    lists[t] = (d, gains, tops)
                for i in range(len(items)):
                    mine = [lists[t] for t in number[starts[i] : starts[i + 1]].tolist() if t in lists]
                    if mine:
                        hybrid(mine, ids, best[i], stretch, short)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            doc_ids = np.concatenate([b.ids for b in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(items, sizes)), pa.array(doc_ids, mask=doc_ids == NONE), pa.array(np.concatenate([b.scores for b in best]))],
                ["item", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above 0 of every row of ``items`` (item_id, text)."""
    spark = index.sparkSession
    empty = spark.createDataFrame([], "item long, doc_id long, score long")
    named = common.stage(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = common.stage(named.select("item", "text").mapInArrow(_item_terms, "item long, term long"), "item_terms")
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_batches = -(-pairs.count() // TERMS_AT_ONCE)
    found = empty
    if size.n:
        for b in range(n_batches):
            batch = pairs.where(F.pmod(F.xxhash64("item"), F.lit(n_batches)) == b).orderBy("item", "term").toPandas()
            item, term = batch["item"].to_numpy(np.int64), batch["term"].to_numpy(np.int64).view(np.uint64)
            wanted = np.unique(term)
            counted = index.select("terms", "counts").mapInArrow(
                _frequencies(spark.sparkContext.broadcast(wanted)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
            df = np.zeros(len(wanted), np.int64)
            df[np.searchsorted(wanted, counted["term"].to_numpy(np.int64).view(np.uint64))] = counted["df"].to_numpy(np.int64)
            weights = np.array([math.floor(1000 * math.log((2 * size.n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
            names, starts = np.unique(item, return_index=True)
            asked = (names, np.append(starts, len(item)), wanted, np.searchsorted(wanted, term), weights)
            hits = index.select("doc_ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(
                _search(spark.sparkContext.broadcast(asked), size.n, size.l, k, STRETCH, SHORT), "item long, doc_id long, score long")
            found = found.unionByName(hits)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    part = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.desc("score"), "doc_id"))
    first = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).withColumn("rank", part).where(F.col("rank") <= k)
    ranked = first.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
