"""Passages that repeat across documents, by suffix trees over words, and documents without them.

A suffix of a document is what starts at one of its words; here it is cut to ``depth`` words, so an inner node of that
depth with two leaves is a passage that occurs twice. A passage is taken out of all documents but that of the smallest
doc_id; overlapping ones grow together. Texts are gathered in *pieces*, written once:

1. **Which suffixes matter.** Every piece deals 32 bits of the hash of each of its distinct windows of ``depth`` words over
   tasks, and gets one bit back: does another piece have it (or, in one of 2^32 times the tasks, seem to). The same
   message tells which documents are copies, word for word, of one with a smaller doc_id; those need no tree.
2. **Prefix groups.** Suffixes are dealt by variable-length prefixes: by their first word; where more than a group's share
   of all suffixes begin so, by the first two, and so on. The counts come from one table of ``CLASSES`` prefix hashes for
   each length. A piece sends equal suffixes once, with its smallest doc_id, so a passage that is everywhere costs a task
   one row per piece.
3. **Subtrees.** A task sorts its suffixes by their words; common prefixes of neighbours give the inner nodes. Nodes of
   full depth have their smallest doc_id, and pieces hear which of their windows begin in a smaller one.
4. Every piece marks the words of such windows, and of those that it has itself in a document with a smaller doc_id.

A suffix travels as 16 bits of each word and 64 of the whole, so equal ones are told by 272 bits; copies by 64 bits.

Defined cases: a null or empty text has no words and nothing is removed; nor is anything from a row without doc_id, which
takes nothing from others either; rows of equal doc_id take nothing from one another; texts of fewer than ``depth`` words
stay whole; an empty table gives no rows; extra columns are not read. A very long text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import common, wordhash
from filelake.llm.pieces import MESSAGE, NONE, beside, bits, message, packed, planes, seat_of, unbits, unpacked, unplanes, with_replies

PIECE_BYTES = 4 << 20
CLASSES = 1 << 12  # prefix hashes of one length are counted in so many classes
GROUPS = 4  # groups per task that a prefix may fill before it is made longer


class Piece:
    """Texts with their words, and the windows of those that have a doc_id."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, depth: int) -> None:
        self.ids, self.texts, self.depth = ids, texts, depth
        self.hashes, self.offsets = wordhash.words(texts, lower=False)
        self.n_words = np.diff(self.offsets)
        count = np.where(ids == NONE, 0, np.maximum(self.n_words - depth + 1, 0))
        ends = np.cumsum(count)
        self.doc = np.repeat(np.arange(len(ids)), count)
        self.at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offsets[:-1] - (ends - count), count)

    def prefixes(self) -> Iterator[np.ndarray]:
        """Hashes of the first 1, 2, ... ``depth`` words of every window."""
        value = np.full(len(self.at), self.depth, np.uint64)
        for k in range(self.depth):
            value = wordhash.mix(value ^ self.hashes[self.at + k] * np.uint64(2 * k + 3))
            yield value

    def windows(self) -> None:
        """Hashes of the windows; the distinct ones in ascending order with their smallest doc_id."""
        for self.window in self.prefixes():
            pass
        order = np.lexsort((self.ids[self.doc], self.window))
        sorted_ = self.window[order]
        first = np.ones(len(order), bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        self.distinct, self.example = sorted_[first], order[first]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(first) - 1
        self.least = self.ids[self.doc[self.example]]

    def copy_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents with windows, and hashes of their whole word sequences."""
        place = np.arange(len(self.hashes), dtype=np.uint64) - np.repeat(self.offsets[:-1], self.n_words).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(wordhash.mix(self.hashes ^ wordhash.mix(place)), dtype=np.uint64)])
        docs = np.flatnonzero((self.ids != NONE) & (self.n_words >= self.depth))
        total = sums[self.offsets[docs + 1]] - sums[self.offsets[docs]]
        return docs, wordhash.mix(total ^ self.n_words[docs].astype(np.uint64))


def _pieces(depth: int):
    """(doc_id, text) -> pieces: ids, lengths and compressed texts; and one row of prefix counts per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((depth, CLASSES), np.int64)
        shift = np.uint64(64 - CLASSES.bit_length() + 1)
        first = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(wordhash.gathered(batches, PIECE_BYTES)):
            ids = ids.fill_null(NONE).to_numpy(zero_copy_only=False)
            for level, value in enumerate(Piece(ids, texts, depth).prefixes()):
                counts[level] += np.bincount((value >> shift).astype(np.int64), minlength=CLASSES)
            yield message([packed(first + k, ids, texts)])
        yield message([(first, 9, 0, counts.astype("<i8").tobytes(), b"", b"")])

    return run


def _asked(piece: Piece, n: int):
    """Per task: the borders of its distinct windows and of the documents it is asked about (in order of ``by``)."""
    docs, keys = piece.copy_keys()
    to = seat_of(keys, n)
    by = np.argsort(to, kind="stable")
    seats = np.arange(n + 1)
    return np.searchsorted(seat_of(piece.distinct, n), seats), np.searchsorted(to[by], seats), docs[by], keys[by]


def _ask(depth: int, n: int):
    """Pieces -> for each task the low bits of windows, and keys and ids of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ids, lengths, blob in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                piece = Piece(*unpacked(ids, lengths, blob), depth)
                piece.windows()
                low = (piece.distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
                w, d, docs, keys = _asked(piece, n)
                rows = [(name, 1, s, low[w[s] : w[s + 1]].tobytes(), keys[d[s] : d[s + 1]].astype("<u8").tobytes(),
                         piece.ids[docs[d[s] : d[s + 1]]].astype("<i8").tobytes())
                        for s in range(n) if w[s] < w[s + 1] or d[s] < d[s + 1]]
                if rows:
                    yield message(rows)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one task was asked -> per piece: which windows another piece has, which documents have an earlier copy."""
    names, low, keys, ids = [], [], [], []
    for batch in batches:
        for name, seat, a, b, c in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
            # several seats may meet in one partition
            low.append(np.frombuffer(a, "<u4").astype(np.uint64) | np.uint64(seat) << np.uint64(32))
            keys.append(np.frombuffer(b, "<u8"))
            ids.append(np.frombuffer(c, "<i8"))
            names.append((name, seat))
    if not names:
        return
    ends, copy_ends = np.cumsum([len(x) for x in low]), np.cumsum([len(x) for x in keys])
    windows = np.concatenate(low)
    low.clear()
    order = np.argsort(windows)
    windows = windows[order]
    same = windows[1:] == windows[:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.lexsort((ids, keys))
    first = np.ones(len(keys), bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    copy = np.zeros(len(keys), bool)
    if len(keys):
        copy[order] = ids[order] > np.repeat(ids[order][first], np.diff(np.append(np.flatnonzero(first), len(keys))))
    for (name, seat), end, w, copy_end, d in zip(names, ends, np.diff(ends, prepend=0), copy_ends, np.diff(copy_ends, prepend=0)):
        yield message([(name, 1, seat, bits(again[end - w : end]), bits(copy[copy_end - d : copy_end]), b"")])


def _copies(piece: Piece, replies: list[tuple], n: int) -> np.ndarray:
    """Flags of the documents that have an earlier copy."""
    docs_of = _asked(piece, n)
    copy = np.zeros(len(piece.ids), bool)
    for kind, seat, _, flags, _ in replies:
        if kind == 1:
            docs = docs_of[2][docs_of[1][seat] : docs_of[1][seat + 1]]
            copy[docs] = unbits(flags, len(docs))
    return copy


def _suffixes(depth: int, n: int, lengths_of):
    """Pieces with answers -> for each task its suffixes: 16 bits of every word, the window's hash, the smallest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer = lengths_of.value  # per length and class: is the prefix too frequent for a group?
        shift = np.uint64(64 - CLASSES.bit_length() + 1)
        for name, cells, replies in with_replies(batches):
            piece = Piece(*unpacked(*cells), depth)
            piece.windows()
            borders = _asked(piece, n)[0]
            again = np.zeros(len(piece.distinct), bool)
            for kind, seat, flags, _, _ in replies:
                if kind == 1:
                    part = slice(borders[seat], borders[seat + 1])
                    again[part] = unbits(flags, borders[seat + 1] - borders[seat])
            own = ~_copies(piece, replies, n)[piece.doc]  # a copy's windows are its first one's
            mine = np.zeros(len(piece.distinct), bool)
            mine[piece.number[own]] = True
            chosen = np.flatnonzero(again & mine)
            if not len(chosen):
                continue
            example = piece.example[chosen]
            group = np.zeros(len(chosen), np.uint64)
            open_ = np.ones(len(chosen), bool)
            for level, value in enumerate(piece.prefixes()):
                value = value[example]
                bucket = value >> shift
                last = level == depth - 1
                ends = open_ & (last | ~longer[level][bucket.astype(np.int64)])
                group[ends] = wordhash.mix((value if last else bucket * np.uint64(16) + np.uint64(level))[ends])
                open_ &= ~ends
            symbols = np.stack([(piece.hashes[piece.at[example] + k] >> np.uint64(48)).astype(">u2") for k in range(depth)], axis=1)
            to = seat_of(group, n)
            order = np.lexsort((*(symbols[:, k] for k in range(3, -1, -1)), to))
            cuts = np.searchsorted(to[order], np.arange(n + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[s] : cuts[s + 1]]
                rows.append((name, 2, s, planes(symbols[part]), planes(piece.distinct[chosen[part]].astype("<u8")),
                             planes(piece.least[chosen[part]].astype("<i8"))))
            yield message(rows)

    return run


def deep_nodes(symbols: np.ndarray, whole: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves in the order of the tree, and the first leaf of every inner node of full depth (as flags of the leaves).

    symbols: one row of ``depth`` words per suffix; whole: a hash that tells apart words with equal symbols.
    """
    order = np.lexsort((whole, *(symbols[:, k] for k in range(depth - 1, -1, -1))))
    unlike = symbols[order[1:]] != symbols[order[:-1]]
    shared = np.where(unlike.any(axis=1), np.argmax(unlike, axis=1), depth)  # words that neighbours have in common
    new = np.ones(len(order), bool)
    new[1:] = (shared < depth) | (whole[order[1:]] != whole[order[:-1]])
    return order, new


def _trees(depth: int):
    """One task's suffixes -> per piece the hashes of windows that begin in a document with a smaller doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, symbols, whole, least = [], [], [], []
        for batch in batches:
            for name, a, b, c in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                flat = np.frombuffer(a, np.uint8).reshape(2 * depth, -1)
                symbols.append(np.ascontiguousarray(flat.T).view(">u2").astype(np.uint16))
                whole.append(unplanes(b, "<u8"))
                least.append(unplanes(c, "<i8"))
                names.append(name)
        if not names:
            return
        sizes = [len(x) for x in whole]
        symbols, whole, least = map(np.concatenate, (symbols, whole, least))
        order, new = deep_nodes(symbols, whole, depth)
        first = np.flatnonzero(new)
        of_node = np.minimum.reduceat(least[order], first)
        smaller = np.empty(len(order), bool)
        smaller[order] = np.repeat(of_node, np.diff(np.append(first, len(order)))) < least[order]
        end = 0
        for name, size in zip(names, sizes):
            part = slice(end, end + size)
            end += size
            if smaller[part].any():
                yield message([(name, 2, 0, whole[part][smaller[part]].astype("<u8").tobytes(), b"", b"")])

    return run


def _joined(piece: Piece, kept: np.ndarray) -> pa.Array:
    """The kept words of every text with one space between them."""
    data, offsets = wordhash.string_bytes(piece.texts)
    starts, ends = wordhash.runs(data, offsets) if len(data) else (np.empty(0, np.int64),) * 2
    owner = np.repeat(np.arange(len(piece.ids)), piece.n_words)[kept]
    starts, ends = starts[kept], ends[kept]
    size = ends - starts + 1
    final = np.ones(len(owner), bool)
    final[:-1] = owner[1:] != owner[:-1]
    size[final] -= 1
    after = np.cumsum(size)
    take = np.arange(after[-1] if len(after) else 0) + np.repeat(starts - (after - size), size)
    out = data[np.minimum(take, len(data) - 1)] if len(take) else np.empty(0, np.uint8)
    out[after[~final] - 1] = 32
    sizes = np.bincount(owner, weights=size, minlength=len(piece.ids)).astype(np.int64)
    borders = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    return pa.LargeStringArray.from_buffers(len(piece.ids), pa.py_buffer(borders.tobytes()), pa.py_buffer(out.tobytes()))


def _kept(depth: int, n: int):
    """Pieces with all replies -> documents without the words of covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cells, replies in with_replies(batches):
            piece = Piece(*unpacked(*cells), depth)
            piece.windows()
            covered = piece.ids[piece.doc] > piece.least[piece.number] if len(piece.at) else np.zeros(0, bool)
            outside = [np.frombuffer(a, "<u8") for kind, _, a, _, _ in replies if kind == 2]
            if outside:
                flags = np.zeros(len(piece.distinct), bool)
                flags[np.searchsorted(piece.distinct, np.concatenate(outside))] = True
                covered |= flags[piece.number]
            covered |= _copies(piece, replies, n)[piece.doc]
            edges = np.zeros(len(piece.hashes) + 1, np.int64)
            edges += np.bincount(piece.at[covered], minlength=len(edges)) - np.bincount(piece.at[covered] + depth, minlength=len(edges))
            kept = np.cumsum(edges[:-1]) == 0
            owner = np.repeat(np.arange(len(piece.ids)), piece.n_words)
            removed = np.bincount(owner[~kept], minlength=len(piece.ids))
            columns = [pa.array(piece.ids, mask=piece.ids == NONE), pa.array(piece.n_words), pa.array(removed),
                       _joined(piece, kept).cast(pa.string())]
            for at, texts in wordhash.slices(columns[3]):
                yield pa.RecordBatch.from_arrays([c.slice(at, len(texts)) for c in columns], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _too_frequent(counted: DataFrame, depth: int, n: int) -> np.ndarray:
    """Flags (length, class): more suffixes than a group's share begin with a prefix of that class."""
    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(depth * CLASSES, np.int64)
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                total += np.frombuffer(counts, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["prefix", "n"])

    sums = counted.select("a").mapInArrow(per_task, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(depth * CLASSES, np.int64)
    table[sums["prefix"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    table = table.reshape(depth, CLASSES)
    return table > max(1, int(table[0].sum()) // (GROUPS * n))


def without_repeats(docs: DataFrame, depth: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document's words that no repeated passage covers, one space between them."""
    spark = docs.sparkSession
    n = common.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = common.stage(rows.mapInArrow(_pieces(depth), MESSAGE), "pieces")
    pieces = written.where("kind = 0")
    longer = spark.sparkContext.broadcast(_too_frequent(written.where("kind = 9"), depth, n))
    asked = pieces.mapInArrow(_ask(depth, n), MESSAGE).repartitionById(n, F.col("seat"))
    answers = common.stage(asked.mapInArrow(_answer, MESSAGE), "answers")

    sent = beside(pieces, answers).mapInArrow(_suffixes(depth, n, longer), MESSAGE).repartitionById(n, F.col("seat"))
    found = common.stage(sent.mapInArrow(_trees(depth), MESSAGE), "covered")
    copies = answers.withColumn("a", F.lit(b""))
    return beside(pieces, copies.unionByName(found)).mapInArrow(_kept(depth, n), "doc_id long, n_words long, n_removed long, kept string")
