"""Spelling variants: which words of a corpus differ by one inserted, deleted or replaced code point, and which word of
them is so much more frequent that it is taken for the right form.

1. **Vocabulary.** Words of all texts are counted (map-side first) and written once; the rest works on distinct words.
2. **Groups.** Two words, the longer of ``m`` code points, are near exactly if common prefix and common suffix together
   reach ``m - 1``. With ``c = m - 1`` and ``a = 2c div 3`` then the prefix reaches ``a``, or the suffix does, or both
   reach ``c - a + 1``. So words meet in groups of equal (m, first a), (m, last a) or (m, first and last c - a + 1) code
   points, and each near pair counts in the first of the three that holds it.
3. **Dense tiling.** A group's words are rows of a matrix of padded code points. Blocks of it are compared pair by pair,
   all rows with all rows, from the left and from the right; prefix plus suffix decides. A group of more than ``BLOCK``
   words is dealt by block pairs to several tasks.
4. **Forms.** Near words are summed per word. Forms are followed to their last by pointer doubling: every step multiplies
   n by ``ratio``, so a chain has at most log(n) links.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty string in the hash; a repeated row
is counted again; ties of n go to the first word in code-point order; an empty table gives no rows; long runs are whole
words; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.llm import common

BLOCK = 4096  # words of a group that meet in one task
TILE = 256  # rows of a matrix block
CELLS = 1 << 24  # cells of a matrix held at once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^A-Za-zÀ-ÿ]+"


def words_of(text: Column, least: int = 0) -> Column:
    """Maximal runs of letters up to U+00FF with at least ``least`` code points, only A-Z lower-cased."""
    runs = F.filter(F.split(text, NOT_WORD), lambda w: F.length(w) >= max(1, least))
    return F.transform(runs, lambda w: F.translate(w, UPPER, LOWER))


def planted(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, or without one code point where ``every`` divides its hash with the document's id."""
    hashed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(hashed, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(hashed, F.lit(every)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = 7, at_least: int = 2) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) after the planted deletions, written and read back."""
    runs = docs.select("doc_id", F.explode(words_of(F.col("text"), shortest)).alias("run"))
    words = runs.select(planted(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return common.stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least), "words")


def groups(words: DataFrame) -> DataFrame:
    """(m, kind, key, word, n): where each word meets others, as the longer word or as the shorter."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"))
    c = F.col("m") - 1
    a = F.floor(2 * c / 3).cast("int")
    b = (c - a + 1).cast("int")
    word = F.col("word")
    ends = lambda k: F.substring(word, -k, k)
    keys = F.array(
        F.struct(F.lit(0).alias("kind"), F.substring(word, F.lit(1), a).alias("key")),
        F.struct(F.lit(1).alias("kind"), ends(a).alias("key")),
        F.struct(F.lit(2).alias("kind"), F.concat(F.substring(word, F.lit(1), b), F.lit(" "), ends(b)).alias("key")))
    rows = rows.select("word", "n", "m", F.explode(keys).alias("k"))
    return rows.select("m", "k.kind", F.xxhash64("m", "k.kind", "k.key").alias("key"), "word", "n")


def seated(rows: DataFrame) -> DataFrame:
    """Rows with their block and, in groups of several blocks, once for every pair of blocks they take part in."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BLOCK)
    sizes = common.stage(sizes.select("key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")), "large")
    if not sizes.head(1):
        return rows.select("*", F.lit(0).alias("side"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows = rows.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("m", "kind", "key", "word", "n", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))


class Matrix:
    """Words as rows of code points, from the left and from the right, padded with 0. All are below U+0100."""

    def __init__(self, words: list[str]) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in coded])
        width = int(self.size.max()) + 1
        flat = np.frombuffer(b"".join(coded), np.uint8)
        row = np.repeat(np.arange(len(coded)), self.size)
        start = np.cumsum(self.size) - self.size
        column = np.arange(len(flat)) - np.repeat(start, self.size)
        self.left, self.right = np.zeros((len(coded), width), np.uint8), np.zeros((len(coded), width), np.uint8)
        self.left[row, column] = flat
        self.right[row, np.repeat(self.size, self.size) - 1 - column] = flat

    def meet(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Common prefix and common suffix of rows x with rows y (shapes that broadcast); equal rows do not occur."""
        return tuple(np.argmax(side[x] != side[y], axis=-1) for side in (self.left, self.right))


def near_pairs(words: list[str], m: np.ndarray, kind: np.ndarray, key: np.ndarray, side: np.ndarray, across: np.ndarray):
    """Index pairs (x, y) of near words in runs of equal key that count there. across: only rows of two sides meet."""
    matrix = Matrix(words)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def decide(x: np.ndarray, y: np.ndarray) -> None:
        x, y = np.broadcast_arrays(x, y)
        if x.ndim == 1:
            prefix, suffix = matrix.meet(x, y)
        else:
            prefix, suffix = (np.argmax(s[x[:, :1]] != s[y[:1]], axis=-1) for s in (matrix.left, matrix.right))
        longer = np.maximum(matrix.size[x], matrix.size[y])
        c = m[x] - 1
        a = 2 * c // 3
        near = (longer == m[x]) & (prefix + suffix >= c) & (x < y) & ~(across[x] & (side[x] == side[y]))
        near &= (kind[x] == 0) & (prefix >= a) | (prefix < a) & ((kind[x] == 1) & (suffix >= a) | (kind[x] == 2) & (suffix < a))
        found.append((x[near], y[near]))

    small = (sizes > 1) & (sizes <= 32)
    lead = np.repeat(starts[small], sizes[small])  # of each row of a small group
    rows = lead + np.arange(len(lead)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
    ends = np.repeat(starts[small] + sizes[small], sizes[small])
    step, most = 1, max(1, CELLS // (matrix.left.shape[1] * 8))
    while len(rows):
        rows, ends = rows[rows + step < ends], ends[rows + step < ends]
        for k in range(0, len(rows), most):
            decide(rows[k : k + most], rows[k : k + most] + step)
        step += 1
    tile = max(1, min(TILE, int((CELLS / matrix.left.shape[1]) ** 0.5)))
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        for p in range(start, start + size, tile):
            for q in range(p, start + size, tile):
                decide(np.arange(p, min(p + tile, start + size))[:, None], np.arange(q, min(q + tile, start + size))[None, :])
    return tuple(np.concatenate(side) for side in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, kind, word, n, side, i, j) in order of (m, key, i, j) -> (word, near, n of near), both ways."""
    held: list[list] = [[] for _ in range(8)]
    task = None

    def close() -> Iterator[pa.RecordBatch]:
        key, m, kind, words, n, side, i, j = held
        if len(words) > 1:
            # block pairs of one group are runs of their own
            key = np.cumsum(np.array([True, *(x != y for x, y in zip(zip(key, i, j), zip(key[1:], i[1:], j[1:])))]))
            x, y = near_pairs(words, np.array(m), np.array(kind), key, np.array(side), np.array(i) != np.array(j))
            if len(x):
                words, n = np.array(words, object), np.array(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(words[x], words[y]), pa.string()), pa.array(np.append(words[y], words[x]), pa.string()),
                     pa.array(np.append(n[y], n[x]))], ["word", "near", "near_n"])
        for c in held:
            c.clear()

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        tasks = list(zip(columns[0], columns[6], columns[7]))
        at = 0
        for k in range(len(tasks)):
            if tasks[k] != task:
                # the rows so far are whole groups
                if len(held[0]) + k - at and (len(held[0]) + k - at) * (columns[1][k] + 1) > CELLS // 16:
                    for c, column in zip(held, columns):
                        c.extend(column[at:k])
                    at = k
                    yield from close()
                task = tasks[k]
        for c, column in zip(held, columns):
            c.extend(column[at:])
    yield from close()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of (word, n), once."""
    rows = seated(groups(words)).select("key", "m", "kind", "word", "n", "side", "i", "j")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("m", "key", "i", "j")
    return rows.mapInArrow(_tiles, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms from each word ends. forms: (word, form)."""
    now = common.stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(on, "root", "left")
        step = common.stage(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.where("moved").head(1):
            return now


def variants(docs: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = vocabulary(docs)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = words.join(near, "word", "left")
    right = -F.col("best.minus_n") >= ratio * F.col("n")
    rows = common.stage(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(right, F.col("best.form")).alias("form"),
        F.when(right, -F.col("best.minus_n")).alias("form_n")), "near")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
