"""Token ids of documents as files of Simple-8b blocks, written by Spark in ascending document order.

A row of the written table is one block: ``part`` and ``block`` (the order of blocks), ``id_start`` and ``word_start``
(ids and words of the part before it), the ``doc_ids`` it holds and where each starts in it (``doc_starts``), ``n_ids``,
and the packed ``words`` as little-endian bytes. A block ends with the document that fills it, so every block decodes
by itself and blocks can be read by any number of tasks. Spark's committer makes the files whole or absent.

Nulls: a null text is an empty one, a null doc_id sorts first. Repeated doc_ids keep all their rows, ordered by text.
An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm import common, simple8b, wordhash
from filelake.llm.encoding import encoder

BLOCK_IDS = 1 << 16  # a block is closed by the document that reaches this many ids

BLOCK_SCHEMA = ("part int, block int, id_start long, word_start long, n_ids long, doc_ids array<long>, "
                "doc_starts array<long>, words binary")
INDEX_SCHEMA = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _blocks(path: str, end_id: int):
    """Rows (part_, doc_id, text) sorted by part and document -> rows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        part, block, id_start, word_start = None, 0, 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, id_start, word_start, docs, ids, held
            flat = np.concatenate(ids)
            sizes = np.array([len(x) for x in ids])
            words = simple8b.encode(flat)
            row = {"part": part, "block": block, "id_start": id_start, "word_start": word_start, "n_ids": len(flat),
                   "doc_ids": docs, "doc_starts": (np.cumsum(sizes) - sizes).tolist(),
                   "words": words.astype("<u8").tobytes()}
            block, id_start, word_start = block + 1, id_start + len(flat), word_start + len(words)
            docs, ids, held = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCK)

        for batch in batches:
            parts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, texts in wordhash.slices(batch.column(2)):
                flat, offsets = bpe.encode(texts)
                for k in range(len(texts)):
                    if parts[at + k] != part:
                        if docs:
                            yield close()
                        part, block, id_start, word_start = parts[at + k], 0, 0, 0
                    own = np.append(flat[offsets[k] : offsets[k + 1]], np.uint32(end_id))
                    docs.append(keys[at + k])
                    ids.append(own)
                    held += len(own)
                    if held >= BLOCK_IDS:
                        yield close()
        if docs:
            yield close()

    return run


_ARROW_BLOCK = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("id_start", pa.int64()), ("word_start", pa.int64()),
    ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
    ("words", pa.binary()),
])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode ``text``, append ``end_id`` to each document and write the blocks to ``path``, ordered by ``doc_id``."""
    n = common.partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = common.dealt(rows, common.ordered_part(rows, "doc_id", n), n, ["doc_id", "text"])
    rows.select("part_", "doc_id", "text").mapInArrow(_blocks(tokenizer, end_id), BLOCK_SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def unpack(row: dict) -> np.ndarray:
    """The ids of one block."""
    return simple8b.decode(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype(np.uint32)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row).astype("<u4")
            starts = np.array([*row["doc_starts"], row["n_ids"]])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(starts) - 1, row["part"], np.int32)),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array(row["id_start"] + starts[:-1]),
                "n_tokens": pa.array(np.diff(starts)),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, starts[1:])], pa.int64()),
            })


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the written blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = read_blocks(spark, path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = common.part_starts(totals, "part", "n")
    rows = blocks.mapInArrow(_index, INDEX_SCHEMA)
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("start") + F.col("start_")).alias("start"), "n_tokens", "ids_crc32")
