"""Pieces: consecutive texts packed into one row, and the binary messages between pieces and tasks.

A piece is written once, so whatever is asked about it later meets the same texts in the same order. Messages have one
form: the piece, a kind (0: the piece itself), the task asked, and three binary cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from filelake.llm import wordhash

NONE = -(1 << 63)  # in place of a null doc_id
MESSAGE = "piece long, kind int, seat int, a binary, b binary, c binary"
NAMES = ["piece", "kind", "seat", "a", "b", "c"]


def message(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], NAMES)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width values byte by byte of equal weight, which compresses better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def seat_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def packed(name: int, ids: np.ndarray, texts: pa.Array) -> tuple:
    """The row of a piece: ids, lengths and compressed texts."""
    data, offsets = wordhash.string_bytes(texts)
    return name, 0, 0, ids.astype("<i8").tobytes(), np.diff(offsets).astype("<i8").tobytes(), zstandard.ZstdCompressor(3).compress(data.tobytes())


def unpacked(ids: bytes, lengths: bytes, blob: bytes) -> tuple[np.ndarray, pa.Array]:
    """(ids, texts) of a piece."""
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, "<i8"))]).astype("<i8")
    data = zstandard.ZstdDecompressor().decompress(blob) if offsets[-1] else b""
    return np.frombuffer(ids, "<i8"), pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def beside(pieces: DataFrame, replies: DataFrame) -> DataFrame:
    """Every piece directly followed by what came back for it."""
    return pieces.unionByName(replies).repartition("piece").sortWithinPartitions("piece", "kind", "seat")


def with_replies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple, list[tuple]]]:
    """Rows in order of piece and kind -> (name, the piece's three cells, its replies)."""
    now, cells, replies = None, None, []
    for batch in batches:
        for name, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if cells:
                    yield now, cells, replies
                now, cells, replies = name, row[1:], []
            else:
                replies.append((kind, *row))
    if cells:
        yield now, cells, replies
