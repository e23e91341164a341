"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from the model file:

- the **normaliser** writes a space before a text and every space as U+2581 (the model's own rules; models with other
  normalisation rules are refused rather than encoded wrongly);
- the **lexicon** is the trie of pieces, from characters to piece ids. A character that is no piece leaves it by the
  fallback: one arc per UTF-8 byte;
- the **order** acceptor lets piece ``b`` follow piece ``a`` at no cost if merging ``a + b`` by the model's scores stops at
  exactly these two pieces, and at infinite cost otherwise. A sequence of pieces is what merging by scores arrives at
  if and only if all its neighbours are such pairs, so this is how a merge model is a machine of bounded memory.

Composed with an input, states are (place, last piece); every piece costs one. The tropical shortest path, worked out
from left to right, is the encoding. Arcs of the order acceptor are worked out when first met and kept.

Texts are composed chunk by chunk: between two characters that are neighbours in no piece there is always a border, and
the path on one side does not depend on the other. Chunks repeat, so most paths come from a cache.

Defined cases: a null or empty text has no ids; an id outside the vocabulary raises ValueError; bytes that form no UTF-8
decode to U+FFFD; a U+2581 in a text decodes to a space. Repeated rows are answered each; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import wordhash
from filelake.llm.encoding import ChunkEncoder, encoder, ragged

SPACE = "▁"
NORMAL, BYTE = 1, 6  # kinds of pieces in the model file
MOST_ARCS = 1_000_000  # arcs of the order acceptor kept at a time


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer(ChunkEncoder):
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules, trained = model.normalizer_spec, model.trainer_spec
        if (rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces or not trained.byte_fallback or trained.model_type != 2):
            raise ValueError("needs a merge model with byte fallback and without rewriting rules")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for piece, k in self.ids.items():
            at = 0
            for c in piece:
                if c not in self.trie[at]:
                    self.trie[at][c] = len(self.trie)
                    self.trie.append({})
                    self.final.append(-1)
                at = self.trie[at][c]
            self.final[at] = k
        self.follows: dict[int, bool] = {}
        self.joined = self._joined()
        written = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() if p.type == NORMAL
                   else b"" for p in model.pieces]
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.written_lengths = np.array([len(w) for w in written])
        self.written_starts = np.cumsum(self.written_lengths) - self.written_lengths
        super().__init__()

    def _joined(self) -> np.ndarray:
        """Which two bytes stand side by side in some piece, or may lie within one character."""
        table = np.zeros((256, 256), bool)
        for piece in self.ids:
            raw = piece.replace(SPACE, " ").encode()
            for a, b in zip(raw, raw[1:]):
                table[a, b] = True
        table[:, 0x80:0xC0] = True
        table[:, 0xE2] = table[0x81, :] = True  # the sign of a space itself
        return table

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        start = np.zeros(len(data), bool)
        start[1:] = ~self.joined[data[:-1], data[1:]]
        start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(start)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Neighbours joined to pieces, always the ones with the best score, the leftmost first."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.scores.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _may_follow(self, a: int, b: int) -> bool:
        arc = a << 32 | b
        if arc not in self.follows:
            if len(self.follows) >= MOST_ARCS:
                self.follows.clear()
            left, right = self.pieces[a], self.pieces[b]
            self.follows[arc] = self._merged([*left, *right]) == [left, right]
        return self.follows[arc]

    def shortest_path(self, text: str) -> list[int]:
        """The ids of a normalised text."""
        n = len(text)
        # place -> last piece (-1: none or a byte) -> (cost, place before, piece before, ids written)
        states: list[dict[int, tuple[int, int, int, list[int]]]] = [{} for _ in range(n + 1)]
        states[0][-1] = (0, 0, -1, [])
        for at in range(n):
            here = states[at]
            if not here:
                continue
            if text[at] not in self.ids:
                cost, last = min((s[0], p) for p, s in here.items())
                out = [self.byte_ids[b] for b in text[at].encode()]
                old = states[at + 1].get(-1)
                if old is None or cost + len(out) < old[0]:
                    states[at + 1][-1] = (cost + len(out), at, last, out)
                continue
            node, to = 0, at
            while to < n and (node := self.trie[node].get(text[to], 0)):
                to += 1
                piece = self.final[node]
                if piece < 0:
                    continue
                for last, (cost, *_) in here.items():
                    if last < 0 or self._may_follow(last, piece):
                        old = states[to].get(piece)
                        if old is None or cost + 1 < old[0]:
                            states[to][piece] = (cost + 1, at, last, [piece])
        _, piece = min((s[0], p) for p, s in states[n].items())
        path, at = [], n
        while at:
            _, before, last, out = states[at][piece]
            path.append(out)
            at, piece = before, last
        return [k for out in reversed(path) for k in out]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        return [self.shortest_path(c.replace(" ", SPACE)) for c in chunks]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, n+1 offsets)."""
        return self.encode(pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.large_string()))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of the ids: bytes of all pieces, without the space in front."""
        if len(ids) and int(ids.max()) >= len(self.pieces):
            raise ValueError("an id is outside the vocabulary")
        lengths = self.written_lengths[ids]
        raw = self.written[ragged(self.written_starts[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b].decode(errors="replace") for a, b in zip(ends, ends[1:])]


SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, Transducer)
        for batch in batches:
            for at, texts in wordhash.slices(batch.column(1)):
                ids, offsets = machine.encode_texts(texts)
                back = machine.decode(ids, offsets)
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(texts)),
                    "n_pieces": pa.array(np.diff(offsets)),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets, offsets[1:])], pa.int64()),
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "round_trip": [a == b for a, b in zip(back, texts.to_pylist())],
                })

    return run


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of pieces, crc32 of the ids (little-endian, 32 bits), and what decoding them gives back."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_round_trip(model), SCHEMA)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path, Transducer)
        for batch in batches:
            for at, texts in wordhash.slices(batch.column(1)):
                ids, offsets = machine.encode_texts(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids(model), "doc_id long, ids array<int>")
