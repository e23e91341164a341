"""How fingerprints stand an edit: each document against its edited text and against the next document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm import common, imatch, wordhash

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next document, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(lexicon):
    """Rows (part_, doc_id, text, own), sorted; every part ends with a copy of the document that comes after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row seen: part, doc_id, text, own, fingerprint
        for batch in batches:
            for at, part in wordhash.slices(batch.column(2), 2 << 20):
                rows = batch.slice(at, len(part))
                prints = imatch.fingerprints(part, lexicon.value)
                now = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), part.to_pylist(),
                               rows.column(3).to_pylist(), prints))
                pairs = [(a, b) for a, b in zip([held, *now], now) if a is not None and a[0] == b[0] and a[3]]
                held = now[-1]
                if not pairs:
                    continue
                texts = [edited(a[2], b[2]) for a, b in pairs]
                after = imatch.fingerprints(pa.array(texts, pa.large_string()), lexicon.value)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([a[1] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in texts],
                    "fingerprint": [a[4] for a, _ in pairs],
                    "edited_fingerprint": after,
                    "near_edited": [imatch.likeness(a[4], e) for (a, _), e in zip(pairs, after)],
                    "near_next": [imatch.likeness(a[4], b[4]) for a, b in pairs],
                })

    return run


def against_edits(docs: DataFrame) -> DataFrame:
    """One row per document, over ranges of ascending doc_id that need no common task.

    The first document of each range is also sent to the range before it (the very first one to the last), so every
    range can pair its rows by itself. Null texts are empty; null doc_ids come first; rows with equal doc_id follow one
    another in the order of their texts. A lone document is followed by itself.
    """
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(imatch.build_lexicon(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key_", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = common.partitions(spark)
    part = common.ordered_part(rows, "key_", n)
    rows = rows.withColumn("part_", part)
    firsts = sorted((r.part_, r.key) for r in rows.groupBy("part_").agg(F.min("key_").alias("key")).collect())
    before = [(key, firsts[k - 1][0]) for k, (_, key) in enumerate(firsts)]  # one row per range
    before = spark.createDataFrame(before, "key_ long, to_ int")
    seats = F.array(F.struct("part_", F.lit(True).alias("own")))
    copied = F.array(F.struct("part_", F.lit(True).alias("own")), F.struct(F.col("to_").alias("part_"), F.lit(False).alias("own")))
    rows = rows.join(F.broadcast(before), "key_", "left")
    rows = rows.select("doc_id", "key_", "text", F.explode(F.when(F.col("to_").isNull(), seats).otherwise(copied)).alias("s"))
    rows = rows.select(F.col("s.part_").alias("part_"), "doc_id", "key_", "text", F.col("s.own").alias("own"))
    rows = rows.repartitionById(n, F.col("part_")).sortWithinPartitions("part_", F.desc("own"), "key_", "text")
    return rows.select("part_", "doc_id", "text", "own").mapInArrow(_compare(lexicon), SCHEMA)
