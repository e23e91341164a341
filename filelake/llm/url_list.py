"""Pages judged by a list of canonical URLs (blocked Bloom filter, then an exact join) and by host and path rules.

A filter block has 256 bits in eight lanes of 32; a URL's 64-bit hash picks one block and one bit in each lane, so a
lookup touches one cache line. The filter has ``BITS`` bits per listed URL up to ``MOST_BLOCKS`` blocks (64 MB), which
bounds what is broadcast; a longer list only lets more pages through to the exact join, which decides every one.

A null URL, or one without ``://``, has an empty host and path and the empty canonical form, which is never listed.
Repeated rows are kept; an empty list lists nothing; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.llm import common

BITS = 16
MOST_BLOCKS = 1 << 21
SALTS = 16  # seats over which the rows of one listed URL are spread in the exact join

# Odd multipliers that choose the bit of each lane.
LANES = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without a leading www. and path without trailing slashes and .html; scheme, query and fragment go."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/+|\.html)$", "")
    return F.when(host == "", "").otherwise(F.concat(host, path))


def masks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, four 64-bit words with one bit in each 32-bit half) of each hash."""
    h = hashes.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    words = np.zeros((len(h), 4), np.uint64)
    for k, lane in enumerate(LANES):
        bit = ((low * np.uint64(lane)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        words[:, k // 2] |= np.uint64(1) << (bit + np.uint64(32 * (k % 2)))
    return block.astype(np.int64), words


def blocks_for(n: int, most: int) -> int:
    """Blocks that give each of n keys ``BITS`` bits, but at most ``most``."""
    return min(most, max(1, math.ceil(n * BITS / 256)))


def filter_of(hashes: DataFrame, blocks: int) -> np.ndarray:
    """The filter of the 64-bit hashes in the only column: blocks x 4 words.

    Hashes go to the task that has their stretch of blocks, as they are; each task hands its stretch to the driver, which
    gets the filter's bytes, whatever the rows.
    """
    name = hashes.columns[0]
    n = min(blocks, common.partitions(hashes.sparkSession))
    block = F.shiftright(F.shiftrightunsigned(name, 32) * F.lit(blocks), 32)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at, words = masks(batch.column(0).to_numpy().view(np.uint64), blocks)
            seats = at * n // blocks
            for seat in np.unique(seats).tolist():
                first, end = (-(-s * blocks // n) for s in (seat, seat + 1))
                here = seats == seat
                np.bitwise_or.at(made.setdefault(seat, np.zeros((end - first, 4), np.uint64)), at[here] - first, words[here])
        for seat, stretch in made.items():
            yield pa.RecordBatch.from_pydict({"first": pa.array([-(-seat * blocks // n)]), "words": pa.array([stretch.tobytes()])})

    placed = hashes.repartitionById(n, F.floor(block * F.lit(n) / F.lit(blocks)).cast("int"))
    table = np.zeros((blocks, 4), np.uint64)
    for row in placed.mapInArrow(part, "first long, words binary").collect():
        stretch = np.frombuffer(bytes(row["words"]), np.uint64).reshape(-1, 4)
        table[row["first"] : row["first"] + len(stretch)] |= stretch
    return table


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass."""
    block, words = masks(hashes, len(table))
    return ((table[block] & words) == words).all(axis=1)


def build_filter(listed: DataFrame) -> np.ndarray:
    """The filter of ``listed.key`` (canonical URLs)."""
    return filter_of(listed.select(F.xxhash64("key").alias("hash")), blocks_for(listed.count(), MOST_BLOCKS))


def is_listed(pages: DataFrame, listed: DataFrame, key: str = "canonical", out: str = "listed") -> DataFrame:
    """``pages`` with a boolean column: whether ``pages[key]``, of any type, is among the distinct ``listed.key``.

    Pages that the filter turns away are decided there; only the others meet the list in a join by hash, in which a
    URL's pages are spread over ``SALTS`` seats. ``out`` must be a new name; no other name can clash.
    """
    spark = pages.sparkSession
    listed = listed.where(F.col("key").isNotNull()).select("key").distinct()
    shared = spark.sparkContext.broadcast(build_filter(listed))

    @F.pandas_udf("boolean")
    def possible(hashes: pd.Series) -> pd.Series:
        return pd.Series(has(shared.value, hashes.to_numpy(np.int64).view(np.uint64)))

    seen = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(key).alias("key"))
    seen = seen.withColumn("possible", possible(F.xxhash64("key")))
    no = seen.where(~F.col("possible")).select("row.*", F.lit(False).alias(out))
    maybe = seen.where("possible").withColumn("seat", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    seats = listed.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("seat"), F.lit(True).alias("found"))
    hits = maybe.join(seats, ["key", "seat"], "left")
    return no.unionByName(hits.select("row.*", F.coalesce("found", F.lit(False)).alias(out)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits; nulls where none does. rules: (rule, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's verdict, else block for listed pages and allow for others."""
    url = F.col("url")
    found = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return is_listed(found, listed.where(F.col("key") != "")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))
