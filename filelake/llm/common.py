"""Staging and ordering shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.session import prepare, shared_dir


def ready(spark: SparkSession) -> None:
    """Python workers get this package, and few enough rows at a time that long texts fit beside one another."""
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut and no executor's loss undoes them."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_part(df: DataFrame, key: str, n: int) -> Column:
    """Which of n ascending ranges of an integer key a row lies in (a null key: the first).

    The bounds are approximate quantiles, at most n numbers, from one pass over that column. They are constants of the
    plan, so a task that is run again deals its rows the same way.
    """
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(key), shares or [0.5], 10_000).alias("b")).first().b
    bounds = sorted(set(found or []))
    if not bounds or n == 1:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(key))), F.lit(0)).cast("int")


def dealt(df: DataFrame, part: Column, n: int, order: list[str]) -> DataFrame:
    """Rows of one part together in one task, in ascending order there. Adds the column ``part_``."""
    return df.withColumn("part_", part).repartitionById(n, F.col("part_")).sortWithinPartitions("part_", *order)


def part_starts(totals: DataFrame, part: str, total: str) -> DataFrame:
    """Exclusive running sums over the parts. There is one row per part, so as many as shuffle partitions at most."""
    rows = sorted((r[part], r[total]) for r in totals.select(part, total).collect())
    out, at = [], 0
    for k, n in rows:
        out.append((k, at))
        at += n
    return totals.sparkSession.createDataFrame(out, f"{part} int, start_ long")


def fresh(columns: list[str]) -> str:
    """A column name that is not taken."""
    name = "mark"
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bitmap(df: DataFrame, bit: str, size: int) -> bytes:
    """A bitmap of ``size`` bits with the bits in the long column ``bit`` set; size / 8 bytes whatever the rows."""
    words = df.groupBy(F.expr(f"{bit} div 64").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(size // 64, "<i8")
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.tobytes()


def has_bit(bits: bytes, at: np.ndarray) -> np.ndarray:
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
