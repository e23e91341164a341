"""Looking back along an ordered key without ever sorting one key's whole history in one task.

Rows are put in order of (key, value, tie) over range parts of equal depth and written once, so a part keeps its rows when a
task runs again. Windows run inside a part, whose rows may be of many keys or all of one. What a part needs from earlier
ones is one row: only the key it begins with can have rows before it, and of an earlier part only the key it ends with can
have rows after it. That is one row per part, whatever the data hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

PART = "_part"


def in_parts(df: DataFrame, by: Sequence[str], on: str, tie: str, parts: int | None = None) -> DataFrame:
    """The rows with the number of their part; ``parts`` is by default that of shuffle partitions."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.repartitionByRange(n, *by, on, tie).withColumn(PART, F.spark_partition_id()), "ordered")


def _with_carry(local: DataFrame, cut: DataFrame, by: Sequence[str], on: str, tie: str, value: str, alias: str) -> DataFrame:
    """``alias`` from ``_local``, or where that is NULL the last non-NULL ``value`` of the key in earlier parts."""
    key, order = F.struct(*by), F.struct(on, tie)
    held = F.struct(key.alias("k"), F.col(value).isNotNull().alias("set"), order.alias("o"))
    ends = cut.groupBy(PART).agg(F.min(key).alias("_first"), F.max_by(F.struct(key.alias("k"), F.col(value).alias("v")), held).alias("_held"))
    # A part between two of one key holds that key only, so what was set last before a part is of the key it begins with, or
    # there is nothing for it.
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # one row per part
    carry = F.last(F.when(F.col("_held.v").isNotNull(), F.col("_held")), ignorenulls=True).over(before)
    carried = ends.select(F.col(PART), F.col("_first"), carry.alias("_carry")).where("_carry.k <=> _first").drop("_first")
    late = F.when(F.col("_carry.k").eqNullSafe(key), F.col("_carry.v"))
    return local.join(carried, PART, "left").withColumn(alias, F.coalesce("_local", late)).drop("_local", "_carry")


def _previous(cut: DataFrame, by: Sequence[str], on: str, tie: str, value: str, alias: str) -> DataFrame:
    boxed = cut.withColumn("_box", F.struct(F.col(value).alias("x")))  # a row that is there is told from a NULL in it
    local = boxed.withColumn("_local", F.lag("_box").over(W.partitionBy(PART, *by).orderBy(on, tie)))
    return _with_carry(local, boxed, by, on, tie, "_box", alias).withColumn(alias, F.col(f"{alias}.x")).drop("_box")


def _last_known(cut: DataFrame, by: Sequence[str], on: str, tie: str, value: str, alias: str) -> DataFrame:
    w = W.partitionBy(PART, *by).orderBy(on, tie).rowsBetween(W.unboundedPreceding, 0)
    return _with_carry(cut.withColumn("_local", F.last(value, ignorenulls=True).over(w)), cut, by, on, tie, value, alias)


def previous(df: DataFrame, by: Sequence[str], on: str, tie: str, value: str, alias: str, parts: int | None = None) -> DataFrame:
    """Adds the ``value`` of the row before, per key, in order of ``on`` then ``tie``."""
    return _previous(in_parts(df, by, on, tie, parts), by, on, tie, value, alias).drop(PART)


def last_known(df: DataFrame, by: Sequence[str], on: str, tie: str, value: str, alias: str, parts: int | None = None) -> DataFrame:
    """Adds the latest non-NULL ``value`` up to and including each row."""
    return _last_known(in_parts(df, by, on, tie, parts), by, on, tie, value, alias).drop(PART)


def asof_last(points: DataFrame, boundaries: DataFrame, by: Sequence[str], on: str, value: str, parts: int | None = None) -> DataFrame:
    """For each boundary the latest point at or before it, per key: boundary rows plus ``point_<on>, <value>``.

    Both sides are stacked and the last point is carried forward; at equal times points come before boundaries.
    """
    p = points.select(*by, on, F.lit(0).alias("_side"), F.struct(F.col(on).alias("t"), F.col(value).alias("v")).alias("_point"))
    b = boundaries.withColumn("_side", F.lit(1))
    filled = last_known(p.unionByName(b, allowMissingColumns=True), by, on, "_side", "_point", "_hit", parts)
    return filled.where("_side = 1").select(
        *boundaries.columns, F.col("_hit.t").alias(f"point_{on}"), F.col("_hit.v").alias(value)
    )


def sessions(df: DataFrame, by: Sequence[str], on: str, tie: str, gap: float, parts: int | None = None) -> DataFrame:
    """Runs of rows no further apart than ``gap``: ``by, first, last, n``."""
    prev = _previous(in_parts(df, by, on, tie, parts), by, on, tie, on, "_prev")
    starts = prev.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col(on) - F.col("_prev") > gap), F.col(on)))
    owned = _last_known(starts, by, on, tie, "_start", "first")
    return owned.groupBy(*by, "first").agg(F.max(on).alias("last"), F.count("*").alias("n"))
