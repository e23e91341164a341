"""Value counts for one or many searchable keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths

COLUMN_KEYS = {"ext": "ext", "mime": "mimeclass"}


def facet_values(files: DataFrame, file_meta: DataFrame, key: str, prefix: str = "", scope: str = "",
                 limit: int = 0, roots: Iterable[str] | None = None) -> DataFrame:
    """``(value, count)`` of one key, most frequent first, then by value.

    The prefix ignores case, the grouping does not. A ``limit`` above 0 keeps the first so many. Extension and media class come from the catalogue; name,
    size and mtime cannot be enumerated.
    """
    kept = files
    if scope:
        kept = kept.where(paths.within("dir", scope))
    if roots is not None:
        kept = kept.where(paths.within_any("path", roots))
    if "." in key:
        rows = file_meta.where(F.col("key") == key)
        if prefix:
            rows = rows.where(F.lower("value").startswith(prefix.lower()))
        rows = rows.join(kept.select("path"), "path").select("value")
    elif key in COLUMN_KEYS:
        rows = kept.select(F.col(COLUMN_KEYS[key]).alias("value")).where("value <> ''")
        if prefix:
            wanted = prefix.lower().removeprefix(".") if key == "ext" else prefix.lower()
            rows = rows.where(F.lower("value").startswith(wanted))
    else:
        raise ValueError(f"values of {key} cannot be enumerated")
    counted = rows.groupBy("value").agg(F.count("*").alias("count"))
    ordered = counted.orderBy(F.desc("count"), F.asc("value"))
    return ordered.limit(limit) if limit > 0 else ordered


def facet_values_all(files: DataFrame, file_meta: DataFrame, limit: int = 0) -> DataFrame:
    """``(key, value, count)`` of every enumerable key at once; a ``limit`` above 0 keeps the top values of each.

    Counting happens before ranking, so a key shared by all files is a few rows by then.
    """
    stacked = files.select(F.explode(F.array(
        F.struct(F.lit("ext").alias("key"), F.col("ext").alias("value")),
        F.struct(F.lit("mime").alias("key"), F.col("mimeclass").alias("value")))).alias("p")).select("p.*").where("value <> ''")
    embedded = file_meta.join(files.select("path"), "path", "left_semi").select("key", "value")
    counted = stacked.unionByName(embedded).groupBy("key", "value").agg(F.count("*").alias("count"))
    if limit <= 0:
        return counted
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("count"), F.asc("value")))
    return counted.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def index_fresh(status: DataFrame) -> DataFrame:
    """Whether the latest status of each index is idle after at least one full scan."""
    latest = status.groupBy("index_id").agg(
        F.max_by(F.struct("state", "last_full_scan"), F.struct("ts", "seq")).alias("s")
    )
    return latest.select("index_id", ((F.col("s.state") == "idle") & (F.col("s.last_full_scan") > 0)).alias("fresh"))
