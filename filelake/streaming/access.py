"""Sessions in an access log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered

GAP_SECONDS = 600


def access_sessions(log: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Sessions of a streamed log ``(user_id, path, ts)``: ten idle minutes end one.

    Sessions are emitted when the watermark passes their end; later rows are dropped.
    """
    window = F.session_window("ts", f"{GAP_SECONDS} seconds")
    rows = log.withWatermark("ts", watermark) if log.isStreaming else log
    grouped = rows.groupBy("user_id", "path", window.alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", "path", F.col("w.start").alias("first"), F.col("w.end").alias("expires"), "n")


def access_sessions_batch(log: DataFrame) -> DataFrame:
    """The same on a table, cut into parts of equal depth so that one busy user is spread over many tasks."""
    rows = log.withColumn("t", F.unix_micros("ts"))
    found = ordered.sessions(rows, ["user_id", "path"], "t", "t", GAP_SECONDS * 1_000_000)
    return found.select(
        "user_id", "path", F.timestamp_micros("first").alias("first"),
        F.timestamp_micros(F.col("last") + GAP_SECONDS * 1_000_000).alias("expires"), "n")
