"""Status feeds as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUS = "index_id long, ts timestamp, seq long, state string, progress double, last_full_scan long"


def read_status(spark: SparkSession, folder: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """Streaming status rows from a folder that writers append files to."""
    return spark.readStream.schema(STATUS).format(fmt).option("maxFilesPerTrigger", max_files).load(folder)
