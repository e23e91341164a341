"""Snapshots bucketed and sorted by path, so that joins of a snapshot with a new listing move the listing only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _name() -> str:
    return f"filelake_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "path") -> None:
    """One sorted file per bucket under ``path``. Take as many buckets as tasks are wanted in the joins to come; Spark
    shuffles both sides of a join if they are far fewer than ``spark.sql.shuffle.partitions``."""
    name = _name()
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the entry only: the files belong to the folder


def read_bucketed(spark: SparkSession, path: str, schema: StructType, buckets: int, key: str = "path") -> DataFrame:
    """The rows of ``write_bucketed``, known to Spark as bucketed. Needs no catalogue entry of an earlier session."""
    return spark.table(create_table(spark, path, schema.toDDL(), buckets, key, (key,)))


def create_table(spark: SparkSession, path: str, ddl: str, buckets: int, key: str, order: Sequence[str]) -> str:
    """Name of a new catalogue entry for the bucketed files under ``path``, which may be there already or be inserted. Rows that
    come as ``repartition(buckets, key)`` deals them are inserted as one file a bucket."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name
