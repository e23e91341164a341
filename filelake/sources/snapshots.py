"""Versioned snapshots of the catalogue tables, switched by a manifest row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "gen long, snapshot string, last_full_scan long"


def write_snapshot(tables: dict[str, DataFrame], base_dir: str, gen: int, last_full_scan: int = 0) -> str:
    """Write all tables of a generation to a new folder, then append its manifest row.

    Readers follow the manifest only, so a job that dies before the last step leaves the previous generation in
    force, and no folder being read is ever written to. Repeating a generation replaces it for later readers.
    """
    spark = next(iter(tables.values())).sparkSession
    target = f"{base_dir}/gen-{gen:010d}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{target}/{name}")
    row = spark.createDataFrame([(gen, target, last_full_scan)], MANIFEST).withColumn("written", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{base_dir}/manifest")
    return target


def current_snapshot(spark: SparkSession, base_dir: str) -> DataFrame:
    """The manifest row in force: the highest generation, the latest writing of it."""
    manifest = spark.read.schema(MANIFEST + ", written timestamp").parquet(f"{base_dir}/manifest")
    return manifest.orderBy(F.desc("gen"), F.desc("written")).limit(1)


def read_snapshot(spark: SparkSession, base_dir: str, *names: str) -> dict[str, DataFrame]:
    row = current_snapshot(spark, base_dir).first()
    return {name: spark.read.parquet(f"{row['snapshot']}/{name}") for name in names}
