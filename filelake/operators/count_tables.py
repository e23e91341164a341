"""Facet counts and totals kept up by signed sums: a change costs the rows of its own paths, not the collection.

Below one folder lie ``sums(kind, key, value, n)``, one partition per generation, and a manifest. Rows of kind ``facet`` count
the values of every key that can be enumerated, rows of kind ``total`` the files, the bodies and the files with metadata
(the key says which, the value is empty). All of these are sums over paths, so the rows of changed paths, counted as they
are now and taken away as they were, are one more generation. Readers add the generations up; ``fold_counts`` makes one of
many. A generation counts from its manifest row on, which is written last: a job that dies before leaves the counts
as they were, and running it again overwrites the same partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import catalog, facets

SUMS = "kind string, key string, value string, n long"
MANIFEST = "gen long, whole boolean"
GROUP = ("kind", "key", "value")


def counted(tables: catalog.Tables) -> DataFrame:
    """``kind, key, value, n`` of whole tables, or of all rows of some paths."""
    values = facets.facet_values_all(tables.files, tables.file_meta).select(
        F.lit("facet").alias("kind"), "key", "value", F.col("count").alias("n"))
    totals = catalog.recount(tables).select(F.explode(F.array(*[
        F.struct(F.lit(what).alias("key"), F.col(what).alias("n")) for what in ("files", "bodies", "described")])).alias("t"))
    return values.unionByName(totals.select(F.lit("total").alias("kind"), "t.key", F.lit("").alias("value"), "t.n"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of files that came, went or changed between two catalogues."""
    return catalog.diff_snapshots(old, new).where("change <> 'unchanged'").select("path")


def rows_of(tables: catalog.Tables, changed: DataFrame) -> catalog.Tables:
    """All rows of some paths (each named once)."""
    keys = changed.select("path")
    return catalog.Tables(*[t.join(keys, "path", "left_semi") for t in (tables.files, tables.content, tables.file_meta)])


def _added(*parts: DataFrame) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*GROUP).agg(F.sum("n").alias("n")).where("n <> 0")


def _generations(spark: SparkSession, base: str) -> tuple[int, list[int]]:
    """The last generation and those in force; the manifest has one row per generation."""
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest").distinct().collect()
    whole = max(r.gen for r in rows if r.whole)
    return max(r.gen for r in rows), [r.gen for r in rows if r.gen >= whole]


def _put(sums: DataFrame, base: str, gen: int, whole: bool) -> None:
    spark = sums.sparkSession
    sums.select(*GROUP, "n").write.mode("overwrite").parquet(f"{base}/sums/gen={gen}")
    spark.createDataFrame([(gen, whole)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def create_counts(tables: catalog.Tables, base: str) -> None:
    """The first generation, from whole tables."""
    _put(counted(tables), base, 1, True)


def refresh_counts(before: catalog.Tables, after: catalog.Tables, base: str) -> None:
    """The next generation. ``before`` and ``after`` hold all rows of the changed paths, as they were and as they are."""
    last, _ = _generations(after.files.sparkSession, base)
    gone = counted(before).withColumn("n", -F.col("n"))
    _put(_added(counted(after), gone), base, last + 1, False)


def apply_snapshot(old: catalog.Tables, new: catalog.Tables, base: str) -> None:
    """The next generation from two catalogues: their diff names the paths, only their rows are counted."""
    changed = staged(changed_paths(old.files, new.files), "changed")
    refresh_counts(rows_of(old, changed), rows_of(new, changed), base)


def open_counts(spark: SparkSession, base: str) -> DataFrame:
    """``kind, key, value, n`` as a full count of the present tables gives them; values that nothing holds are gone."""
    _, gens = _generations(spark, base)
    rows = spark.read.schema(SUMS + ", gen long").parquet(f"{base}/sums").where(F.col("gen").isin(*gens))
    return _added(rows.select(*GROUP, "n"))


def fold_counts(spark: SparkSession, base: str) -> None:
    """One whole generation in place of all in force."""
    last, _ = _generations(spark, base)
    _put(open_counts(spark, base), base, last + 1, True)


def facet_values(counts: DataFrame, key: str, prefix: str = "", limit: int = 0) -> DataFrame:
    """``(value, count)`` of one key, most frequent first, then by value; the prefix ignores case."""
    rows = counts.where((F.col("kind") == "facet") & (F.col("key") == key))
    if prefix:
        rows = rows.where(F.lower("value").startswith(prefix.lower()))
    ordered = rows.select("value", F.col("n").alias("count")).orderBy(F.desc("count"), F.asc("value"))
    return ordered.limit(limit) if limit > 0 else ordered
