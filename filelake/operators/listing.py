"""Directory listings from the catalogue, their order and pages, and neighbours of media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, paths
from .filters import to_entries

ENTRY = ("name", "path", "type", "size", "mtime", "mime", "target")


def list_directory(files: DataFrame, directory: str) -> DataFrame:
    """Direct children: files in the directory and subdirectories implied by deeper files."""
    top = paths.clean_dir(directory)
    head = "/" if top == "/" else top + "/"
    direct = to_entries(files.where(F.col("dir") == top))
    deeper = files.where((F.col("dir") != top) & F.col("dir").startswith(head))
    child = F.substring_index(F.substr("dir", F.lit(len(head) + 1)), "/", 1)
    folders = deeper.select(child.alias("name")).distinct().select(
        "name", F.concat(F.lit(head), "name").alias("path"), F.lit("dir").alias("type"),
        F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit("").alias("mime"),
        F.lit("").alias("target"),
    )
    return direct.select(*ENTRY).unionByName(folders)


def type_rank(kind: Column | str) -> Column:
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "dir", 0).when(k == "archive", 1).when(k == "file", 2).otherwise(3)


def listing_order(sort: str = "name", direction: str = "asc", dirs_first: bool = True) -> list[Column]:
    """Sort columns; a descending order turns everything around except directories before files."""
    keys = [F.lower("name"), F.col("name")]
    if sort in ("size", "mtime"):
        keys.insert(0, F.col(sort))
    elif sort == "type":
        keys.insert(0, type_rank("type"))
    turned = [F.desc(k) if direction == "desc" else F.asc(k) for k in keys]
    return ([F.desc(F.col("type") == "dir")] if dirs_first else []) + turned


def sort_listing(entries: DataFrame, sort: str = "name", direction: str = "asc", dirs_first: bool = True) -> DataFrame:
    return entries.orderBy(*listing_order(sort, direction, dirs_first))


def directory_sizes(files: DataFrame, max_entries: int = fixed.LISTING_MAX_ENTRIES) -> DataFrame:
    """Number of files per directory, with those of more than ``max_entries`` marked."""
    return files.groupBy("dir").agg(F.count("*").alias("entries")).withColumn("too_large", F.col("entries") > max_entries)


def list_page(entries: DataFrame, sort: str = "name", direction: str = "asc", dirs_first: bool = True,
              offset: int = 0, limit: int = fixed.LISTING_LIMIT, max_entries: int | None = None) -> DataFrame:
    """One page of a listing with the full count on each row; with ``max_entries`` a larger directory is refused
    as a single error row. Past the end the page is empty."""
    limit = max(limit, 0)
    total = entries.agg(F.count("*").alias("total"))
    counted = entries.withColumn("total", total.scalar())
    kept = counted if max_entries is None else counted.where(F.col("total") <= max_entries)
    page = sort_listing(kept, sort, direction, dirs_first).offset(max(offset, 0)).limit(limit)
    page = page.withColumn("error_code", F.lit(None).cast("string"))
    if max_entries is None:
        return page
    refused = total.where(F.col("total") > max_entries).select("total", F.lit("TOO_LARGE").alias("error_code"))
    return page.unionByName(refused, allowMissingColumns=True)


def media_neighbours(files: DataFrame, sort: str = "name", direction: str = "asc") -> DataFrame:
    """Previous and next playable file of the same directory for each playable file.

    Every directory is answered whole. The window streams over a directory's sorted media rows and spills; it keeps
    only the row before and the row after.
    """
    entries = files.select(
        "path", "dir", "name", "size", "mtime", paths.mime_by_ext("ext").alias("mime"),
        F.when(paths.is_archive_name("name"), F.lit("archive")).otherwise(F.lit("file")).alias("type"),
    )
    media = entries.where((F.col("type") == "file") & paths.media_kind("mime", "name").isNotNull())
    w = W.partitionBy("dir").orderBy(*listing_order(sort, direction, dirs_first=False))
    return media.select("path", F.lag("path").over(w).alias("prev"), F.lead("path").over(w).alias("next"))
