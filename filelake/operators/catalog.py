"""Keeping the catalogue up to date from one snapshot of the file tree to the next."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths
from . import filters

STATE = ("path", "dir", "name", "ext", "size", "mtime", "mimeclass", "content_indexed", "meta_extracted", "gen")


@dataclass(frozen=True)
class ContentRules:
    """Which files get their text extracted; empty lists mean the default extensions and every path."""

    extensions: tuple[str, ...] = ()
    include_paths: tuple[str, ...] = ()
    max_bytes: int | None = None

    def wanted(self) -> list[str]:
        return filters.normal_exts(self.extensions) or list(fixed.CONTENT_EXTENSIONS)


@dataclass(frozen=True)
class Tables:
    files: DataFrame
    content: DataFrame
    file_meta: DataFrame


def initial(scan: DataFrame, gen: int) -> DataFrame:
    """First generation of the catalogue: nothing extracted yet."""
    return scan.select(
        "path", "dir", "name", "ext", "size", "mtime", paths.mime_class("name").alias("mimeclass"),
        F.lit(False).alias("content_indexed"), F.lit(False).alias("meta_extracted"), F.lit(gen).cast("long").alias("gen"),
    )


def _both_sides(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full_outer")


def _same() -> Column:
    return (F.col("o.size") == F.col("n.size")) & (F.col("o.mtime") == F.col("n.mtime"))


def apply_scan(old: DataFrame, scan: DataFrame, gen: int) -> DataFrame:
    """Upsert a scan: seen files take the new facts and generation; a file whose size and second of change are
    equal keeps its extraction flags, any other change resets both. Unseen files stay with their old generation."""
    seen = F.col("n.path").isNotNull()
    fresh = initial(scan, gen)
    keeps = F.coalesce(_same(), F.lit(False))

    def column(c: str) -> Column:
        if c in ("content_indexed", "meta_extracted"):
            return F.when(seen, keeps & F.coalesce(F.col(f"o.{c}"), F.lit(False))).otherwise(F.col(f"o.{c}")).alias(c)
        return F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return _both_sides(old, fresh).select(*[column(c) for c in STATE])


def sweep_missing(files: DataFrame, gen: int, roots: Iterable[str], complete: bool = True) -> DataFrame:
    """Drop files inside the crawled roots that the walk of generation ``gen`` did not stamp.

    A cancelled or partial walk (``complete=False``) proves nothing about unseen files, so it sweeps none.
    """
    if not complete:
        return files
    return files.where(~((F.col("gen") < gen) & paths.within_any("path", roots)))


def cascade(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Content or metadata rows of files that still exist."""
    return rows.join(files.select("path"), "path", "left_semi")


def rescan(old: DataFrame, scan: DataFrame, scope: str, gen: int) -> DataFrame:
    """Scan of one subtree: files in it are upserted and swept, files outside are untouched."""
    inside = paths.within("path", scope)
    updated = apply_scan(old.where(inside), scan.where(inside), gen)
    return sweep_missing(updated, gen, [scope]).unionByName(old.where(~inside).select(*STATE))


def drop_stale_bodies(content: DataFrame, files: DataFrame) -> DataFrame:
    """Bodies of files whose text is current; those of changed files go before extraction."""
    return content.join(files.where("content_indexed").select("path"), "path", "left_semi")


def sweep_outside(tables: Tables, roots: Iterable[str], include_paths: Iterable[str] = ()) -> Tables:
    """Apply a narrower configuration: rows outside the roots go everywhere; bodies outside the include paths go
    too, and their files are marked for extraction again while the file rows stay."""
    roots, include = list(roots), list(include_paths)
    kept = tables.files.where(paths.within_any("path", roots))
    bodies = tables.content.where(paths.within_any("path", roots))
    if include:
        inside = paths.within_any("path", include)
        bodies = bodies.where(inside)
        kept = kept.withColumn("content_indexed", F.col("content_indexed") & inside)
    return Tables(kept, bodies, tables.file_meta.where(paths.within_any("path", roots)))


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change)`` with new, changed, unchanged or removed."""
    change = (
        F.when(F.col("o.path").isNull(), F.lit("new")).when(F.col("n.path").isNull(), F.lit("removed"))
        .when(_same(), F.lit("unchanged")).otherwise(F.lit("changed"))
    )
    return _both_sides(old.select("path", "size", "mtime"), new.select("path", "size", "mtime")).select(
        F.coalesce("o.path", "n.path").alias("path"), change.alias("change")
    )


def content_candidates(files: DataFrame, rules: ContentRules = ContentRules(), roots: Iterable[str] = ("/",)) -> DataFrame:
    """Files whose text is to be read: not yet extracted, small enough, listed extension, inside scope."""
    out = files.where(
        ~F.col("content_indexed") & (F.lit(True) if rules.max_bytes is None else F.col("size") <= rules.max_bytes) & F.col("ext").isin(rules.wanted())
        & paths.within_any("path", roots)
    )
    if rules.include_paths:
        out = out.where(paths.within_any("path", rules.include_paths))
    return out.select("path", "ext", "size", "mtime")


def meta_candidates(files: DataFrame, exts: Iterable[str] | None = None, roots: Iterable[str] = ("/",)) -> DataFrame:
    """Files whose metadata is to be extracted; handled files are flagged even when they gave no rows."""
    exts = list(exts) if exts is not None else [e for es in fixed.CATEGORY_EXTENSIONS.values() for e in es]
    return files.where(
        ~F.col("meta_extracted") & F.col("ext").isin(exts) & paths.within_any("path", roots)
    ).select("path", "ext", "size", "mtime")


def mark_extracted(files: DataFrame, done: DataFrame, flag: str) -> DataFrame:
    """Set ``content_indexed`` or ``meta_extracted`` for the handled paths."""
    handled = done.select("path").distinct().withColumn("_done", F.lit(True))
    return files.join(handled, "path", "left").withColumn(
        flag, F.col(flag) | F.coalesce("_done", F.lit(False))
    ).select(*files.columns)


def replace_rows(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the changed paths are replaced as a whole, never appended to."""
    return old.join(changed.select("path"), "path", "left_anti").unionByName(new)


def recount(tables: Tables) -> DataFrame:
    """Files, bodies, and files with at least one metadata row, as one row."""
    counts = [
        tables.files.agg(F.count("*").alias("n")).select(F.lit("files").alias("what"), "n"),
        tables.content.agg(F.count("*").alias("n")).select(F.lit("bodies").alias("what"), "n"),
        tables.file_meta.agg(F.count_distinct("path").alias("n")).select(F.lit("described").alias("what"), "n"),
    ]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return rows.agg(*[F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("files", "bodies", "described")])
