"""Upkeep of the catalogue between two generations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog
from ..schema import FILES
from ..session import shared_dir
from ..sources import bucketed, snapshots
from . import views
from .registry import ORACLES, query
from .sql import with_views

SEEN = ("path", "size", "mtime", "mimeclass", "content_indexed", "meta_extracted", "gen")


def applied(spark, sf_dir):
    return catalog.apply_scan(views.old_files(spark, sf_dir), views.new_scan(spark, sf_dir), 2)


@query(with_views("applied") + f"SELECT {', '.join(SEEN)} FROM applied")
def upsert_scan(spark, sf_dir):
    return applied(spark, sf_dir).select(*SEEN)


@query(with_views("applied") + f"""SELECT {', '.join(SEEN)} FROM applied
       WHERE NOT (gen < 2 AND (path LIKE '/lake/docs/%' OR path LIKE '/lake/web/%'))""")
def sweep_missing(spark, sf_dir):
    return catalog.sweep_missing(applied(spark, sf_dir), 2, ["/lake/docs", "/lake/web"]).select(*SEEN)


@query(with_views("applied", "file_meta", "content", kept="SELECT path FROM applied WHERE gen = 2") + """
    SELECT 'meta' AS what, path, key || '=' || value AS v FROM file_meta WHERE path IN (SELECT path FROM kept)
    UNION ALL SELECT 'body', path, CAST(length(body) AS VARCHAR) FROM content WHERE path IN (SELECT path FROM kept)""")
def sweep_cascade(spark, sf_dir):
    kept = catalog.sweep_missing(applied(spark, sf_dir), 2, ["/"])
    meta = catalog.cascade(views.file_meta(spark, sf_dir), kept)
    bodies = catalog.cascade(views.content(spark, sf_dir), kept)
    return meta.select(F.lit("meta").alias("what"), "path", F.concat("key", F.lit("="), "value").alias("v")).unionByName(
        bodies.select(F.lit("body").alias("what"), "path", F.length("body").cast("string").alias("v")))


@query(with_views("applied", "old_files") + f"""
    SELECT {', '.join(SEEN)} FROM applied WHERE path LIKE '/lake/docs/src1/%' AND gen = 2
    UNION ALL SELECT {', '.join(SEEN)} FROM old_files WHERE path NOT LIKE '/lake/docs/src1/%'""")
def scoped_rescan(spark, sf_dir):
    return catalog.rescan(views.old_files(spark, sf_dir), views.new_scan(spark, sf_dir), "/lake/docs/src1", 2).select(*SEEN)


@query(with_views("old_files", "content", "file_meta") + """
    SELECT 'file' AS what, path, CASE WHEN content_indexed AND path LIKE '/lake/docs/src1/%' THEN 'text' ELSE '' END AS v
      FROM old_files WHERE path LIKE '/lake/docs/src1/%' OR path LIKE '/lake/docs/src2/%'
    UNION ALL SELECT 'body', path, CAST(length(body) AS VARCHAR) FROM content WHERE path LIKE '/lake/docs/src1/%'
    UNION ALL SELECT 'meta', path, value FROM file_meta WHERE path LIKE '/lake/docs/src1/%' OR path LIKE '/lake/docs/src2/%'""")
def sweep_outside_roots(spark, sf_dir):
    t = catalog.Tables(views.old_files(spark, sf_dir), views.content(spark, sf_dir), views.file_meta(spark, sf_dir))
    out = catalog.sweep_outside(t, ["/lake/docs/src1", "/lake/docs/src2"], ["/lake/docs/src1"])
    return (
        out.files.select(F.lit("file").alias("what"), "path", F.when(F.col("content_indexed"), "text").otherwise("").alias("v"))
        .unionByName(out.content.select(F.lit("body").alias("what"), "path", F.length("body").cast("string").alias("v")))
        .unionByName(out.file_meta.select(F.lit("meta").alias("what"), "path", F.col("value").alias("v")))
    )


@query(with_views("old_files", "new_scan") + """
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'removed'
      WHEN o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' ELSE 'changed' END AS change
    FROM old_files o FULL OUTER JOIN new_scan n ON o.path = n.path""")
def diff_snapshots(spark, sf_dir):
    return catalog.diff_snapshots(views.old_files(spark, sf_dir), views.new_scan(spark, sf_dir))


BUCKETS = 64


def bucketed_files(spark, sf_dir):
    """The catalogue of generation 1 as a bucketed snapshot: joins on its paths move the other side only."""
    path = f"{shared_dir(views.prepare(spark))}/bucketed/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    bucketed.write_bucketed(views.old_files(spark, sf_dir), path, BUCKETS)
    return bucketed.read_bucketed(spark, path, FILES, BUCKETS)


@query(ORACLES["upsert_scan"])
def upsert_bucketed(spark, sf_dir):
    return catalog.apply_scan(bucketed_files(spark, sf_dir), views.new_scan(spark, sf_dir), 2).select(*SEEN)


@query(ORACLES["diff_snapshots"])
def diff_bucketed(spark, sf_dir):
    return catalog.diff_snapshots(bucketed_files(spark, sf_dir), views.new_scan(spark, sf_dir))


@query(with_views("applied") + """SELECT path, ext, size FROM applied WHERE NOT content_indexed AND size <= 20000
       AND ext IN ('txt', 'md', 'html') AND (path LIKE '/lake/docs/src1/%' OR path LIKE '/lake/web/%') AND path LIKE '/lake/%'""")
def content_candidates(spark, sf_dir):
    rules = catalog.ContentRules((".TXT", "md", "html"), ("/lake/docs/src1", "/lake/web"), 20000)
    return catalog.content_candidates(applied(spark, sf_dir), rules, ["/lake"]).select("path", "ext", "size")


@query(with_views("applied") + "SELECT path, ext FROM applied WHERE NOT meta_extracted AND ext = 'jpg' AND path LIKE '/lake/docs/%'")
def meta_candidates(spark, sf_dir):
    return catalog.meta_candidates(applied(spark, sf_dir), roots=["/lake/docs"]).select("path", "ext")


@query(with_views("old_files", "new_scan", "file_meta", changed="""SELECT o.path FROM old_files o JOIN new_scan n USING (path)
         WHERE o.mtime <> n.mtime OR o.size <> n.size""") + """
    SELECT path, key, value FROM file_meta WHERE path NOT IN (SELECT path FROM changed)
    UNION ALL SELECT path, 'doc.seen', CAST(mtime AS VARCHAR) FROM new_scan WHERE path IN (SELECT path FROM changed)""")
def replace_rows(spark, sf_dir):
    old, scan = views.old_files(spark, sf_dir), views.new_scan(spark, sf_dir)
    changed = catalog.diff_snapshots(old, scan).where("change = 'changed'")
    new = scan.join(changed, "path", "left_semi").select(
        "path", F.lit("doc.seen").alias("key"), F.col("mtime").cast("string").alias("value"))
    return catalog.replace_rows(views.file_meta(spark, sf_dir).select("path", "key", "value"), changed, new)


@query(with_views("files", "content", "file_meta") + """SELECT (SELECT count(*) FROM files) AS files,
       (SELECT count(*) FROM content) AS bodies, (SELECT count(DISTINCT path) FROM file_meta) AS described""")
def recount(spark, sf_dir):
    return catalog.recount(catalog.Tables(views.files(spark, sf_dir), views.content(spark, sf_dir), views.file_meta(spark, sf_dir)))


@query(with_views("applied") + f"SELECT {', '.join(SEEN)} FROM applied WHERE gen = 2")
def snapshot_round_trip(spark, sf_dir):
    """Write both generations as snapshots, then read the one the manifest names."""
    base = f"{shared_dir(spark)}/snapshots/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    snapshots.write_snapshot({"files": views.old_files(spark, sf_dir)}, base, 1)
    old = snapshots.read_snapshot(spark, base, "files")["files"]
    merged = catalog.sweep_missing(catalog.apply_scan(old, views.new_scan(spark, sf_dir), 2), 2, ["/"])
    snapshots.write_snapshot({"files": merged}, base, 2)
    return snapshots.read_snapshot(spark, base, "files")["files"].select(*SEEN)
