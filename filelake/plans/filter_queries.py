"""Scopes, predicates, metadata conditions, validation, facets and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets, filters, listing
from ..operators import fields as field_ops
from ..operators.search import sort_and_page
from . import views
from .registry import query
from .sql import with_views


def scoped(spark, sf_dir):
    return views.files(spark, sf_dir)


@query(with_views("files") + """SELECT path FROM files WHERE path = '/lake/docs/src1' OR path LIKE '/lake/docs/src1/%'
       OR path LIKE '/lake/web/%'""")
def in_scope(spark, sf_dir):
    return filters.in_scope(scoped(spark, sf_dir), ["/lake/docs/src1/", "/lake/web"]).select("path")


@query(with_views("files") + """SELECT path, size FROM files f WHERE EXISTS (SELECT 1 FROM supplier s
       WHERE f.path LIKE '/lake/docs/src' || CAST(s_nationkey AS VARCHAR) || '/%')""")
def in_scope_of_table(spark, sf_dir):
    roots = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("/lake/docs/src"), F.col("s_nationkey").cast("string")).alias("root"))
    return filters.in_scope(scoped(spark, sf_dir), roots).select("path", "size")


@query(with_views("files") + "SELECT path FROM files WHERE dir = '/lake/docs/src3' OR dir LIKE '/lake/docs/src3/%'")
def in_dir_scope(spark, sf_dir):
    return filters.in_dir_scope(scoped(spark, sf_dir), "/lake/docs/src3").select("path")


@query(with_views("files") + "SELECT path, ext FROM files WHERE ext IN ('md', 'html', 'jpg')")
def ext_in(spark, sf_dir):
    return filters.ext_in(scoped(spark, sf_dir), [" .MD", "html ", "jpg"]).select("path", "ext")


@query(with_views("files") + "SELECT path, size FROM files WHERE size BETWEEN 500 AND 4000")
def size_between(spark, sf_dir):
    return filters.size_between(scoped(spark, sf_dir), 500, 4000).select("path", "size")


@query(with_views("files") + "SELECT path, mtime FROM files WHERE mtime BETWEEN 1706000000 AND 1720000000")
def mtime_between(spark, sf_dir):
    return filters.mtime_between(scoped(spark, sf_dir), 1706000000, 1720000000).select("path", "mtime")


@query(with_views("files") + """SELECT path, 'name~' AS filter FROM files WHERE contains(lower(name), '_1')
    UNION ALL SELECT path, 'ext!=' FROM files WHERE ext <> 'txt'
    UNION ALL SELECT path, 'mime=' FROM files WHERE mimeclass = 'archive'
    UNION ALL SELECT path, 'size>=' FROM files WHERE size >= 3000
    UNION ALL SELECT path, 'mtime<' FROM files WHERE mtime < 1717200000""")
def common_filter(spark, sf_dir):
    f = scoped(spark, sf_dir)
    cases = [("name", "~", "_1"), ("ext", "!=", ".TXT"), ("mime", "=", "Archive"), ("size", ">=", "3e3"), ("mtime", "<", "2024-06-01")]
    parts = [filters.common_filter(f, k, op, v).select("path", F.lit(k + op).alias("filter")) for k, op, v in cases]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(with_views("files", "file_meta") + """SELECT path, 'num' AS filter FROM files f WHERE EXISTS
      (SELECT 1 FROM file_meta m WHERE m.path = f.path AND key = 'doc.quality' AND num >= 1)
    UNION ALL SELECT path, 'num=' FROM files f WHERE EXISTS
      (SELECT 1 FROM file_meta m WHERE m.path = f.path AND key = 'doc.quality' AND num = 0)
    UNION ALL SELECT path, 'text' FROM files f WHERE EXISTS
      (SELECT 1 FROM file_meta m WHERE m.path = f.path AND key = 'doc.speaker' AND lower(value) = 'assistant')
    UNION ALL SELECT path, 'like' FROM files f WHERE EXISTS
      (SELECT 1 FROM file_meta m WHERE m.path = f.path AND key = 'doc.speaker' AND contains(lower(value), 's'))""")
def meta_exists(spark, sf_dir):
    f, m = views.files(spark, sf_dir), views.file_meta(spark, sf_dir)
    def case(label, key, op, value, kind):
        return filters.meta_exists(f, m, key, op, value, kind).select("path", F.lit(label).alias("filter"))
    return (
        case("num", "doc.quality", ">=", "1", "number").unionByName(case("num=", "doc.quality", "=", "0.0", "number"))
        .unionByName(case("text", "doc.speaker", "=", "ASSISTANT", "enum")).unionByName(case("like", "doc.speaker", "~", "S", "enum"))
    )


@query(with_views("files", "file_meta") + """SELECT path FROM files f WHERE NOT EXISTS
      (SELECT 1 FROM file_meta m WHERE m.path = f.path AND key = 'doc.speaker' AND lower(value) = 'assistant')""")
def meta_not_equal(spark, sf_dir):
    return filters.meta_not_equal(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), "doc.speaker", "assistant").select("path")


# --- batches of requests: one per supplier, so their number grows with the data ----------------------------

META_SCHEMA = "array<struct<key:string,op:string,value:string>>"


def filter_requests(spark, sf_dir):
    """A filter-only request per supplier: scope, extensions, size and time bounds, metadata conditions."""
    s = views.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")

    def cond(key, op, value):
        return F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), value.alias("value"))

    meta = (
        F.when(k % 4 == 0, F.array(cond("doc.quality", ">=", F.lit("1")), cond("doc.speaker", "!=", F.lit("assistant"))))
        .when(k % 4 == 1, F.array(cond("doc.lang", "=", F.lit("EN")), cond("size", ">", F.lit("800"))))
        .when(k % 4 == 2, F.array(cond("doc.toxic", "=", F.lit("false")), cond("name", "~", F.lit("TH"))))
        .otherwise(F.array().cast(META_SCHEMA))
    )
    null = F.lit(None)
    return s.select(
        F.concat(F.lit("s"), k.cast("string")).alias("request_id"), F.lit("").alias("q"), F.lit("both").alias("mode"),
        F.when(k % 3 == 0, F.lit("/lake/docs")).when(k % 3 == 1, F.concat(F.lit("/lake/docs/src"), F.col("s_nationkey").cast("string")))
        .alias("path"),
        F.when(k % 5 == 0, F.array(F.lit(".TXT"), F.lit("md"))).alias("exts"),
        F.when(k % 2 == 0, F.floor(F.abs("s_acctbal")).cast("long")).otherwise(F.lit(-1)).cast("long").alias("min_size"),
        F.lit(-1).cast("long").alias("max_size"), F.lit(0).cast("long").alias("after"),
        F.when(k % 6 == 5, F.lit(1720000000)).otherwise(F.lit(0)).cast("long").alias("before"),
        meta.alias("meta"),
        F.element_at(F.array(*[F.lit(x) for x in ("name", "size", "mtime", "")]), (k % 4 + 1).cast("int")).alias("sort"),
        F.when(k % 7 < 3, F.lit("desc")).otherwise(F.lit("asc")).alias("dir"),
        F.lit(20).cast("long").alias("limit"), (k % 3 * 10).cast("long").alias("offset"),
    )


FILTER_MATCHES = """
    SELECT 's' || CAST(k AS VARCHAR) AS request_id, k, f.* FROM files f, (SELECT s_suppkey AS k, * FROM supplier) s
    WHERE (k % 3 <> 0 OR f.dir LIKE '/lake/docs/%')
      AND (k % 3 <> 1 OR f.dir LIKE '/lake/docs/src' || CAST(s_nationkey AS VARCHAR) || '/%')
      AND (k % 5 <> 0 OR f.ext IN ('txt', 'md'))
      AND (k % 2 <> 0 OR f.size >= CAST(floor(abs(s_acctbal)) AS BIGINT))
      AND (k % 6 <> 5 OR f.mtime <= 1720000000)
      AND CASE k % 4
        WHEN 0 THEN f.path IN (SELECT path FROM file_meta WHERE key = 'doc.quality' AND num >= 1)
                AND f.path NOT IN (SELECT path FROM file_meta WHERE key = 'doc.speaker' AND value = 'assistant')
        WHEN 1 THEN f.size > 800 AND f.path IN (SELECT path FROM file_meta WHERE key = 'doc.lang' AND value = 'en')
        WHEN 2 THEN contains(lower(f.name), 'th') AND f.path IN (SELECT path FROM file_meta WHERE key = 'doc.toxic' AND value = 'no')
        ELSE true END"""


def search_tables(spark, sf_dir):
    from ..operators.search import SearchTables

    return SearchTables(
        views.files(spark, sf_dir), views.file_meta(spark, sf_dir), views.content(spark, sf_dir), views.index(spark, sf_dir),
        field_ops.field_catalog(spark, views.FIELD_TYPES),
    )


@query(with_views("files", "file_meta", hits=FILTER_MATCHES) + "SELECT request_id, path, size FROM hits")
def all_meta_filters(spark, sf_dir):
    """Every match of every filter request, before paging."""
    from ..operators.search import SearchTables, filter_only

    tables = SearchTables(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), None, None,
                          field_ops.field_catalog(spark, views.FIELD_TYPES))
    return filter_only(filter_requests(spark, sf_dir), tables).select("request_id", "path", "size")


@query(with_views("files", "file_meta", hits=FILTER_MATCHES, ranked="""
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
      CASE WHEN k % 4 = 1 AND k % 7 >= 3 THEN size WHEN k % 4 = 2 AND k % 7 >= 3 THEN mtime END,
      CASE WHEN k % 4 = 1 AND k % 7 < 3 THEN size WHEN k % 4 = 2 AND k % 7 < 3 THEN mtime END DESC,
      CASE WHEN k % 4 IN (0, 3) AND k % 7 >= 3 THEN lower(name) END, CASE WHEN k % 4 IN (0, 3) AND k % 7 < 3 THEN lower(name) END DESC,
      CASE WHEN k % 7 >= 3 THEN path END, CASE WHEN k % 7 < 3 THEN path END DESC) AS rank FROM hits""")
    + """SELECT request_id, rank, path, name, size, mtime FROM ranked
         WHERE rank > (k % 3) * 10 AND rank <= (k % 3) * 10 + 20""")
def filter_only_batch(spark, sf_dir):
    """Pages of all filter requests at once."""
    from ..operators.search import SearchTables, search

    tables = SearchTables(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), views.content(spark, sf_dir),
                          views.index(spark, sf_dir), field_ops.field_catalog(spark, views.FIELD_TYPES))
    return search(filter_requests(spark, sf_dir), tables, with_snippets=False).hits.select(
        "request_id", "rank", "path", "name", "size", "mtime")


@query(with_views("files") + """SELECT path, name, ext, size, mtime FROM files
       WHERE size > 300 AND ext IN ('txt', 'md', 'log', 'html') AND (dir = '/lake' OR dir LIKE '/lake/%')
       ORDER BY size DESC, path DESC LIMIT 25 OFFSET 25""")
def filter_only_page(spark, sf_dir):
    """Flagship: second page of large text files under one directory, largest first."""
    f = views.files(spark, sf_dir)
    kept = filters.size_between(filters.ext_in(filters.in_dir_scope(f, "/lake"), ["txt", "md", "log", "html"]), lo=301)
    return sort_and_page(kept.select("path", "name", "ext", "size", "mtime"), "size", "desc", limit=25, offset=25)


_BAD_META = """CASE k % 8 WHEN 0 THEN 'unknown metadata key: image.nope' WHEN 1 THEN 'invalid operator for doc.lang'
   WHEN 2 THEN 'ordering needs a numeric field: doc.lang' WHEN 3 THEN 'not a valid value for doc.quality'
   WHEN 4 THEN '~ is not valid for size' WHEN 5 THEN 'at most 16 metadata filters per search' END"""


@query(f"""SELECT * FROM (SELECT 's' || CAST(k AS VARCHAR) AS request_id, 'BAD_REQUEST' AS error_code, {_BAD_META} AS message
           FROM (SELECT s_suppkey AS k FROM supplier)) WHERE message IS NOT NULL""")
def validate_filters(spark, sf_dir):
    k = F.col("s_suppkey")

    def one(key, op, value):
        return F.array(F.struct(F.lit("doc.lang").alias("key"), F.lit("=").alias("op"), F.lit("en").alias("value")),
                       F.struct(F.lit(key).alias("key"), F.lit(op).alias("op"), F.lit(value).alias("value")))

    meta = (
        F.when(k % 8 == 0, one("image.nope", "=", "1")).when(k % 8 == 1, one("doc.lang", "=~", "x"))
        .when(k % 8 == 2, one("doc.lang", "<", "x")).when(k % 8 == 3, one("doc.quality", "=", "high"))
        .when(k % 8 == 4, one("size", "~", "12")).when(k % 8 == 5, F.array_repeat(one("doc.lang", "=", "en")[0], 17))
        .when(k % 8 == 6, one("mtime", ">=", "2024-01-01")).otherwise(one("doc.quality", ">=", "1"))
    )
    r = filter_requests(spark, sf_dir).drop("meta")
    s = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("request_id"), meta.alias("meta"))
    return filters.validate_filters(r.join(s, "request_id"), field_ops.field_catalog(spark, views.FIELD_TYPES), max_filters=16)


@query("""SELECT * FROM (SELECT 'c' || CAST(k AS VARCHAR) AS request_id, 'BAD_REQUEST' AS error_code,
      CASE WHEN k % 5 = 0 THEN 'invalid search mode' WHEN k % 5 = 1 THEN 'no searchable terms and no filters'
           WHEN k % 5 = 2 THEN 'invalid sort' WHEN k % 5 = 3 THEN 'invalid sort direction'
           WHEN k * 10 + CASE WHEN k % 2000 = 0 THEN 100 ELSE k % 2000 END > 10000
             THEN 'offset+limit must not exceed 10000' END AS message
      FROM (SELECT c_custkey AS k FROM customer)) WHERE message IS NOT NULL""")
def validate_requests(spark, sf_dir):
    k = F.col("c_custkey")
    c = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("request_id"),
        F.when(k % 5 == 1, F.lit('** "--" AND')).otherwise(F.lit("report 2024")).alias("q"),
        F.when(k % 5 == 0, F.lit("fuzzy")).otherwise(F.lit("name")).alias("mode"), F.lit("").alias("path"),
        F.array().cast("array<string>").alias("exts"), F.lit(-1).cast("long").alias("min_size"), F.lit(-1).cast("long").alias("max_size"),
        F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("before"), F.array().cast(META_SCHEMA).alias("meta"),
        F.when(k % 5 == 2, F.lit("colour")).otherwise(F.lit("")).alias("sort"),
        F.when(k % 5 == 3, F.lit("up")).otherwise(F.lit("desc")).alias("dir"),
        (k % 2000).alias("limit"), (k * 10).alias("offset"))
    return filters.validate_requests(c, max_window=10_000)


@query(with_views("files") + """SELECT name, path, CASE WHEN ext = 'zip' THEN 'archive' ELSE 'file' END AS type, size, mtime,
       CASE ext WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'log' THEN 'text/plain' WHEN 'csv' THEN 'text/csv'
         WHEN 'json' THEN 'application/json' WHEN 'py' THEN 'text/plain' WHEN 'zip' THEN 'application/zip' WHEN 'jpg' THEN 'image/jpeg'
         ELSE 'text/html' END AS mime, '' AS target FROM files""")
def entry_projection(spark, sf_dir):
    return filters.to_entries(views.files(spark, sf_dir))


# --- facets -----------------------------------------------------------------------------------------------

@query(with_views("files", "file_meta") + """SELECT value, count(*) AS count FROM file_meta JOIN files f USING (path)
       WHERE key = 'doc.speaker' AND (f.dir = '/lake/docs' OR f.dir LIKE '/lake/docs/%') AND lower(value) LIKE 's%'
       GROUP BY value""")
def facet_values(spark, sf_dir):
    return facets.facet_values(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), "doc.speaker", prefix="S", scope="/lake/docs")


@query(with_views("files") + "SELECT ext AS value, count(*) AS count FROM files WHERE ext LIKE 'j%' GROUP BY ext")
def facet_ext(spark, sf_dir):
    return facets.facet_values(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), "ext", prefix=".J")


@query(with_views("files") + """SELECT mimeclass AS value, count(*) AS count FROM files WHERE path LIKE '/lake/docs/src1/%'
       GROUP BY mimeclass ORDER BY count DESC, value LIMIT 3""")
def facet_mime(spark, sf_dir):
    return facets.facet_values(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), "mime", limit=3, roots=["/lake/docs/src1"])


@query(with_views("files", "file_meta", counted="""
      SELECT key, value, count(*) AS count FROM (SELECT 'ext' AS key, ext AS value FROM files
        UNION ALL SELECT 'mime', mimeclass FROM files UNION ALL SELECT key, value FROM file_meta) GROUP BY key, value""")
    + "SELECT key, value, count FROM counted")
def facet_values_all(spark, sf_dir):
    return facets.facet_values_all(views.files(spark, sf_dir), views.file_meta(spark, sf_dir))


@query(with_views("files", "file_meta", counted="""
      SELECT key, value, count(*) AS count FROM (SELECT 'ext' AS key, ext AS value FROM files
        UNION ALL SELECT 'mime', mimeclass FROM files UNION ALL SELECT key, value FROM file_meta) GROUP BY key, value""")
    + """SELECT key, value, count FROM counted
         QUALIFY row_number() OVER (PARTITION BY key ORDER BY count DESC, value) <= 4""")
def facet_top_values(spark, sf_dir):
    """The top-k report is the feature here."""
    return facets.facet_values_all(views.files(spark, sf_dir), views.file_meta(spark, sf_dir), limit=4)


@query("""SELECT key, 'BAD_REQUEST' AS error_code, CASE WHEN contains(key, '.') OR key NOT IN ('name', 'size')
         THEN 'unknown metadata key: ' || key ELSE 'values cannot be enumerated: ' || key END AS message
       FROM (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'size' WHEN 2 THEN 'ext' WHEN 3 THEN 'doc.lang'
             ELSE 'doc.' || lower(split_part(p_type, ' ', 1)) END AS key FROM part) WHERE key NOT IN ('ext', 'doc.lang')""")
def validate_facet_keys(spark, sf_dir):
    n = F.col("p_size") % 5
    keys = views.table(spark, sf_dir, "part").select(
        F.when(n == 0, "name").when(n == 1, "size").when(n == 2, "ext").when(n == 3, "doc.lang")
        .otherwise(F.concat(F.lit("doc."), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))).alias("key")).distinct()
    return filters.validate_facet_keys(keys, field_ops.field_catalog(spark, views.FIELD_TYPES))


@query("""WITH s AS (SELECT user_id AS index_id, ts, event_id, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'crawling'
           ELSE event_type END AS state, CAST(floor(value) AS BIGINT) AS last_full_scan FROM events)
    SELECT index_id, state = 'idle' AND last_full_scan > 0 AS fresh FROM s
    QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC, event_id DESC) = 1""")
def index_freshness(spark, sf_dir):
    return facets.index_fresh(views.status_events(spark, sf_dir))


@query(with_views("file_meta") + """SELECT f.key, f.type, coalesce(n.uses, 0) AS uses FROM (VALUES ('doc.lang', 'enum'), ('doc.quality', 'number'),
       ('doc.toxic', 'bool'), ('doc.speaker', 'enum')) f(key, type) LEFT JOIN (SELECT key, count(*) AS uses FROM file_meta GROUP BY key) n USING (key)""")
def field_catalog(spark, sf_dir):
    """The field catalogue joined with how often each of the site's own keys occurs."""
    uses = views.file_meta(spark, sf_dir).groupBy("key").agg(F.count("*").alias("uses"))
    catalog = field_ops.field_catalog(spark, views.FIELD_TYPES).where(F.col("category") == "doc")
    return catalog.join(uses, "key", "left").select("key", "type", F.coalesce("uses", F.lit(0)).alias("uses"))


# --- listings ---------------------------------------------------------------------------------------------

_ENTRY_SQL = """SELECT name, path, CASE WHEN ext = 'zip' THEN 'archive' ELSE 'file' END AS type, size, mtime FROM files WHERE dir = '{d}'
    UNION ALL SELECT DISTINCT n, '{d}/' || n, 'dir', 0, 0 FROM (SELECT split_part(substr(dir, length('{d}') + 2), '/', 1) AS n
      FROM files WHERE dir LIKE '{d}/%')"""


@query(with_views("files") + _ENTRY_SQL.format(d="/lake/docs/src2") + " UNION ALL " + _ENTRY_SQL.format(d="/lake/docs/src2/en"))
def list_directory(spark, sf_dir):
    f = views.files(spark, sf_dir)
    cols = ("name", "path", "type", "size", "mtime")
    return listing.list_directory(f, "/lake/docs/src2/").select(*cols).unionByName(
        listing.list_directory(f, "/lake/docs/src2/en").select(*cols))


@query(with_views("files", e=_ENTRY_SQL.format(d="/lake/docs/src2/en")) + """
    SELECT name, path, type, size, mtime, (SELECT count(*) FROM e) AS total FROM e
    ORDER BY type = 'dir' DESC, CASE type WHEN 'dir' THEN 0 WHEN 'archive' THEN 1 ELSE 2 END DESC, lower(name) DESC, name DESC LIMIT 5 OFFSET 2""")
def list_page(spark, sf_dir):
    entries = listing.list_directory(views.files(spark, sf_dir), "/lake/docs/src2/en")
    return listing.list_page(entries, "type", "desc", offset=2, limit=5).select("name", "path", "type", "size", "mtime", "total")


_MEDIA_EXTS = ("mp3", "mkv", "txt", "mp4", "flac", "ts", "zip", "jpg")


@query(with_views(m=f"""SELECT '/lake/media/' || source || '/' || lang || '_' || CAST(doc_id AS VARCHAR) || '.' ||
          ['mp3','mkv','txt','mp4','flac','ts','zip','jpg'][doc_id % 8 + 1] AS path, '/lake/media/' || source AS dir,
          lang || '_' || CAST(doc_id AS VARCHAR) || '.' || ['mp3','mkv','txt','mp4','flac','ts','zip','jpg'][doc_id % 8 + 1] AS name,
          n_chars AS size, doc_id % 8 IN (0, 1, 3, 4, 5) AS media FROM documents""")
    + """SELECT path, lag(path) OVER w AS prev, lead(path) OVER w AS next FROM m WHERE media
         WINDOW w AS (PARTITION BY dir ORDER BY size DESC, lower(name) DESC, name DESC)""")
def media_neighbours(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _MEDIA_EXTS]), (F.col("doc_id") % 8 + 1).cast("int"))
    d = views.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/lake/media/"), "source").alias("dir"),
        F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
        ext.alias("ext"), F.col("n_chars").alias("size"), F.lit(0).cast("long").alias("mtime"))
    f = d.withColumn("path", F.concat("dir", F.lit("/"), "name"))
    return listing.media_neighbours(f, "size", "desc").select("path", "prev", "next")


@query(with_views("files") + """SELECT dir, count(*) AS entries, count(*) > 250000 AS too_large FROM files GROUP BY dir""")
def directory_sizes(spark, sf_dir):
    return listing.directory_sizes(views.scan(spark, sf_dir))
