"""Path, name and value functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, paths, text, values
from ..operators import filters
from . import views
from .registry import query
from .sql import with_views

SUFFIXES = "|".join(s[1:].replace(".", r"\.") for s in fixed.ARCHIVE_SUFFIXES)

# Names with many endings: every extension of the fixed tables in turn, on the name of each listed file.
_ALL_EXTS = sorted(set(fixed.MIME_BY_EXT) | {s[1:] for s in fixed.ARCHIVE_SUFFIXES} | {"xyz", "DEB", "Mp3", "udeb"}
                   | {e for exts in fixed.CATEGORY_EXTENSIONS.values() for e in exts})
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in _ALL_EXTS) + "]"


def named(spark, sf_dir):
    """Documents with a name whose ending walks through all known suffixes."""
    exts = F.array(*[F.lit(e) for e in _ALL_EXTS])
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    ext = F.element_at(exts, (F.col("doc_id") % len(_ALL_EXTS) + 1).cast("int"))
    return docs.select("doc_id", F.concat("source", F.lit("."), "lang", F.lit("."), ext).alias("name"))


NAMED = f"SELECT doc_id, source || '.' || lang || '.' || {_EXT_SQL}[doc_id % {len(_ALL_EXTS)} + 1] AS name FROM documents"


def _case_sql(table: dict, expr: str, default: str) -> str:
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    arms = " ".join(f"WHEN {expr} IN ({', '.join(repr(k) for k in ks)}) THEN {v!r}" for v, ks in by_value.items())
    return f"CASE {arms} ELSE {default} END"


@query(with_views("files") + "SELECT path, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS ext FROM files")
def file_ext(spark, sf_dir):
    return views.scan(spark, sf_dir).select("path", paths.file_ext("name").alias("ext"))


@query(
    with_views("files", v="SELECT path || '!/' || ext || '/' || mimeclass AS p FROM files UNION ALL SELECT path FROM files")
    + """SELECT p, regexp_extract(p, '[^/]*$') AS base,
             regexp_replace(p, '!?/[^/]*$', '') AS parent,
             regexp_replace(regexp_replace(p, '!?/[^/]*$', ''), '!?/[^/]*$', '') AS grandparent
         FROM v"""
)
def parent_path(spark, sf_dir):
    f = views.files(spark, sf_dir)
    p = f.select(F.concat("path", F.lit("!/"), "ext", F.lit("/"), "mimeclass").alias("p")).unionByName(
        f.select(F.col("path").alias("p")))
    up = paths.parent_path("p")
    return p.select("p", paths.base_name("p").alias("base"), up.alias("parent"), paths.parent_path(up).alias("grandparent"))


@query(
    with_views("files", v="SELECT path || '!/' || ext || '/in.zip!/x/' || name AS p FROM files") + """
    , layers AS (SELECT p, unnest(string_split(p, '!/')) AS layer, generate_subscripts(string_split(p, '!/'), 1) AS li FROM v)
    , parts AS (SELECT p, li, unnest(list_filter(string_split(layer, '/'), lambda x: x <> '')) AS label,
                  generate_subscripts(list_filter(string_split(layer, '/'), lambda x: x <> ''), 1) AS pi FROM layers)
    , pieces AS (SELECT p, li, pi, label, (CASE WHEN pi > 1 OR li = 1 THEN '/' ELSE '!/' END) || label AS piece FROM parts)
    , made AS (SELECT p, label, li, pi,
                 string_agg(piece, '') OVER (PARTITION BY p ORDER BY li, pi ROWS UNBOUNDED PRECEDING) AS path,
                 lead(li) OVER (PARTITION BY p ORDER BY li, pi) AS next_li FROM pieces)
    SELECT p, label, path, coalesce(next_li > li, false) AS archive FROM made
    UNION ALL SELECT p, '/', '/', false FROM v"""
)
def crumbs(spark, sf_dir):
    p = views.files(spark, sf_dir).select(
        F.concat("path", F.lit("!/"), "ext", F.lit("/in.zip!/x/"), "name").alias("p"))
    return p.select("p", F.explode(paths.crumbs("p")).alias("c")).select("p", "c.*")


@query(with_views(n=NAMED) + f"SELECT doc_id, name, regexp_matches(lower(name), '.\\.({SUFFIXES})$') AS is_archive FROM n")
def is_archive_name(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "name", paths.is_archive_name("name").alias("is_archive"))


@query(
    with_views(n=NAMED) + "SELECT doc_id, CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"lower(name) LIKE '_%{s}'" for s in suffixes) + f" THEN '{fmt}'"
        for fmt, suffixes in fixed.ARCHIVE_FORMATS)
    + f" WHEN regexp_matches(lower(name), '.\\.({SUFFIXES})$') THEN 'other' END AS format FROM n"
)
def archive_format(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", paths.archive_format("name").alias("format"))


_NAME_EXT = "lower(regexp_extract(name, '\\.([^.]*)$', 1))"


@query(with_views(n=NAMED) + f"SELECT doc_id, name, {_case_sql(fixed.MIME_BY_EXT, _NAME_EXT, repr(''))} AS mime FROM n")
def mime_by_name(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "name", paths.mime_by_name("name").alias("mime"))


@query(
    with_views(n=NAMED)
    + f"SELECT doc_id, CASE WHEN regexp_matches(lower(name), '.\\.({SUFFIXES})$') THEN 'archive' ELSE "
    + f"split_part({_case_sql(fixed.MIME_BY_EXT, _NAME_EXT, repr(''))}, '/', 1) END AS mimeclass FROM n"
)
def mime_class(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", paths.mime_class("name").alias("mimeclass"))


_CATEGORY = {e: k for k, exts in fixed.CATEGORY_EXTENSIONS.items() for e in exts}
_PLAYER = {e: "video" for e in fixed.PLAYER_VIDEO_EXTENSIONS} | {e: "audio" for e in fixed.PLAYER_AUDIO_EXTENSIONS}


@query(
    with_views(n=NAMED)
    + f""", m AS (SELECT *, {_case_sql(fixed.MIME_BY_EXT, _NAME_EXT, repr(''))} AS mime FROM n)
    SELECT doc_id, {_case_sql(_CATEGORY, _NAME_EXT, 'NULL')} AS category,
      CASE WHEN mime LIKE 'video/%' THEN 'video' WHEN mime LIKE 'audio/%' THEN 'audio'
           ELSE {_case_sql(_PLAYER, _NAME_EXT, 'NULL')} END AS kind FROM m"""
)
def category_of_ext(spark, sf_dir):
    return named(spark, sf_dir).select(
        "doc_id", paths.category_of_ext(paths.file_ext("name")).alias("category"),
        paths.media_kind(paths.mime_by_name("name"), "name").alias("kind"))


_RAW_NAMES = """SELECT page_id, unnest([split_part(url, '//', 2), '/' || url, './' || replace(url, '/', '/../'),
    url || '/a/./b/../', '../' || url, 'x/../..', '']) AS raw FROM pages"""


@query(
    with_views(n=_RAW_NAMES) + """
    , folded AS (SELECT page_id, raw, list_reduce(string_split(raw, '/'), lambda acc, p:
        CASE WHEN p IN ('', '.') THEN acc
             WHEN p = '..' AND acc <> '' AND acc <> '..' AND acc NOT LIKE '%/..'
               THEN CASE WHEN contains(acc, '/') THEN regexp_replace(acc, '/[^/]*$', '') ELSE '' END
             WHEN acc = '' THEN p ELSE acc || '/' || p END, '') AS c FROM n)
    SELECT page_id, raw, CASE WHEN raw LIKE '/%' OR c IN ('', '..') OR c LIKE '../%' THEN NULL ELSE c END AS cleaned
    FROM folded"""
)
def clean_entry_name(spark, sf_dir):
    url = F.col("url")
    raw = F.array(
        F.split_part(url, F.lit("//"), F.lit(2)), F.concat(F.lit("/"), url),
        F.concat(F.lit("./"), F.replace(url, F.lit("/"), F.lit("/../"))), F.concat(url, F.lit("/a/./b/../")),
        F.concat(F.lit("../"), url), F.lit("x/../.."), F.lit(""))
    names = views.table(spark, sf_dir, "pages").select("page_id", F.explode(raw).alias("raw"))
    return names.select("page_id", "raw", paths.clean_entry_name("raw").alias("cleaned"))


@query(
    with_views(n="""SELECT page_id, '/lake/.git/' || replace(replace(split_part(url, '//', 2), '/', '/.'), 'fr', 'cache') || t AS dir
                    FROM pages, (SELECT unnest(['', '/.Trash-1000/x', '/lost+found', '/node_modules2']) AS t)""")
    + """SELECT page_id, dir, len(list_filter(string_split(substr(dir, 11), '/'), lambda x:
           x IN ('.git','.svn','node_modules','__pycache__','.venv','.cache','lost+found','.Recycle.Bin',
                 'System Volume Information','$RECYCLE.BIN') OR starts_with(x, '.Trash-'))) > 0 AS skipped FROM n"""
)
def skip_dir(spark, sf_dir):
    tail = F.explode(F.array(*[F.lit(t) for t in ("", "/.Trash-1000/x", "/lost+found", "/node_modules2")]))
    inner = F.replace(F.replace(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit("/.")), F.lit("fr"), F.lit("cache"))
    dirs = views.table(spark, sf_dir, "pages").select("page_id", inner.alias("inner"), tail.alias("t")).select(
        "page_id", F.concat(F.lit("/lake/.git/"), "inner", "t").alias("dir"))
    return dirs.select("page_id", "dir", paths.skip_dir("dir", "/lake/.git").alias("skipped"))


# --- values -----------------------------------------------------------------------------------------------

@query(
    r"""WITH v AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'),
                   ' ') AS t FROM documents)
    SELECT doc_id, t AS value FROM v"""
)
def clean_value(spark, sf_dir):
    """Whole texts as values."""
    return views.table(spark, sf_dir, "documents").select("doc_id", values.clean_value("text").alias("value"))


@query(
    r"""WITH v AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'),
                   ' ') AS t FROM documents)
    , lens AS (SELECT doc_id, t, (SELECT max(i) FROM range(0, 513) r(i) WHERE strlen(substr(t, 1, i)) <= 512) AS keep FROM v)
    SELECT doc_id, CASE WHEN strlen(t) <= 512 THEN t ELSE rtrim(substr(t, 1, keep), ' ') END AS value FROM lens"""
)
def clean_value_limited(spark, sf_dir):
    """The limit of stored values is the feature here."""
    return views.table(spark, sf_dir, "documents").select("doc_id", values.clean_value("text", fixed.MAX_VALUE_BYTES).alias("value"))


@query(
    """WITH v AS (SELECT o_orderkey, o_totalprice AS x FROM orders UNION ALL SELECT o_orderkey, o_totalprice / 7 FROM orders
                  UNION ALL SELECT o_orderkey, floor(o_totalprice) FROM orders)
    SELECT o_orderkey, x, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR)
           ELSE rtrim(rtrim(printf('%.4f', x), '0'), '.') END AS text FROM v"""
)
def format_number(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.explode(F.array("o_totalprice", F.col("o_totalprice") / 7, F.floor("o_totalprice").cast("double"))).alias("x"))
    return o.select("o_orderkey", "x", values.format_number("x").alias("text"))


@query(
    """WITH v AS (SELECT event_id, unnest([strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m-%dT%H:%M:%S'),
                    strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00',
                    CAST(value AS VARCHAR), event_type]) AS t,
                  unnest(['date', 'date', 'date', 'date', 'number', 'number']) AS kind FROM events)
    SELECT event_id, t, kind, CASE WHEN kind = 'number' THEN TRY_CAST(t AS DOUBLE)
      ELSE CAST(floor(epoch(CAST(CASE WHEN length(t) <= 19 THEN t || CASE WHEN length(t) = 10 THEN 'T00:00:00' ELSE '' END || '+00:00'
                        ELSE replace(t, 'Z', '+00:00') END AS TIMESTAMPTZ))) AS DOUBLE) END AS num FROM v"""
)
def parse_numeric_value(spark, sf_dir):
    ts = F.col("ts")
    pairs = F.explode(F.arrays_zip(
        F.array(F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
                F.col("value").cast("string"), F.col("event_type")).alias("t"),
        F.array(*[F.lit(k) for k in ("date", "date", "date", "date", "number", "number")]).alias("kind"))).alias("p")
    v = views.table(spark, sf_dir, "events").select("event_id", pairs).select("event_id", "p.*")
    return v.select("event_id", "t", "kind", values.parse_numeric_value("t", "kind").alias("num"))


@query(
    with_views("file_meta", v="""SELECT path, key, unnest([key || op || value, ' ' || key || ' ' || op || ' a' || op || value || ' ',
               upper(key) || op || value, key || op || ' ', value]) AS t
               FROM file_meta, (SELECT unnest(['=', '!=', '>=', '<', '~']) AS op)""")
    + r"""SELECT path, key, t, nullif(regexp_extract(t, '(?s)^\s*([a-z]+(?:\.[A-Za-z]+)?)\s*(>=|<=|!=|=|~|>|<)\s*(.*\S)\s*$', 1), '') AS fkey,
        nullif(regexp_extract(t, '(?s)^\s*([a-z]+(?:\.[A-Za-z]+)?)\s*(>=|<=|!=|=|~|>|<)\s*(.*\S)\s*$', 2), '') AS fop,
        nullif(regexp_extract(t, '(?s)^\s*([a-z]+(?:\.[A-Za-z]+)?)\s*(>=|<=|!=|=|~|>|<)\s*(.*\S)\s*$', 3), '') AS fvalue FROM v"""
)
def parse_filter(spark, sf_dir):
    op = F.explode(F.array(*[F.lit(o) for o in ("=", "!=", ">=", "<", "~")]))
    m = views.file_meta(spark, sf_dir).select("path", "key", "value", op.alias("op"))
    t = F.explode(F.array(
        F.concat("key", "op", "value"), F.concat(F.lit(" "), "key", F.lit(" "), "op", F.lit(" a"), "op", "value", F.lit(" ")),
        F.concat(F.upper("key"), "op", "value"), F.concat("key", "op", F.lit(" ")), F.col("value")))
    v = m.select("path", "key", t.alias("t")).withColumn("f", values.parse_filter("t"))
    return v.select("path", "key", "t", F.col("f.key").alias("fkey"), F.col("f.op").alias("fop"), F.col("f.value").alias("fvalue"))


_UNITS_SQL = "(VALUES " + ", ".join(f"('{u}', {m})" for u, m in fixed.BYTE_UNITS.items()) + ") u(unit, mult)"


@query(
    f"""WITH b AS (SELECT p_partkey, unit, CAST(p_size AS VARCHAR) || '.5' AS value,
                    CAST(floor((p_size + 0.5) * mult + 0.5) AS BIGINT) AS bytes, p_size * mult AS whole
                   FROM part, {_UNITS_SQL})
    SELECT p_partkey, unit, value, bytes,
      (SELECT CAST(CAST(whole / mult AS BIGINT) AS VARCHAR) || ' ' || unit FROM {_UNITS_SQL}
       WHERE whole >= mult AND whole % mult = 0 ORDER BY mult DESC LIMIT 1) AS split FROM b"""
)
def bytes_of(spark, sf_dir):
    unit = F.explode(F.array(*[F.lit(u) for u in fixed.BYTE_UNITS]))
    b = views.table(spark, sf_dir, "part").select("p_partkey", "p_size", unit.alias("unit"),
                                                   F.concat(F.col("p_size").cast("string"), F.lit(".5")).alias("value"))
    split = values.split_bytes(values.bytes_of(F.col("p_size").cast("string"), "unit"))
    return b.select("p_partkey", "unit", "value", values.bytes_of("value", "unit").alias("bytes"),
                    F.concat_ws(" ", split["value"], split["unit"]).alias("split"))


@query(
    """WITH v AS (SELECT event_id, unnest([strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y') || CAST(user_id AS VARCHAR),
                    CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%m'), event_type]) AS t FROM events)
    SELECT event_id, t, CAST(CASE WHEN regexp_matches(t, '^[12][0-9]{3}([^0-9]|$)') THEN substr(t, 1, 4) ELSE '0' END AS BIGINT) AS year,
      CAST(coalesce(nullif(regexp_extract(t, '^([0-9]{1,9})', 1), ''), '0') AS BIGINT) AS leading FROM v"""
)
def year_of(spark, sf_dir):
    ts = F.col("ts")
    t = F.explode(F.array(F.date_format(ts, "yyyy-MM-dd"), F.concat(F.date_format(ts, "yyyy"), F.col("user_id").cast("string")),
                          F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format(ts, "MM")), F.col("event_type")))
    v = views.table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return v.select("event_id", "t", values.year_of("t").alias("year"), values.leading_int("t").alias("leading"))


@query(
    """WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, CASE WHEN l_linestatus = 'O' THEN 'size' ELSE 'mtime' END AS key,
          CASE l_linenumber WHEN 1 THEN '>' WHEN 2 THEN '<' WHEN 3 THEN '>=' WHEN 4 THEN '<=' WHEN 5 THEN '=' ELSE '>' END AS op,
          CAST(l_quantity AS BIGINT) AS v FROM lineitem)
    SELECT request_id,
      max(CASE WHEN key = 'size' AND op = '>' THEN v + 1 WHEN key = 'size' AND op IN ('>=', '=') THEN v END) AS min_size,
      min(CASE WHEN key = 'size' AND op = '<' THEN greatest(0, v - 1) WHEN key = 'size' AND op IN ('<=', '=') THEN v END) AS max_size,
      max(CASE WHEN key = 'mtime' AND op = '>' THEN v END) AS after, min(CASE WHEN key = 'mtime' AND op = '<' THEN v END) AS before
    FROM c GROUP BY request_id"""
)
def merge_conditions(spark, sf_dir):
    n = F.col("l_linenumber")
    op = F.when(n == 1, ">").when(n == 2, "<").when(n == 3, ">=").when(n == 4, "<=").when(n == 5, "=").otherwise(">")
    c = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"),
        F.when(F.col("l_linestatus") == "O", "size").otherwise("mtime").alias("key"), op.alias("op"),
        F.col("l_quantity").cast("long").alias("value"))
    return filters.merge_conditions(c)


# --- tokens and text --------------------------------------------------------------------------------------

@query(
    with_views("files") + r"""SELECT path, unnest(regexp_extract_all(strip_accents(lower(name || '/' || dir)), '[\p{L}\p{N}._-]+')) AS token FROM files"""
)
def tokenize_names(spark, sf_dir):
    f = views.scan(spark, sf_dir)
    return f.select("path", F.explode(text.tokenize_names(F.concat("name", F.lit("/"), "dir"))).alias("token"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS token FROM documents)
    SELECT doc_id, token, count(*) AS n FROM t GROUP BY doc_id, token"""
)
def tokenize_body(spark, sf_dir):
    t = views.table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(text.tokenize_body("text")).alias("token")).where("token IS NOT NULL")
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


_QUERY_TEXT = """SELECT item_id, split_part(text, ' ', 1) || ' AND "' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)
                 || '"tail ** ' || split_part(text, ' ', 4) || ' "open ' || split_part(text, ' ', 5) AS q FROM benchmark"""


@query(
    r"""WITH q AS (""" + _QUERY_TEXT + r""")
    , pieces AS (SELECT item_id, q, unnest(string_split(q, '"')) AS piece, generate_subscripts(string_split(q, '"'), 1) AS i FROM q)
    , parts AS (SELECT item_id, q, 'phrase' AS kind, piece AS text FROM pieces WHERE i % 2 = 0
      UNION ALL SELECT item_id, q, 'term', unnest(regexp_split_to_array(piece, '\s+')) FROM pieces WHERE i % 2 = 1)
    SELECT item_id, q, kind, text FROM parts WHERE regexp_matches(text, '[\p{L}\p{Nd}]')
      AND NOT (kind = 'term' AND text IN ('AND', 'OR', 'NOT', 'NEAR'))"""
)
def split_query(spark, sf_dir):
    def word(i):
        return F.split_part("text", F.lit(" "), F.lit(i))

    q = views.table(spark, sf_dir, "benchmark").select("item_id", F.concat(
        word(1), F.lit(' AND "'), word(2), F.lit(" "), word(3), F.lit('"tail ** '), word(4), F.lit(' "open '), word(5)).alias("q"))
    return q.select("item_id", "q", F.explode(text.split_query("q")).alias("p")).select("item_id", "q", "p.*")


@query(
    r"""SELECT doc_id, regexp_replace(text, '[\x00\x02\x03]', '', 'g') AS body FROM documents"""
)
def extract_text(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    return views.table(spark, sf_dir, "documents").select("doc_id", text.extract_text(raw).alias("body"))


@query(
    """SELECT doc_id, 'utf-8' AS encoding_utf8, 'utf-8' AS encoding_cut, 'utf-16le' AS encoding_utf16,
         CASE WHEN strlen(text) = length(text) THEN 'utf-8' ELSE 'windows-1252' END AS encoding_latin FROM documents
       WHERE length(text) > 0"""
)
def detect_encoding(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").where(F.length("text") > 0)
    raw = F.encode("text", "UTF-8")
    cut = F.concat(raw, F.unhex(F.lit("E282")))
    wide = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    # Latin-1 bytes: each two-byte letter loses its lead byte, which UTF-8 rejects.
    latin = F.concat(F.unhex(F.when(F.octet_length("text") == F.length("text"), F.lit("")).otherwise(F.lit("E965"))), raw)
    return d.select("doc_id", text.detect_encoding(raw).alias("encoding_utf8"), text.detect_encoding(cut).alias("encoding_cut"),
                    text.detect_encoding(wide).alias("encoding_utf16"), text.detect_encoding(latin).alias("encoding_latin"))
