"""Full-text search: requests derived from the benchmark passages, run as one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as search_ops
from ..operators import textindex
from ..session import staged
from . import views
from .filter_queries import META_SCHEMA, search_tables
from .registry import query
from .sql import with_views


def text_requests(spark, sf_dir):
    """Five requests per passage: words, a phrase with a word, a file-name fragment, a filtered one, a single word."""
    def word(i):
        return F.split_part(F.regexp_replace("text", r"\s+", " "), F.lit(" "), F.lit(i))

    def request(kind, q, mode, exts, sort, direction, limit, offset):
        return F.struct(
            F.concat(F.lit(kind), F.col("item_id").cast("string")).alias("request_id"), q.alias("q"), F.lit(mode).alias("mode"),
            exts.cast("array<string>").alias("exts"), F.lit(sort).alias("sort"), F.lit(direction).alias("dir"),
            F.lit(limit).cast("long").alias("limit"), F.lit(offset).cast("long").alias("offset"))

    none = F.array()
    kinds = F.array(
        request("w", F.concat_ws(" ", word(1), word(2)), "both", none, "", "", 10, 0),
        request("p", F.concat(F.lit('"'), word(3), F.lit(" "), word(4), F.lit('" '), F.substring(word(2), 1, 2)), "content", none,
                "relevance", "desc", 10, 5),
        request("n", F.concat(F.substring(word(1), 2, 3), F.lit(" _1")), "name", none, "", "", 10, 0),
        request("f", F.substring(word(1), 1, 3), "both", F.array(F.lit("txt"), F.lit(".MD")), "size", "desc", 10, 0),
        request("o", F.concat(F.substring(word(5), 1, 4), F.lit(" AND")), "both", none, "name", "asc", 10, 10),
    )
    r = views.table(spark, sf_dir, "benchmark").select("item_id", F.explode(kinds).alias("r")).select("r.*")
    return r.select(
        "request_id", "q", "mode", F.lit(None).cast("string").alias("path"), "exts", F.lit(-1).cast("long").alias("min_size"),
        F.lit(-1).cast("long").alias("max_size"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("before"),
        F.array().cast(META_SCHEMA).alias("meta"), "sort", "dir", "limit", "offset")


_W = "split_part(regexp_replace(text, '\\s+', ' ', 'g'), ' ', {})"
REQUESTS_SQL = f"""
    SELECT 'w' || CAST(item_id AS VARCHAR) AS request_id, 'w' AS kind, {_W.format(1)} || ' ' || {_W.format(2)} AS q, 'both' AS mode FROM benchmark
    UNION ALL SELECT 'p' || CAST(item_id AS VARCHAR), 'p', '"' || {_W.format(3)} || ' ' || {_W.format(4)} || '" ' || substr({_W.format(2)}, 1, 2), 'content' FROM benchmark
    UNION ALL SELECT 'n' || CAST(item_id AS VARCHAR), 'n', substr({_W.format(1)}, 2, 3) || ' _1', 'name' FROM benchmark
    UNION ALL SELECT 'f' || CAST(item_id AS VARCHAR), 'f', substr({_W.format(1)}, 1, 3), 'both' FROM benchmark
    UNION ALL SELECT 'o' || CAST(item_id AS VARCHAR), 'o', substr({_W.format(5)}, 1, 4) || ' AND', 'both' FROM benchmark"""

PARTS_SQL = r"""
    SELECT request_id, kind, text, row_number() OVER (PARTITION BY request_id) AS part_no,
           count(*) OVER (PARTITION BY request_id) AS n_parts FROM (
      SELECT request_id, 'phrase' AS kind, piece AS text FROM pieces WHERE i % 2 = 0
      UNION ALL SELECT request_id, 'term', unnest(regexp_split_to_array(piece, '\s+')) FROM pieces WHERE i % 2 = 1)
    WHERE regexp_matches(text, '[\p{L}\p{Nd}]') AND NOT (kind = 'term' AND text IN ('AND', 'OR', 'NOT', 'NEAR'))"""

SEARCH_CTES = dict(
    requests=REQUESTS_SQL,
    pieces="SELECT request_id, unnest(string_split(q, '\"')) AS piece, generate_subscripts(string_split(q, '\"'), 1) AS i FROM requests",
    parts=PARTS_SQL,
    docs=r"""SELECT 'bodies' AS corpus, path, regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+') AS t, []::VARCHAR[] AS d FROM content
        UNION ALL SELECT 'names', path, regexp_extract_all(strip_accents(lower(name)), '[\p{L}\p{N}._-]+'),
          regexp_extract_all(strip_accents(lower(dir)), '[\p{L}\p{N}._-]+') FROM files""",
    post="""SELECT corpus, CASE corpus WHEN 'names' THEN 'name' ELSE 'body' END AS field, CASE corpus WHEN 'names' THEN 10.0 ELSE 1.0 END AS w,
          path, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos, len(t) + len(d) AS doc_len FROM docs
        UNION ALL SELECT corpus, 'dir', 1.0, path, unnest(d), generate_subscripts(d, 1) - 1, len(t) + len(d) FROM docs""",
    corpus_stats="SELECT corpus, count(*) AS n_docs, sum(len(t) + len(d)) AS total_len FROM docs GROUP BY corpus",
    tok=r"""SELECT *, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS idx, len(tokens) AS k FROM (
          SELECT request_id, part_no, kind, 'bodies' AS corpus, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS tokens FROM parts
          UNION ALL SELECT request_id, part_no, kind, 'names', regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}._-]+') FROM parts)""",
    vocab="SELECT corpus, term, count(DISTINCT path) AS df FROM post GROUP BY corpus, term",
    expanded="""SELECT request_id, part_no, corpus, k, idx, token AS term FROM tok WHERE NOT (kind = 'term' AND idx = k - 1)
        UNION ALL SELECT t.request_id, t.part_no, t.corpus, k, idx, v.term FROM tok t JOIN vocab v ON t.corpus = v.corpus AND starts_with(v.term, t.token)
          WHERE kind = 'term' AND idx = k - 1""",
    inst="""SELECT request_id, part_no, corpus, path, field, w, doc_len, pos - idx AS start FROM expanded e JOIN post p USING (corpus, term)
        GROUP BY request_id, part_no, corpus, path, field, w, doc_len, pos - idx, k HAVING count(DISTINCT idx) = k""",
    part_hits="SELECT request_id, part_no, corpus, path, doc_len, sum(w) AS f FROM inst GROUP BY request_id, part_no, corpus, path, doc_len",
    part_df="SELECT request_id, part_no, corpus, count(*) AS n FROM part_hits GROUP BY request_id, part_no, corpus",
    scored="""SELECT h.request_id, h.part_no, h.corpus, h.path, h.f,
          greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / (total_len / n_docs))) AS score
        FROM part_hits h JOIN part_df USING (request_id, part_no, corpus) JOIN corpus_stats USING (corpus)""",
    text_hits="""SELECT s.request_id, s.corpus, s.path, round(sum(s.score), 9) AS score FROM scored s
        JOIN (SELECT DISTINCT request_id, n_parts FROM parts) USING (request_id)
        GROUP BY s.request_id, s.corpus, s.path, n_parts HAVING count(*) = n_parts""",
    passed="""SELECT t.request_id, t.corpus, t.score, f.path, f.name, f.size, f.mtime, r.kind, r.mode FROM text_hits t JOIN files f USING (path)
        JOIN requests r USING (request_id) WHERE r.kind <> 'f' OR f.ext IN ('txt', 'md')""",
    by_name="SELECT * FROM passed WHERE corpus = 'names' AND mode <> 'content'",
    by_body="SELECT * FROM passed WHERE corpus = 'bodies' AND mode <> 'name'",
    unnamed="""SELECT * FROM requests r WHERE mode <> 'content' AND request_id NOT IN (SELECT request_id FROM by_name)
          AND request_id NOT IN (SELECT request_id FROM parts WHERE length(text) < 3)""",
    wanted="SELECT DISTINCT lower(p.text) AS piece FROM parts p JOIN unnamed USING (request_id)",
    holding="SELECT w.piece, f.path FROM wanted w JOIN files f ON contains(lower(f.name), w.piece)",
    fallback="""SELECT r.request_id, 'names' AS corpus, 0.1 AS score, f.path, f.name, f.size, f.mtime, r.kind, r.mode
        FROM (SELECT p.request_id, h.path FROM parts p JOIN holding h ON h.piece = lower(p.text)
              GROUP BY p.request_id, h.path, p.n_parts HAVING count(DISTINCT p.part_no) = p.n_parts)
        JOIN unnamed r USING (request_id) JOIN files f USING (path) WHERE r.kind <> 'f' OR f.ext IN ('txt', 'md')""",
    names="SELECT *, false AS fb FROM by_name UNION ALL SELECT *, true FROM fallback",
    merged="""SELECT coalesce(n.request_id, b.request_id) AS request_id, coalesce(n.path, b.path) AS path, coalesce(n.name, b.name) AS name,
          coalesce(n.size, b.size) AS size, coalesce(n.kind, b.kind) AS kind, greatest(n.score, b.score) AS score,
          CASE WHEN n.path IS NULL THEN 'content' ELSE 'name' END AS matched_in, coalesce(n.fb, false) AS fb, b.path IS NOT NULL AS in_content
        FROM names n FULL OUTER JOIN by_body b ON n.request_id = b.request_id AND n.path = b.path""",
    ranked="""SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY
          CASE WHEN kind IN ('w', 'p', 'n') THEN score END DESC NULLS LAST,
          CASE WHEN kind IN ('w', 'p', 'n') THEN matched_in = 'content' END NULLS LAST,
          CASE WHEN kind = 'f' THEN size END DESC NULLS LAST, CASE WHEN kind = 'f' THEN path END DESC NULLS LAST,
          CASE WHEN kind = 'o' THEN lower(name) END NULLS LAST,
          CASE WHEN kind IN ('w', 'p', 'n') AND fb AND NOT any_body THEN name END NULLS LAST, path) AS rank
        FROM (SELECT *, bool_or(in_content) OVER (PARTITION BY request_id) AS any_body FROM merged)""",
)


def search_sql(last: str) -> str:
    """WITH clause up to and including the named step."""
    upto = {}
    for name, sql in SEARCH_CTES.items():
        upto[name] = sql
        if name == last:
            break
    return with_views("files", "content", **upto)


@query(search_sql("post") + """SELECT corpus, field, term, path, doc_len, count(*) AS tf, min(pos) AS first_pos, sum(pos) AS pos_sum
       FROM post GROUP BY corpus, field, term, path, doc_len""")
def build_text_index(spark, sf_dir):
    p = textindex.build_text_index(views.scan(spark, sf_dir), views.content(spark, sf_dir)).postings
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("corpus", "field", "term", "path", F.col("doc_len").cast("long").alias("doc_len"),
                    F.size("positions").cast("long").alias("tf"), F.col("positions")[0].cast("long").alias("first_pos"), total.alias("pos_sum"))


@query(search_sql("vocab") + "SELECT corpus, term, df FROM vocab")
def vocabulary(spark, sf_dir):
    return views.index(spark, sf_dir).vocab


@query(search_sql("corpus_stats") + "SELECT corpus, n_docs, CAST(total_len AS BIGINT) AS total_len FROM corpus_stats")
def corpus_stats(spark, sf_dir):
    return views.index(spark, sf_dir).corpus_stats.select("corpus", "n_docs", "total_len")


@query(search_sql("expanded") + "SELECT DISTINCT corpus, k, idx, term FROM expanded")
def expand_terms(spark, sf_dir):
    r, index = text_requests(spark, sf_dir), views.index(spark, sf_dir)
    parts = search_ops.query_parts(r, textindex.NAMES).unionByName(search_ops.query_parts(r, textindex.BODIES))
    return search_ops.expand_terms(parts, index.vocab).select("corpus", F.col("k").cast("long").alias("k"), F.col("idx").cast("long").alias("idx"), "term").distinct()


def _requested_matches(spark, sf_dir, corpus, kind=None):
    parts = search_ops.query_parts(text_requests(spark, sf_dir), corpus)
    parts = parts.where(F.col("kind") == kind) if kind else parts
    matches = search_ops.match_parts(parts, views.index(spark, sf_dir))
    return parts.select("request_id", "corpus", "part_key").join(matches, ["corpus", "part_key"])


@query(search_sql("part_hits") + """SELECT h.request_id, h.corpus, h.path, CAST(f AS DOUBLE) AS freq FROM part_hits h
       JOIN parts p USING (request_id, part_no) WHERE p.kind = 'term'""")
def match_terms(spark, sf_dir):
    cols = ("request_id", "corpus", "path", "freq")
    return _requested_matches(spark, sf_dir, textindex.NAMES, "term").select(*cols).unionByName(
        _requested_matches(spark, sf_dir, textindex.BODIES, "term").select(*cols))


@query(search_sql("part_hits") + """SELECT h.request_id, h.path, CAST(f AS DOUBLE) AS freq FROM part_hits h
       JOIN parts p USING (request_id, part_no) WHERE p.kind = 'phrase' AND h.corpus = 'bodies'""")
def match_phrase(spark, sf_dir):
    parts = search_ops.query_parts(text_requests(spark, sf_dir), textindex.BODIES)
    hits = search_ops.match_phrase(parts, views.index(spark, sf_dir))
    return parts.select("request_id", "part_key").join(hits, "part_key").select("request_id", "path", "freq")


@query(search_sql("text_hits") + "SELECT request_id, corpus, path, round(score, 4) AS score FROM text_hits")
def bm25(spark, sf_dir):
    r, index = text_requests(spark, sf_dir), views.index(spark, sf_dir)
    parts = [search_ops.text_hits(r, index, c).withColumn("corpus", F.lit(c)) for c in (textindex.NAMES, textindex.BODIES)]
    return parts[0].unionByName(parts[1]).select("request_id", "corpus", "path", F.round("score", 4).alias("score"))


@query(search_sql("fallback") + "SELECT request_id, path, name FROM fallback")
def substring_fallback(spark, sf_dir):
    tables = search_tables(spark, sf_dir)
    good = staged(search_ops.valid_requests(text_requests(spark, sf_dir), tables)[0], "requests")
    texts = good.where("has_text AND mode <> 'content'")
    missing = texts.join(search_ops.name_search(texts, tables), "request_id", "left_anti")
    return search_ops.substring_fallback(missing, tables).select("request_id", "path", "name")


@query(search_sql("by_body") + "SELECT request_id, path, round(score, 4) AS score FROM by_body")
def content_search(spark, sf_dir):
    tables = search_tables(spark, sf_dir)
    good, _ = search_ops.valid_requests(text_requests(spark, sf_dir), tables)
    return search_ops.content_search(good.where("mode <> 'name'"), tables).select("request_id", "path", F.round("score", 4).alias("score"))


@query(search_sql("merged") + "SELECT request_id, path, round(score, 4) AS score, matched_in, in_content FROM merged")
def merge_both(spark, sf_dir):
    tables = search_tables(spark, sf_dir)
    good, _ = search_ops.valid_requests(text_requests(spark, sf_dir), tables)
    return search_ops.all_hits(good, tables).select("request_id", "path", F.round("score", 4).alias("score"), "matched_in", "in_content")


@query(search_sql("merged") + """SELECT r.request_id, count(DISTINCT m.path) AS total FROM requests r LEFT JOIN merged m USING (request_id)
       GROUP BY r.request_id""")
def count_matches(spark, sf_dir):
    return search_ops.search(text_requests(spark, sf_dir), search_tables(spark, sf_dir), with_snippets=False).totals


@query(search_sql("ranked") + """SELECT request_id, rank, path, name, size, round(score, 4) AS score, matched_in FROM ranked
       WHERE rank > CASE kind WHEN 'p' THEN 5 WHEN 'o' THEN 10 ELSE 0 END AND rank <= CASE kind WHEN 'p' THEN 15 WHEN 'o' THEN 20 ELSE 10 END""")
def search_batch(spark, sf_dir):
    """All text requests at once: match, score, filter, fall back, merge, sort and page."""
    hits = search_ops.search(text_requests(spark, sf_dir), search_tables(spark, sf_dir), with_snippets=False).hits
    return hits.select("request_id", "rank", "path", "name", "size", F.round("score", 4).alias("score"), "matched_in")


# Words, a path to clean, size bounds and a metadata filter in one request.
_IN_SCOPE = """SELECT f.path FROM files f WHERE (f.dir = '/lake/docs/src1' OR f.dir LIKE '/lake/docs/src1/%') AND f.size BETWEEN 300 AND 20000
    AND f.path IN (SELECT path FROM file_meta WHERE key = 'doc.lang' AND lower(value) = 'en')"""
COMBINED_CTES = {
    "requests": f"SELECT 'c' || CAST(item_id AS VARCHAR) AS request_id, 'c' AS kind, substr({_W.format(1)}, 1, 3) AS q, 'both' AS mode FROM benchmark",
    "in_scope": _IN_SCOPE,
    **{name: sql for name, sql in SEARCH_CTES.items() if name not in ("requests", "ranked")},
}
for _step in ("passed", "fallback"):
    _joins, _where, _rule = COMBINED_CTES[_step].rpartition("WHERE ")
    COMBINED_CTES[_step] = f"{_joins}WHERE ({_rule}) AND f.path IN (SELECT path FROM in_scope)"


@query(with_views("files", "content", "file_meta", **COMBINED_CTES)
       + "SELECT request_id, path, round(score, 4) AS score, matched_in, in_content FROM merged")
def combined_search(spark, sf_dir):
    """Text together with scope, size bounds and metadata."""
    none = F.lit(None)
    r = views.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("request_id"),
        F.substring(F.split_part(F.regexp_replace("text", r"\s+", " "), F.lit(" "), F.lit(1)), 1, 3).alias("q"), F.lit("both").alias("mode"),
        F.lit("/lake/docs/src1/").alias("path"), F.array().cast("array<string>").alias("exts"), F.lit(300).cast("long").alias("min_size"),
        F.lit(20000).cast("long").alias("max_size"), F.lit(0).cast("long").alias("after"), F.lit(0).cast("long").alias("before"),
        F.array(F.struct(F.lit("doc.lang").alias("key"), F.lit("=").alias("op"), F.lit("en").alias("value"))).cast(META_SCHEMA).alias("meta"),
        F.lit("").alias("sort"), F.lit("").alias("dir"), none.cast("long").alias("limit"), none.cast("long").alias("offset"))
    tables = search_tables(spark, sf_dir)
    good, _ = search_ops.valid_requests(r, tables)
    return search_ops.all_hits(good, tables).select("request_id", "path", F.round("score", 4).alias("score"), "matched_in", "in_content")


@query()
def search_snippets(spark, sf_dir):
    """The same pages with rendered snippets; their shape is tested on small fixtures."""
    hits = search_ops.search(text_requests(spark, sf_dir), search_tables(spark, sf_dir)).hits
    return hits.where("in_content").select("request_id", "rank", "path", "snippet")
