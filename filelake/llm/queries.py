"""The registered queries of this folder and the SQL that some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelake.llm import (
    common, edits, jaccard, licenses, packing, personal_data, quality, ranking, repeats, secret_spans, token_files, transducer, url_list, variants,
)
from filelake.llm.encoding import default_tokenizer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# Host and path rules of op6, in the order given.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block")]


@register
def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.against_edits(common.documents(spark, sf_dir))


@register
def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register
def op3_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "tokens")
    token_files.write_tokens(common.documents(spark, sf_dir), path, default_tokenizer())
    return token_files.read_index(spark, path)


@register
def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(common.documents(spark, sf_dir))


@register
def op5_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.find(common.documents(spark, sf_dir))


@register
def op6_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every page of a host that has a label beginning with ``spam``."""
    common.ready(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    spam = pages.where(url_list.host_of(F.col("url")).rlike(r"(^|\.)spam"))
    return url_list.judge(pages, spam.select(url_list.canonical(F.col("url")).alias("key")), RULES)


ORACLES["op6_url_bloom"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), c AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/+|\.html)$', '') END AS canonical
  FROM q
), listed AS (
  SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND regexp_matches(host, '(^|\.)spam')
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


@register
def op7_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.round_trip(common.documents(spark, sf_dir), transducer.default_model())


@register
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), default_tokenizer())


@register
def op9_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.documents(spark, sf_dir))


@register
def op10_jaccard_divideskip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(common.documents(spark, sf_dir))


ORACLES["op10_jaccard_divideskip"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = d.doc_id
"""


@register
def op11_prefix_suffix_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(common.documents(spark, sf_dir))


# The crc32 goes through the hexadecimal digits of the bytes, low digit first, with the table of 16 remainders.
ORACLES["op11_prefix_suffix_variants"] = r"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2
), hashed AS (
  SELECT run, k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h)),
    lambda i: (strpos('0123456789ABCDEF', h[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) - 1)::BIGINT), lambda c, x: xor(c >> 4,
    ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
     3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(c, x) & 15) + 1])), 4294967295) AS crc
  FROM (SELECT run, k, hex(doc_id || ':' || run) AS h FROM runs)
), words AS MATERIALIZED (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT word, other, other_n FROM (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word)
), best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN top END AS form_n,
    CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.other_n = top) END AS form
  FROM words w LEFT JOIN best b ON b.word = w.word
), chain AS (
  SELECT word, word AS at FROM words UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.at AND g.form IS NULL
"""


@register
def op12_hybrid_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranking.build_index(common.documents(spark, sf_dir))
    return ranking.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_hybrid_ranked_search"] = r"""
WITH terms AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL
), sizes AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(t.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM terms, total t GROUP BY term),
docs AS (SELECT doc_id, 100 - 50 + (50 * s.n * t.n) // t.l AS m FROM sizes s, total t),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN terms USING (term) JOIN docs USING (doc_id) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""


@register
def op13_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op13_suffix_tree_repeats"] = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w)
), least AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
gone AS MATERIALIZED (
  SELECT DISTINCT doc_id, p + k AS q FROM s JOIN least USING (g) CROSS JOIN (SELECT unnest(range(0, 13)) AS k) WHERE least < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM w) ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
