"""Answering a table of search requests with joins and aggregates over the text index."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, paths, snippets, text
from ..session import staged, staged_path
from ..sources import bucketed
from . import filters, gram_index, meta_filters
from .textindex import BODIES, NAMES, TextIndex, term_head

FIELD_WEIGHTS = {"name": fixed.NAME_WEIGHT, "dir": fixed.DIR_WEIGHT, "body": 1.0}
HIT_COLUMNS = ("request_id", "path", "name", "ext", "size", "mtime", "score", "matched_in", "fallback")
_EXACT = "="  # no token holds it
_FEW_TOKENS = 200_000  # that many go to every task, more are shuffled with the postings
ENTRY_COLUMNS = ("path", "name", "dir", "ext", "size", "mtime", "mimeclass")


@dataclass(frozen=True)
class SearchTables:
    """What a search reads: catalogue, metadata, bodies, text index, field catalogue, and the pieces of names if they are stored."""

    files: DataFrame
    file_meta: DataFrame
    content: DataFrame
    index: TextIndex
    fields: DataFrame
    grams: gram_index.GramIndex | None = None


@dataclass(frozen=True)
class SearchResult:
    """One page of ranked hits per request, the exact totals, and the requests that could not run."""

    hits: DataFrame
    totals: DataFrame
    errors: DataFrame


# --- parts and terms --------------------------------------------------------------------------------------

def query_parts(requests: DataFrame, corpus: str) -> DataFrame:
    """One row per part of each request, tokenised as the corpus is: ``request_id, corpus, n_parts, part_key,
    kind, tokens``. Equal parts share a key, whatever request they come from."""
    tokenize = text.tokenize_names if corpus == NAMES else text.tokenize_body
    parts = requests.select("request_id", text.split_query("q").alias("parts")).select(
        "request_id", F.size("parts").alias("n_parts"), F.explode("parts").alias("p")
    )
    tokens = tokenize("p.text")
    return parts.select(
        "request_id", F.lit(corpus).alias("corpus"), "n_parts", F.col("p.kind").alias("kind"), tokens.alias("tokens")
    ).withColumn("part_key", F.concat_ws(" ", "kind", F.array_join("tokens", " ")))


def distinct_parts(parts: DataFrame) -> DataFrame:
    return parts.select("corpus", "part_key", "kind", "tokens").dropDuplicates(["corpus", "part_key"])


def expand_terms(parts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Vocabulary terms behind each token: ``corpus, part_key, k, idx, term``.

    The last token of a bare term stands for every term it begins. Vocabulary terms are cut to the lengths that
    occur among those tokens and joined on equality, so no term is compared with tokens it does not begin with.
    """
    tokens = distinct_parts(parts).select(
        "corpus", "part_key", "kind", F.size("tokens").alias("k"), F.posexplode("tokens").alias("idx", "token")
    )
    is_prefix = (F.col("kind") == "term") & (F.col("idx") == F.col("k") - 1)
    exact = tokens.where(~is_prefix).select("corpus", "part_key", "k", "idx", F.col("token").alias("term"))
    prefixes = tokens.where(is_prefix)
    lengths = prefixes.agg(F.collect_set(F.length("token"))).scalar()
    heads = vocab.select(
        "corpus", "term", F.explode_outer(F.array_intersect(F.sequence(F.lit(1), F.length("term")), lengths)).alias("n")
    ).select("corpus", "term", F.substring("term", F.lit(1), F.col("n")).alias("token"))
    # Outer explodes throughout: the plain form would put the array into a filter of its own as well.
    begun = prefixes.join(heads, ["corpus", "token"]).select("corpus", "part_key", "k", "idx", "term")
    return exact.unionByName(begun)


def _starts(places: Column, field: str, k: Column) -> Column:
    """Positions in one field where the k tokens follow each other."""
    def shifted(i: Column) -> Column:
        mine = F.filter(places, lambda p: (p["field"] == field) & (p["idx"] == i))
        return F.transform(F.flatten(F.transform(mine, lambda p: p["positions"])), lambda x: x - i)

    return F.aggregate(F.sequence(F.lit(1), k - 1), shifted(F.lit(0)), lambda acc, i: F.array_intersect(acc, shifted(i)))


def _tokens(parts: DataFrame) -> DataFrame:
    """Every token of the distinct parts, with what a term is looked up by: the token itself for the last one of a bare term,
    which stands for all it begins, else the token and a mark."""
    begins = (F.col("kind") == "term") & (F.col("idx") == F.col("k") - 1)
    rows = distinct_parts(parts).select("corpus", "part_key", "kind", F.size("tokens").alias("k"), F.posexplode("tokens").alias("idx", "token"))
    return rows.select("corpus", "part_key", "k", "idx", F.when(begins, F.col("token")).otherwise(F.concat("token", F.lit(_EXACT))).alias("key"),
                       begins.alias("begins"), term_head("token").alias("head"), F.length("token").alias("n"))


def _met(tokens: DataFrame, index: TextIndex, phrases: bool) -> tuple[DataFrame | None, bool]:
    """Postings beside the tokens of single words, or of phrases, that they answer, and whether they stay in the slices of the
    index. Postings are looked up by their term and by its beginnings of the lengths that are asked for, so they stay where
    they are while the tokens, which are as many as the requests have, travel."""
    asked = tokens.where(F.col("k") > 1 if phrases else F.col("k") == 1)
    about = asked.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("begins"), F.col("n"))).alias("lengths"), F.collect_set("head").alias("heads"),
                      F.collect_set("corpus").alias("corpora"), F.bool_or(~F.col("begins")).alias("exact")).first()
    if not about["n"]:
        return None, bool(index.slices)
    term, whole = F.col("term"), [F.concat("term", F.lit(_EXACT))] if about["exact"] else []
    keys = whole + [F.when(F.length(term) >= n, F.substring(term, 1, n)) for n in sorted(about["lengths"])]
    # The outer explode keeps Catalyst from making the array a second time in a filter.
    key = F.explode_outer(F.array(*keys)) if len(keys) > 1 else keys[0]
    postings = index.postings.where(F.col("corpus").isin(about["corpora"]) & F.col("head").isin(about["heads"])).select(
        "corpus", "field", "path", "doc_len", "positions", key.alias("key"))
    few = about["n"] <= _FEW_TOKENS
    wanted = asked.select("corpus", "part_key", "k", "idx", "key")
    return postings.join(F.broadcast(wanted) if few else wanted, ["corpus", "key"]), bool(index.slices) and few


def match_parts(parts: DataFrame, index: TextIndex) -> DataFrame:
    """Files that hold each distinct part: ``corpus, part_key, path, doc_len, freq`` (frequency weighted by field).

    Single tokens add up by file. For phrases the positions of a file are brought together, a group no larger than that
    file, and intersected after shifting each token back by its place; a phrase stays within one field.
    """
    return _matches(parts, index)[0]


def _matches(parts: DataFrame, index: TextIndex) -> tuple[DataFrame, bool]:
    """The rows of ``match_parts``, and whether they lie in the slices of the index."""
    tokens = staged(_tokens(parts), "tokens")
    words, words_lie = _met(tokens, index, False)
    phrases, phrases_lie = _met(tokens, index, True)
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FIELD_WEIGHTS.items()])
    found = []
    if words is not None:
        found.append(words.groupBy("corpus", "part_key", "path", "doc_len").agg(F.sum(F.size("positions") * weight).alias("freq")))
    if phrases is not None:
        grouped = phrases.groupBy("corpus", "part_key", "path", "doc_len", "k").agg(F.collect_list(F.struct("field", "idx", "positions")).alias("places"))
        whole = grouped.where(F.size(F.array_distinct(F.transform("places", lambda p: p["idx"]))) == F.col("k"))
        freq = sum((F.size(_starts(F.col("places"), f, F.col("k"))) * F.lit(w) for f, w in FIELD_WEIGHTS.items()), F.lit(0.0))
        found.append(whole.select("corpus", "part_key", "path", "doc_len", freq.alias("freq")))
    if not found:
        none = index.postings.where(F.lit(False)).select("corpus", F.lit("").alias("part_key"), "path", "doc_len", F.lit(0.0).alias("freq"))
        return none, False
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.where(F.col("freq") > 0), words_lie and phrases_lie


def match_phrase(parts: DataFrame, index: TextIndex) -> DataFrame:
    """The phrase parts among the matches."""
    return match_parts(parts.where(F.col("kind") == "phrase"), index)


def bm25(matches: DataFrame, corpus_stats: DataFrame) -> DataFrame:
    """Adds ``score`` per (part, file). Document counts and mean length are those of the whole corpus.

    Scores are rounded to nine decimals so that equal documents tie exactly on every run. The counts are staged: they are as
    many as the parts, which Spark then sees.
    """
    df = matches.groupBy("corpus", "part_key").agg(F.count("*").alias("n"))
    stats = staged(df.join(corpus_stats, "corpus").select(
        "corpus", "part_key",
        F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6)).alias("idf"),
        (F.col("total_len") / F.col("n_docs")).alias("avg_len"),
    ), "part-stats")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    f = F.col("freq")
    norm = f + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len"))
    return matches.join(stats, ["corpus", "part_key"]).withColumn("score", F.col("idf") * f * (k1 + 1) / norm)


def _kept(matches: DataFrame, in_slices: bool, slices: int) -> DataFrame:
    """Matches written and read back, in the slices of the index if they lie in them."""
    if not in_slices:
        return staged(matches, "matches")
    spark = matches.sparkSession
    name = bucketed.create_table(spark, staged_path(spark, "matches"), matches.schema.toDDL(), slices, "path", ("corpus", "part_key", "path"))
    matches.write.insertInto(name)
    return spark.table(name)


def part_hits(parts: DataFrame, index: TextIndex) -> DataFrame:
    """Files that hold every part of a request, with the summed score: ``request_id, corpus, path, score``.

    The matches are staged, since counting them per part and scoring them both need them.
    """
    parts = staged(parts, "parts")
    matches = _kept(*_matches(parts, index), index.slices)
    scored = bm25(matches, index.corpus_stats)
    return (
        parts.select("request_id", "corpus", "part_key", "n_parts")
        .join(scored.select("corpus", "part_key", "path", "score"), ["corpus", "part_key"])
        .groupBy("request_id", "n_parts", "corpus", "path")
        .agg(F.count("*").alias("found"), F.round(F.sum("score"), 9).alias("score"))
        .where(F.col("found") == F.col("n_parts"))
        .select("request_id", "corpus", "path", "score")
    )


def text_hits(requests: DataFrame, index: TextIndex, corpus: str) -> DataFrame:
    """Matches of the requests in one corpus, before any filter."""
    return part_hits(query_parts(requests, corpus), index)


# --- branches ---------------------------------------------------------------------------------------------

def _prefixed(requests: DataFrame) -> DataFrame:
    keep = ("path", "exts", "min_size", "max_size", "after", "before", "meta")
    return requests.select("request_id", *[F.col(c).alias(f"r_{c}") for c in keep])


def _described(requests: DataFrame, found: DataFrame, tables: SearchTables) -> DataFrame:
    """``(request_id, path, score, matched_in, fallback)`` rows that pass the column filters, as hits."""
    return (
        found.join(tables.files.select(*ENTRY_COLUMNS), "path")
        .join(_prefixed(requests), "request_id").where(filters.column_filters()).select(*HIT_COLUMNS)
    )


def _meta_filtered(requests: DataFrame, hits: DataFrame, tables: SearchTables) -> DataFrame:
    return meta_filters.apply_meta_filters(requests, hits, tables.file_meta, tables.fields).select(*HIT_COLUMNS)


def _text_rows(requests: DataFrame, tables: SearchTables) -> DataFrame:
    """Filtered hits of all text requests in the corpora their mode asks for, in one pass over the postings."""
    parts = query_parts(requests.where(F.col("mode") != "content"), NAMES).unionByName(
        query_parts(requests.where(F.col("mode") != "name"), BODIES)
    )
    found = part_hits(parts, tables.index).select(
        "request_id", "path", "score", F.when(F.col("corpus") == NAMES, F.lit("name")).otherwise(F.lit("content")).alias("matched_in"),
        F.lit(False).alias("fallback"),
    )
    return _meta_filtered(requests, _described(requests, found, tables), tables)


def name_search(requests: DataFrame, tables: SearchTables) -> DataFrame:
    """Hits in file and directory names."""
    return _text_rows(requests.withColumn("mode", F.lit("name")), tables)


def content_search(requests: DataFrame, tables: SearchTables) -> DataFrame:
    """Hits in the bodies."""
    return _text_rows(requests.withColumn("mode", F.lit("content")), tables)


def _substring_rows(requests: DataFrame, tables: SearchTables) -> DataFrame:
    wanted = requests.select("request_id", F.transform(text.split_query("q"), lambda p: F.lower(p["text"])).alias("terms"))
    wanted = wanted.where(
        (F.size("terms") > 0) & F.forall("terms", lambda t: F.length(t) >= fixed.MIN_SUBSTRING_CHARS)
    ).withColumn("longest", F.array_max(F.transform("terms", lambda t: F.struct(F.length(t), t.alias("t"))))["t"])
    if tables.grams is not None:
        names = gram_index.holding(wanted.select("request_id", "terms"), tables.grams)
    else:
        keyed = wanted.select("request_id", "terms", F.substring("longest", 1, 3).alias("gram"))
        names = gram_index.gram_rows(tables.files).join(keyed, "gram").where(F.forall("terms", lambda t: F.col("low").contains(t)))
    found = names.select("request_id", "path", F.lit(fixed.SUBSTRING_SCORE).alias("score"), F.lit("name").alias("matched_in"),
                         F.lit(True).alias("fallback"))
    return _described(requests, found, tables)


def substring_fallback(requests: DataFrame, tables: SearchTables) -> DataFrame:
    """Files whose name contains every term of a request, for requests whose terms all have three characters.

    With stored pieces (``tables.grams``) a request reads the names of its rarest piece only. Without, names are cut on the
    fly and joined on the first three characters of the longest term. The full containment test follows on those rows.
    """
    return _meta_filtered(requests, _substring_rows(requests, tables), tables)


def _plain_rows(requests: DataFrame, tables: SearchTables) -> DataFrame:
    any_ext = F.lit("*")
    exts = F.transform("r_exts", lambda e: F.lower(F.regexp_replace(F.trim(e), r"^\.", "")))
    no_ext = F.col("r_exts").isNull() | (F.size("r_exts") == 0)
    scope = F.rtrim(F.coalesce("r_path", F.lit("")), F.lit("/"))
    keyed = _prefixed(requests).select(
        "*", F.when(scope == "", F.lit("/")).otherwise(scope).alias("scope"),
        F.explode(F.when(no_ext, F.array(any_ext)).otherwise(F.array_distinct(exts))).alias("ext_key"),
    )
    files = tables.files.select(*ENTRY_COLUMNS).withColumn("_ext", F.coalesce("ext", F.lit("")))
    folders = files.select("dir", "_ext").distinct()
    spread = folders.select("dir", "_ext", F.explode_outer(paths.ancestors("dir")).alias("scope")).select(
        "*", F.explode(F.array(any_ext, F.col("_ext"))).alias("ext_key"))
    asked = spread.join(keyed, ["scope", "ext_key"]).drop("scope", "ext_key")
    return (
        files.join(asked, ["dir", "_ext"]).where(filters.column_filters())
        .withColumns({"score": F.lit(0.0), "matched_in": F.lit("name"), "fallback": F.lit(False)}).select(*HIT_COLUMNS)
    )


def filter_only(requests: DataFrame, tables: SearchTables) -> DataFrame:
    """All files that pass the filters of requests without search text, scored 0.

    Requests meet the distinct (directory, extension) pairs, which are far fewer than files, on equal (scope, extension): a
    request has one scope and one row per extension (``*`` for any), a directory has its ancestors. Files then find the
    requests of their own directory and extension; ranges are tested on the joined rows.
    """
    return _meta_filtered(requests, _plain_rows(requests, tables), tables)


def merge_both(name_hits: DataFrame, content_hits: DataFrame) -> DataFrame:
    """One row per (request, path): the name hit wins and takes the better score; ``in_content`` marks bodies."""
    n, c = name_hits.alias("n"), content_hits.alias("c")

    def pick(col: str) -> Column:
        return F.coalesce(F.col(f"n.{col}"), F.col(f"c.{col}")).alias(col)

    joined = n.join(
        c, (F.col("n.request_id") == F.col("c.request_id")) & (F.col("n.path") == F.col("c.path")), "full_outer"
    )
    return joined.select(
        *[pick(col) for col in HIT_COLUMNS if col != "score"],
        F.greatest("n.score", "c.score").alias("score"), F.col("c.path").isNotNull().alias("in_content"),
    )


def count_matches(hits: DataFrame) -> DataFrame:
    """Exact distinct files per request."""
    return hits.groupBy("request_id").agg(
        F.count("*").alias("total"), F.sum(F.col("in_content").cast("long")).alias("n_content")
    )


# --- order and page ---------------------------------------------------------------------------------------

def sort_order(sort: str, direction: str = "asc") -> list[Column]:
    """Order of one listing of hits; relevance ignores the direction."""
    if sort == "relevance":
        return [F.desc("score"), F.asc(F.col("matched_in") == "content"), F.asc("path")]
    key = {"name": F.lower("name"), "size": F.col("size"), "mtime": F.col("mtime")}[sort]
    return [F.desc(key), F.desc("path")] if direction == "desc" else [F.asc(key), F.asc("path")]


def sort_and_page(hits: DataFrame, sort: str, direction: str = "asc", limit: int = 0, offset: int = 0,
                  max_window: int | None = None) -> DataFrame:
    """One page of one request: a single take-ordered step, never a full sort."""
    limit = fixed.DEFAULT_LIMIT if limit <= 0 else limit
    offset = max(offset, 0)
    if max_window is not None and offset + limit > max_window:
        raise ValueError(f"offset+limit must not exceed {max_window}")
    return hits.orderBy(*sort_order(sort, direction)).offset(offset).limit(limit)


def _batch_order() -> list[Column]:
    """Order that follows each row's ``sort`` and ``sort_dir``; unused keys are NULL within a request."""
    asc, desc = F.col("sort_dir") != "desc", F.col("sort_dir") == "desc"
    relevance = F.col("sort") == "relevance"
    number = F.when(F.col("sort") == "size", F.col("size")).when(F.col("sort") == "mtime", F.col("mtime"))
    word = F.when(F.col("sort") == "name", F.lower("name"))
    return [
        F.desc(F.when(relevance, F.col("score"))),
        F.asc(F.when(relevance, F.col("matched_in") == "content")),
        F.asc(F.when(asc, number)), F.desc(F.when(desc, number)),
        F.asc(F.when(asc, word)), F.desc(F.when(desc, word)),
        F.asc(F.when(relevance & F.col("by_name"), F.col("name"))),
        F.asc(F.when(relevance | asc, F.col("path"))), F.desc(F.when(~relevance & desc, F.col("path"))),
    ]


def page_batch(hits: DataFrame, salts: int | None = None, most: int | None = None) -> DataFrame:
    """The page of every request at once: rows need ``sort, sort_dir, limit, offset, by_name``.

    ``most`` is the largest ``offset+limit`` of the requests, if known: as a constant of the plan it lets each task
    cut its rows to that many per request and slice before anything is shuffled.

    A request may match a third of all files, so each request is first cut to its best ``offset+limit`` rows
    within hashed slices, and only those few rows meet in one group.
    """
    salts = salts or int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("offset") + F.col("limit")
    sliced = hits.withColumn("_slice", F.pmod(F.xxhash64("path"), F.lit(salts)))
    order = _batch_order()
    best = sliced.withColumn("_r", F.row_number().over(W.partitionBy("request_id", "_slice").orderBy(*order)))
    if most is not None:
        best = best.where(F.col("_r") <= most)
    best = best.where(F.col("_r") <= last).drop("_r", "_slice")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(*order)).cast("long"))
    return ranked.where((F.col("rank") > F.col("offset")) & (F.col("rank") <= last))


# --- snippets ---------------------------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def _cut_snippet(body: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([snippets.cut(b, [(p["kind"], list(p["tokens"])) for p in ps]) for b, ps in zip(body, parts)])


@F.pandas_udf(T.StringType())
def render_snippet(raw: pd.Series) -> pd.Series:
    """Marks between control characters to safe HTML of bounded length."""
    return raw.map(lambda s: snippets.render(s), na_action="ignore")


def add_snippets(page: DataFrame, requests: DataFrame, content: DataFrame) -> DataFrame:
    """Snippet of each page row found in a body; runs after paging, so only page rows reach Python."""
    parts = requests.select(
        "request_id",
        F.transform(text.split_query("q"), lambda p: F.struct(
            p["kind"].alias("kind"), text.tokenize_body(p["text"]).alias("tokens"))).alias("parts"),
    )
    needed = page.where("in_content").select("request_id", "path").join(parts, "request_id")
    made = (
        content.select("path", "body").join(needed, "path")
        .select("request_id", "path", render_snippet(_cut_snippet("body", "parts")).alias("snippet"))
    )
    return page.join(made, ["request_id", "path"], "left")


# --- the whole search -------------------------------------------------------------------------------------

def valid_requests(requests: DataFrame, tables: SearchTables, max_window: int | None = None,
                   max_filters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests that can run, with defaults filled in, and one error row for each of the others."""
    bad = filters.validate_requests(requests, max_window)
    bad = bad.unionByName(
        filters.validate_filters(requests, tables.fields, max_filters).join(bad, "request_id", "left_anti")
    )
    has_text = F.size(text.split_query("q")) > 0
    given = F.coalesce(F.nullif("sort", F.lit("")), F.lit("relevance"))
    good = (
        filters.with_limits(requests).join(bad, "request_id", "left_anti")
        .withColumn("has_text", has_text)
        .withColumn("mode", F.coalesce(F.nullif("mode", F.lit("")), F.lit("both")))
        .withColumn("sort", F.when((given == "relevance") & ~has_text, F.lit("name")).otherwise(given))
        .withColumn("sort_dir", F.coalesce(F.nullif("dir", F.lit("")), F.lit("asc")))
    )
    return good, bad


def all_hits(good: DataFrame, tables: SearchTables) -> DataFrame:
    """Every hit of every request, merged over the branches. The text hits are staged: three later steps use them."""
    texts = good.where("has_text")
    if not texts.head(1):  # requests of filters alone never read the text index
        plain = _meta_filtered(good, _plain_rows(good, tables), tables)
        return merge_both(plain, plain.where(F.lit(False)))
    found = staged(_text_rows(texts, tables), "text-hits")
    named = found.where(F.col("matched_in") == "name")
    missing = texts.where(F.col("mode") != "content").join(named, "request_id", "left_anti")
    others = _meta_filtered(
        good, _substring_rows(missing, tables).unionByName(_plain_rows(good.where(~F.col("has_text")), tables)), tables
    )
    return merge_both(named.unionByName(others), found.where(F.col("matched_in") == "content"))


def search(requests: DataFrame, tables: SearchTables, roots: list[str] | DataFrame | None = None,
           with_snippets: bool = True, max_window: int | None = None, max_filters: int | None = None) -> SearchResult:
    """Run a table of requests. ``roots`` confines all answers to some directories (none given: everything);
    ``max_window`` and ``max_filters``, if given, refuse later pages and requests of more metadata filters."""
    if roots is not None:
        confined = filters.in_scope(tables.files, roots)
        tables = SearchTables(confined, tables.file_meta, tables.content, tables.index, tables.fields, tables.grams)
    good, errors = valid_requests(requests, tables, max_window, max_filters)
    good = staged(good, "requests")
    hits = staged(all_hits(good, tables), "hits")
    totals = good.select("request_id").join(count_matches(hits), "request_id", "left").select(
        "request_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_content", F.lit(0)).alias("n_content")
    )
    settings = good.select("request_id", "sort", "sort_dir", "limit", "offset").join(totals, "request_id")
    most = good.agg(F.max(F.col("offset") + F.col("limit"))).first()[0]
    page = page_batch(
        hits.join(settings, "request_id").withColumn("by_name", F.col("fallback") & (F.col("n_content") == 0)), most=most
    )
    page = page.select("request_id", "rank", "path", "name", "ext", "size", "mtime", "score", "matched_in", "in_content")
    if with_snippets:
        page = add_snippets(page, good, tables.content)
    return SearchResult(page, totals.select("request_id", "total"), errors)
