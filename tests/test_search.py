"""Search against the full-text engine of the standard library, and rules that have no SQL."""

import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from filelake import schema
from filelake.functions import snippets
from filelake.operators import fields, gram_index, search, textindex
from filelake.plans.filter_queries import META_SCHEMA  # noqa: F401

FILES = [
    ("/m/report_2024.txt", "quarterly Report for the café team, report again"), ("/m/notes.md", "the great escape plan and a report"),
    ("/m/sub/the great escape.log", "nothing here"), ("/m/sub/server.log", "error: disk full on user/logs path; user logs rotate"),
    ("/m/sub/Résumé.txt", "resume of the great escape, great great escape"), ("/x/logs/data.csv", "a,b,c report;logs"), ("/x/empty.txt", ""),
]
QUERIES = ["report", "rep", '"great escape"', "great esc", "the report", "user/logs", "resume", "log", '"escape great"', "server.log", "caf", "a"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1], p.rsplit(".", 1)[1], len(b) + 1, 1000 + i, "text") for i, (p, b) in enumerate(FILES)]
    files = spark.createDataFrame(rows, "path string, dir string, name string, ext string, size long, mtime long, mimeclass string").cache()
    content = spark.createDataFrame(FILES, "path string, body string").cache()
    meta = spark.createDataFrame([], schema.FILE_META)
    return search.SearchTables(files, meta, content, textindex.build_text_index(files, content), fields.field_catalog(spark))


@pytest.fixture(scope="module")
def fts():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE n USING fts5(name, dir, tokenize=\"unicode61 tokenchars '._-'\")")
    con.execute("CREATE VIRTUAL TABLE c USING fts5(path UNINDEXED, body, tokenize='unicode61')")
    for i, (p, b) in enumerate(FILES):
        con.execute("INSERT INTO n(rowid, name, dir) VALUES (?,?,?)", (i, p.rsplit("/", 1)[1], p.rsplit("/", 1)[0]))
        con.execute("INSERT INTO c(rowid, path, body) VALUES (?,?,?)", (i, p, b))
    return con


def requests(spark, rows):
    full = [dict(request_id=None, q="", mode="both", path=None, exts=[], min_size=-1, max_size=-1, after=0, before=0, meta=[], sort="", dir="", limit=0, offset=0) | r
            for r in rows]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.REQUESTS.fields) for r in full], schema.REQUESTS)


def match_string(q):
    parts = re.findall(r'"([^"]*)"|(\S+)', q)
    return " ".join(f'"{p}"' if p else f'"{t}"*' for p, t in parts)


@pytest.mark.parametrize("corpus_name,table,weights", [("names", "n", "n, 10.0, 1.0"), ("bodies", "c", "c")])
def test_matches_and_scores(spark, corpus, fts, corpus_name, table, weights):
    r = requests(spark, [dict(request_id=q, q=q) for q in QUERIES])
    got = {(x["request_id"], x["path"]): x["score"] for x in search.text_hits(r, corpus.index, corpus_name).collect()}
    want = {}
    for q in QUERIES:
        for rowid, score in fts.execute(f"SELECT rowid, -bm25({weights}) FROM {table} WHERE {table} MATCH ?", (match_string(q),)):
            want[(q, FILES[rowid][0])] = score
    assert got.keys() == want.keys() and want
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_fallback_filters_and_merge(spark, corpus):
    r = requests(spark, [
        dict(request_id="mid", q="scape", mode="name"), dict(request_id="short", q="sc", mode="name"), dict(request_id="merged", q="report"),
        dict(request_id="plain", exts=[".LOG"], sort="size", dir="desc"), dict(request_id="scoped", q="report", path="/x"), dict(request_id="bad", q="**"),
        dict(request_id="deep", q="a", limit=1000, offset=9001), dict(request_id="key", q="a", meta=[("nope.x", "=", "1")])])
    many = [("size", ">=", "0")] * 17
    assert search.search(requests(spark, [dict(request_id="deep", q="a", limit=1000, offset=9001, meta=many)]), corpus).errors.count() == 0
    result = search.search(r, corpus, roots=["/"], max_window=10_000)
    hits = {}
    for x in result.hits.orderBy("request_id", "rank").collect():
        hits.setdefault(x["request_id"], []).append((x["path"], x["matched_in"]))
    assert hits["mid"] == [("/m/sub/the great escape.log", "name")] and "short" not in hits
    assert hits["merged"][0] == ("/m/report_2024.txt", "name") and len(hits["merged"]) == 3
    assert [p for p, _ in hits["plain"]] == ["/m/sub/server.log", "/m/sub/the great escape.log"]
    assert hits["scoped"] == [("/x/logs/data.csv", "content")]
    assert {e["request_id"]: e["error_code"] for e in result.errors.collect()} == dict.fromkeys(["bad", "deep", "key"], "BAD_REQUEST")
    assert {t["request_id"]: t["total"] for t in result.totals.collect()}["merged"] == 3
    confined = search.search(r, corpus, roots=["/x"], with_snippets=False).hits
    assert {x["path"] for x in confined.collect()} == {"/x/logs/data.csv"}


def test_pages_are_disjoint_whatever_the_slices(spark):
    hits = spark.range(5000).select(
        F.lit("r").alias("request_id"), F.format_string("/f%05d", "id").alias("path"), F.format_string("f%05d", "id").alias("name"), F.lit("x").alias("ext"),
        (F.col("id") % 7).alias("size"), F.col("id").alias("mtime"), (F.col("id") % 3 / 3.0).alias("score"), F.lit("name").alias("matched_in"),
        F.lit("size").alias("sort"), F.lit("desc").alias("sort_dir"), F.lit(40).cast("long").alias("limit"), F.lit(False).alias("by_name"))
    seen = []
    for offset in (0, 40, 80):
        rows = search.page_batch(hits.withColumn("offset", F.lit(offset).cast("long")), salts=16).orderBy("rank").collect()
        seen += [r["path"] for r in rows]
    want = [r["path"] for r in hits.orderBy(F.desc("size"), F.desc("path")).limit(120).collect()]
    assert seen == want


def test_snippets():
    body = "one two three four five six seven eight nine ten eleven twelve thirteen Needle <b> fourteen hay needle end"
    raw = snippets.cut(body, [("term", ["needle"]), ("phrase", ["fourteen", "hay"])])
    assert len(re.findall(r"\w+", raw)) == 12 and raw.count("\x02") == raw.count("\x03") == 3 and raw.startswith("…")
    html = snippets.render(raw)
    assert "<mark>Needle</mark>" in html and "&lt;b&gt;" in html and "\x02" not in html
    huge = "x" * 5000 + "\x02hit\x03" + "y" * 5000
    short = snippets.shorten(huge)
    assert len(short) <= 610 and "\x02hit\x03" in short and short.startswith("…") and short.endswith("…")
    cut_open = snippets.shorten("\x02" + "z" * 2000 + "\x03")
    assert cut_open.count("\x02") == cut_open.count("\x03") == 1


def test_index_refresh_equals_rebuild(spark, corpus):
    files, content = corpus.files, corpus.content
    changed = spark.createDataFrame([("/m/notes.md",), ("/x/empty.txt",)], "path string")
    body = F.when(F.col("path") == "/m/notes.md", F.lit("fresh words")).otherwise(F.col("body"))
    new_files, new_content = files.where("path <> '/x/empty.txt'"), content.where("path <> '/x/empty.txt'").withColumn("body", body)
    refreshed = textindex.refresh_postings(corpus.index.postings, changed, new_files, new_content)
    rebuilt = textindex.build_text_index(new_files, new_content).postings
    assert sorted(map(str, refreshed.collect())) == sorted(map(str, rebuilt.collect()))


def test_written_index_prunes_partitions(spark, corpus, tmp_path):
    index = textindex.build_text_index(corpus.files, corpus.content, str(tmp_path / "i"))
    r = requests(spark, [dict(request_id="q", q="report")])
    a = search.text_hits(r, index, "bodies").collect()
    assert sorted(map(str, a)) == sorted(map(str, search.text_hits(r, corpus.index, "bodies").collect()))


def test_stored_pieces_find_what_names_hold(spark, tmp_path):
    names = ["abcabc.txt", "ABC.md", "xbcd", "ab", "", "Straße.TXT", "a b c abc"] + [f"abc{i}.log" for i in range(60)]
    files = spark.createDataFrame([(f"/f/{i}", n) for i, n in enumerate(names)], "path string, name string")
    index = gram_index.build_gram_index(files, str(tmp_path), buckets=3, slices=4)
    asked = {"r1": ["abc"], "r2": ["abc", "txt"], "r3": ["bcd"], "r4": ["zzz", "abc"], "r5": ["ab"], "r6": [], "r7": ["aße"], "r8": ["abc5", ".log"]}
    wanted = spark.createDataFrame(list(asked.items()), "request_id string, terms array<string>")
    got = {(r.request_id, r.path) for r in gram_index.holding(wanted, index).collect()}
    assert got == {(k, f"/f/{i}") for k, terms in asked.items() if terms and min(map(len, terms)) >= 3
                   for i, n in enumerate(names) if all(t in n.lower() for t in terms)}
    assert {r.request_id: r.gram for r in gram_index.rarest(wanted.where("request_id = 'r2'"), index).collect()} == {"r2": "txt"}
    assert {r.gram: r.n for r in index.counts.collect()}["abc"] == 63


def test_scope_of_a_root_table(spark):
    """Roots that are files, the whole tree, doubled or nested roots, odd paths: as the plain ancestor rule says."""
    from filelake.functions import paths as path_functions
    from filelake.operators import filters

    names = ["/", "/a", "/a/b", "/a/b/c.txt", "/a/bc", "/ab/c", "/x.txt", "/a/b\n/d", "rel/f", "/a//b", None]
    df = spark.createDataFrame([(n, k) for k, n in enumerate(names * 2)], "path string, _root int")
    ancestors = {r[0]: set(r[1] or ()) for r in df.select("path", path_functions.ancestors("path")).collect()}
    for roots in (["/a/b/"], ["/"], ["/a/b/c.txt", "/ab", "/ab/"], ["/rel", "/a", "/a/b"], ["/a/b\n"], [], [None]):
        wanted = {"/" if r.rstrip("/") == "" else r.rstrip("/") for r in roots if r is not None}
        got = sorted(r["_root"] for r in filters.in_scope(df, spark.createDataFrame([(r,) for r in roots], "root string")).collect())
        assert got == [k for k, n in enumerate(names * 2) if ancestors[n] & wanted], roots


def test_matches_stay_in_the_slices_of_a_written_index(spark, corpus, tmp_path):
    """Neither postings nor matches are shuffled: only the tokens of the requests travel."""
    index = textindex.build_text_index(corpus.files, corpus.content, str(tmp_path / "i"))
    r = requests(spark, [dict(request_id=q, q=q) for q in QUERIES])
    for name in ("names", "bodies"):
        parts = search.query_parts(r, name)
        found = search.match_parts(parts, index)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        columns = sorted(found.columns)
        assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, search.match_parts(parts, corpus.index).select(columns).collect()))


def test_grouped_tokens_of_paths_that_come_twice(monkeypatch):
    """Rows of one path, in one batch or several, are one if they have the same length and field."""
    import pyarrow as pa

    rows = [(None, 1, "body", ["x"]), (None, 1, "body", ["x"]), ("/a", 3, "body", ["x", "y", "x"]), ("/a", 3, "body", ["x", "y", "x"]), ("/a", 0, "body", []),
            ("/a", 2, "body", ["y", "x"]), ("/b", None, "body", None), ("/c", 4, "dir", ["y"]), ("/c", 4, "name", ["x", "y", "y"])]
    kinds = pa.schema([("path", pa.string()), ("doc_len", pa.int32()), ("field", pa.string()), ("tokens", pa.list_(pa.string()))])
    want: dict = {}
    for path, n, field, tokens in rows:
        for i, t in enumerate(tokens or ()):
            want.setdefault((field, t, path, n), []).append(i)
    want = {k: sorted(v) for k, v in want.items()}
    for most in (1, 500_000):
        monkeypatch.setattr(textindex, "_MOST_TOKENS", most)
        for size in (1, 2, 4, 100):
            batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[i: i + size]], kinds) for i in range(0, len(rows), size)]
            found = [r for b in textindex._group_sorted(iter(batches)) for r in b.to_pylist()]
            assert len(found) == len(want) and {(r["field"], r["term"], r["path"], r["doc_len"]): r["positions"] for r in found} == want
