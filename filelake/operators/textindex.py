"""The text index as ordinary tables: postings with positions, vocabulary and corpus totals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import bucketed

NAMES, BODIES = "names", "bodies"
POSTINGS = "corpus string, head string, field string, term string, path string, doc_len int, positions array<int>"


@dataclass(frozen=True)
class TextIndex:
    """``postings(corpus, head, field, term, path, doc_len, positions)``, ``vocab(corpus, term, df)``,
    ``corpus_stats(corpus, n_docs, total_len)``.

    ``head`` is the beginning of the term; the written table is sorted by it. One posting row holds all positions of a term in one
    field of one file, so a row is bounded by the file. ``slices`` says in how many buckets by path the postings lie (0: in none).
    """

    postings: DataFrame
    vocab: DataFrame
    corpus_stats: DataFrame
    slices: int = 0


def term_head(term: Column | str) -> Column:
    """First character of a term when it is a-z or 0-9, else one of a few groups."""
    t = F.col(term) if isinstance(term, str) else term
    first = F.substring(t, 1, 1)
    return F.when(first.rlike("[a-z0-9]"), first).otherwise(
        F.concat(F.lit("u"), F.pmod(F.xxhash64(first), F.lit(16)).cast("string"))
    )


_GROUPED = "field string, term string, path string, doc_len int, positions array<int>"
_MOST_TOKENS = 500_000  # grouped at once


def _grouped_rows(rows: pa.Table) -> pa.RecordBatch:
    """Positions of every term of rows (path, doc_len, field, tokens); rows that agree in the first three are one."""
    keys = rows.select(["path", "doc_len", "field"]).to_pandas()
    group = keys.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
    tokens = rows["tokens"].combine_chunks()
    sizes = tokens.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = tokens.flatten().dictionary_encode()
    key = group[row] * max(1, len(terms.dictionary)) + terms.indices.to_numpy()
    order = np.argsort(key, kind="stable") if len(set(group)) == len(group) else np.lexsort((pos, key))
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[starts]
    at = pa.array(row[first])
    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype("int32")), pa.array(pos[order].astype("int32")))
    return pa.RecordBatch.from_arrays(
        [rows["field"].combine_chunks().take(at), terms.dictionary.take(terms.indices.take(pa.array(first))), rows["path"].combine_chunks().take(at),
         rows["doc_len"].combine_chunks().take(at), positions], ["field", "term", "path", "doc_len", "positions"])


def _group_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a path stand together; they may go on in the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch]).filter(pc.greater(pc.fill_null(pc.list_value_length(batch["tokens"]), 0), 0))
        if not len(rows):
            continue
        code = rows["path"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = np.flatnonzero(np.diff(code)) + 1  # where another path begins
        if held and held[-1]["path"][-1].as_py() != rows["path"][0].as_py():
            cuts = np.insert(cuts, 0, 0)
        n_tokens = np.insert(np.cumsum(pc.list_value_length(rows["tokens"]).to_numpy()), 0, 0)
        begun = 0
        for cut, following in zip(cuts, [*cuts[1:], None]):
            if following is None or n_tokens[following] - n_tokens[begun] > _MOST_TOKENS:
                ready = pa.concat_tables([*held, rows.slice(begun, cut - begun)])
                if len(ready):
                    yield _grouped_rows(ready)
                held, begun = [], cut
        held.append(rows.slice(begun))
    if held:
        yield _grouped_rows(pa.concat_tables(held))


def _group_terms(rows: DataFrame, corpus: str) -> DataFrame:
    """Postings of rows (path, doc_len, field, tokens) that lie sorted by path. Tokens are grouped where they are, so
    neither single tokens nor postings are shuffled."""
    found = rows.select("path", "doc_len", "field", "tokens").mapInArrow(_group_sorted, _GROUPED)
    return found.select(F.lit(corpus).alias("corpus"), term_head("term").alias("head"), "field", "term", "path", "doc_len", "positions")


def _by_path(rows: DataFrame, slices: int | None) -> DataFrame:
    spread = rows.repartition("path") if slices is None else rows.repartition(slices, "path")
    return spread.sortWithinPartitions("path")


def name_postings(files: DataFrame, slices: int | None = None) -> DataFrame:
    """Terms of file name and directory, two fields of one corpus."""
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("n").alias("tokens")), F.struct(F.lit("dir").alias("field"), F.col("d").alias("tokens")))
    return _group_terms(
        _by_path(files.select("path", "name", "dir"), slices)
        .select("path", text.tokenize_names("name").alias("n"), text.tokenize_names("dir").alias("d"))
        .select("path", (F.size("n") + F.size("d")).alias("doc_len"), F.inline_outer(fields)).where("doc_len IS NOT NULL"),
        NAMES,
    )


def body_postings(content: DataFrame, slices: int | None = None) -> DataFrame:
    """Terms of the bodies. Bodies are shuffled by path once and nothing after them."""
    tokens = _by_path(content.select("path", "body"), slices).select("path", text.tokenize_body("body").alias("tokens"))
    return _group_terms(tokens.select("path", F.size("tokens").alias("doc_len"), F.lit("body").alias("field"), "tokens"), BODIES)


def vocabulary(postings: DataFrame) -> DataFrame:
    """Distinct terms with the number of files that hold them (a file with both fields counts once)."""
    per_file = postings.select("corpus", "term", "path").where(F.col("corpus") == NAMES).distinct()
    bodies = postings.select("corpus", "term", "path").where(F.col("corpus") == BODIES)
    return per_file.unionByName(bodies).groupBy("corpus", "term").agg(F.count("*").alias("df"))


def corpus_totals(postings: DataFrame, files: DataFrame, content: DataFrame) -> DataFrame:
    """Documents and tokens of each corpus; empty documents count."""
    tokens = postings.groupBy("corpus").agg(F.sum(F.size("positions")).cast("long").alias("total_len"))
    docs = (
        files.select(F.lit(NAMES).alias("corpus")).unionByName(content.select(F.lit(BODIES).alias("corpus")))
        .groupBy("corpus").agg(F.count("*").alias("n_docs"))
    )
    return docs.join(tokens, "corpus", "left").select("corpus", "n_docs", F.coalesce("total_len", F.lit(0)).alias("total_len"))


def build_text_index(files: DataFrame, content: DataFrame, out_dir: str | None = None) -> TextIndex:
    """Index of names and bodies.

    With ``out_dir`` the tables are written. Postings lie in as many slices by path as there are shuffle partitions, so what
    a search finds in a file is put together where it is read, and a term found in every file is in every slice. Inside a
    slice they are sorted by corpus, head and term, so a search opens only the pages its terms begin with.
    """
    if out_dir is None:
        postings = name_postings(files).unionByName(body_postings(content))
        return TextIndex(postings, vocabulary(postings), corpus_totals(postings, files, content))
    spark = files.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = _sliced(spark, out_dir, slices)
    name_postings(files, slices).write.insertInto(written, overwrite=True)
    body_postings(content, slices).write.insertInto(written)
    postings = spark.table(written)
    vocabulary(postings).write.mode("overwrite").parquet(f"{out_dir}/vocab")
    corpus_totals(postings, files, content).write.mode("overwrite").parquet(f"{out_dir}/corpus_stats")
    return open_text_index(spark, out_dir, slices)


def _sliced(spark: SparkSession, out_dir: str, slices: int) -> str:
    return bucketed.create_table(spark, f"{out_dir}/postings", POSTINGS, slices, "path", ("corpus", "head", "term", "path"))


def open_text_index(spark: SparkSession, out_dir: str, slices: int = 0) -> TextIndex:
    """A written index; ``slices`` are those it was written in (0: unknown, a search then shuffles what it finds)."""
    postings = spark.table(_sliced(spark, out_dir, slices)) if slices else spark.read.schema(POSTINGS).parquet(f"{out_dir}/postings")
    vocab = spark.read.schema("corpus string, term string, df long").parquet(f"{out_dir}/vocab")
    stats = spark.read.schema("corpus string, n_docs long, total_len long").parquet(f"{out_dir}/corpus_stats")
    return TextIndex(postings, vocab, stats, slices)


def refresh_postings(old: DataFrame, changed: DataFrame, files: DataFrame, content: DataFrame) -> DataFrame:
    """Postings after a change: those of changed or removed paths go, those of the changed files come new.

    ``changed`` holds the paths, ``files`` and ``content`` the current rows; untouched files are not read again.
    """
    keys = changed.select("path").distinct()
    fresh = name_postings(files.join(keys, "path", "left_semi")).unionByName(
        body_postings(content.join(keys, "path", "left_semi"))
    )
    return old.join(keys, "path", "left_anti").select(*old.columns).unionByName(fresh)
