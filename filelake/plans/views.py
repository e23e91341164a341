"""Catalogue tables derived from the given sample tables, so every query's work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, paths, text
from ..operators import textindex
from ..session import prepare, shared_dir


TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text tables that fewer tasks would read than there are cores are spread first, so that work on
    the texts does not stay in those few; the rows are the same, and at scale nothing is shuffled."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def epoch_micros(ts: str) -> "F.Column":
    return F.unix_micros(F.col(ts).cast("timestamp"))


def document_files(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """One file per document: ``doc_id`` plus the scan columns, and further columns of the document as asked for."""
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(e) for e in ("txt", "md", "log", "csv", "json", "py", "zip", "jpg")]),
                       (F.col("doc_id") % 8 + 1).cast("int"))
    words = F.concat_ws("_", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    named = docs.select(
        "doc_id", F.concat_ws("/", F.lit("/lake/docs"), "source", "lang").alias("dir"),
        F.concat(F.translate(words, "\n/", "__"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"),
        ext.alias("ext"), F.col("n_chars").alias("size"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 31536000).alias("mtime"), *extra,
    )
    return named.withColumn("path", F.concat("dir", F.lit("/"), "name"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    named = pages.select(
        F.concat(F.lit("/lake/web/"), F.split_part("url", F.lit("/"), F.lit(3))).alias("dir"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
        F.lit("html").alias("ext"), F.length("html").cast("long").alias("size"),
        (F.lit(1704067200) + (F.col("page_id") * 104729) % 31536000).alias("mtime"),
    )
    return named.withColumn("path", F.concat("dir", F.lit("/"), "name"))


SCAN = ("path", "dir", "name", "ext", "size", "mtime")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full listing: all documents and pages as files."""
    return document_files(spark, sf_dir).select(*SCAN).unionByName(page_files(spark, sf_dir).select(*SCAN))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).withColumn("mimeclass", paths.mime_class("name"))


def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-valued metadata of the document files: language, quality, toxicity, speakers."""
    docs, labels, talks = (table(spark, sf_dir, t) for t in ("documents", "labels", "conversations"))
    none = F.lit(None).cast("double")
    rows = (
        docs.select("doc_id", F.lit("doc.lang").alias("key"), F.col("lang").alias("value"), none.alias("num"))
        .unionByName(labels.select("doc_id", F.lit("doc.quality").alias("key"), F.col("quality").cast("string").alias("value"),
                                   F.col("quality").cast("double").alias("num")))
        .unionByName(labels.select("doc_id", F.lit("doc.toxic").alias("key"),
                                   F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("value"), none.alias("num")))
        .unionByName(talks.select(F.col("conv_id").alias("doc_id"), F.lit("doc.speaker").alias("key"),
                                  F.col("role").alias("value"), none.alias("num")).distinct())
    )
    return rows.join(document_files(spark, sf_dir).select("doc_id", "path"), "doc_id").select("path", "key", "value", "num")


FIELD_TYPES = {"doc.lang": "enum", "doc.quality": "number", "doc.toxic": "bool", "doc.speaker": "enum"}


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of the document files whose extension is on the content list."""
    docs = document_files(spark, sf_dir, "text").where(F.col("ext").isin(*fixed.CONTENT_EXTENSIONS))
    return docs.select("path", text.sanitize_body("text").alias("body"))


_INDEXES: dict[tuple[str, str], textindex.TextIndex] = {}


def index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The text index over names and bodies, written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        out = f"{shared_dir(spark)}/text-index/{key[0]}/{sf_dir.strip('/').replace('/', '-')}"
        _INDEXES[key] = textindex.build_text_index(scan(spark, sf_dir), content(spark, sf_dir), out)
    return _INDEXES[key]


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status feed of many indexes: ``index_id, ts, seq, state, progress, last_full_scan``."""
    return status_columns(table(spark, sf_dir, "events"))


def status_columns(e: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "idle").when(F.col("event_type") == "click", "crawling").otherwise(F.col("event_type"))
    return e.select(
        F.col("user_id").alias("index_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        state.alias("state"), F.col("value").alias("progress"), F.floor("value").cast("long").alias("last_full_scan"),
    )


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of generation 1: all documents, text extracted where listed, metadata where labelled."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = document_files(spark, sf_dir).join(labelled, "doc_id", "left")
    return docs.select(
        *SCAN, paths.mime_class("name").alias("mimeclass"), F.col("ext").isin(*fixed.CONTENT_EXTENSIONS).alias("content_indexed"),
        F.coalesce("labelled", F.lit(False)).alias("meta_extracted"), F.lit(1).cast("long").alias("gen"),
    )


def new_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later listing: toxic documents are gone, good ones changed a second later, pages are new."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = document_files(spark, sf_dir).join(labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    moved = docs.withColumn("mtime", F.col("mtime") + F.coalesce("quality", F.lit(0)))
    return moved.select(*SCAN).unionByName(page_files(spark, sf_dir).select(*SCAN))
