"""Predicates over the catalogue: scopes, columns, metadata, and the checks on requests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, paths, values

NUMERIC_TYPES = ("number", "bytes", "date")
ORDER_OPS = ("<", "<=", ">", ">=")
OPS = ("=", "!=", "~") + ORDER_OPS
ENUMERABLE_COMMON = ("ext", "mime")


# --- scopes -----------------------------------------------------------------------------------------------

def in_scope(df: DataFrame, roots: Iterable[str] | DataFrame, col: str = "path") -> DataFrame:
    """Rows at or below any root; an empty root list keeps nothing.

    A handful of roots is a filter that can reach the scan. With a table of roots (column ``root``) the distinct
    directories of the rows are decided first, by equality on their ancestors; rows then look up their directory, and
    themselves among the roots. Only directories and roots are shuffled, unless they are too many for Spark to broadcast.
    """
    if not isinstance(roots, DataFrame):
        return df.where(paths.within_any(col, roots))
    keys = roots.select(
        F.when(F.rtrim("root", F.lit("/")) == "", F.lit("/")).otherwise(F.rtrim("root", F.lit("/"))).alias("_root")
    ).distinct()
    above = F.regexp_extract(col, "^(?s:(.*))/[^/]*$", 1)
    rows = df.withColumn("_dir", F.when(above == "", F.lit("/")).otherwise(above)).withColumn("_self", F.regexp_replace(col, "^/?", "/"))
    inside = (
        rows.select("_dir").distinct().select("_dir", F.explode(paths.ancestors("_dir")).alias("_root"))
        .join(keys, "_root", "left_semi").select("_dir").distinct().withColumn("_below", F.lit(True))
    )
    itself = keys.select(F.col("_root").alias("_self"), F.lit(True).alias("_is"))
    return rows.join(inside, "_dir", "left").join(itself, "_self", "left").where("_below OR _is").select(*df.columns)


def in_dir_scope(df: DataFrame, scope: str) -> DataFrame:
    """Files whose directory is ``scope`` or below it, so a scope that names a file keeps nothing."""
    return df.where(paths.within("dir", scope))


def normal_exts(exts: Iterable[str]) -> list[str]:
    cleaned = [e.strip().removeprefix(".").lower() for e in exts]
    return [e for e in cleaned if e]


def ext_in(df: DataFrame, exts: Iterable[str]) -> DataFrame:
    return df.where(F.col("ext").isin(normal_exts(exts)))


def size_between(df: DataFrame, lo: int = -1, hi: int = -1) -> DataFrame:
    """Inclusive bounds, -1 meaning unset."""
    out = df.where(F.col("size") >= lo) if lo >= 0 else df
    return out.where(F.col("size") <= hi) if hi >= 0 else out


def mtime_between(df: DataFrame, after: int = 0, before: int = 0) -> DataFrame:
    """Inclusive bounds in unix seconds, 0 meaning unset."""
    out = df.where(F.col("mtime") >= after) if after > 0 else df
    return out.where(F.col("mtime") <= before) if before > 0 else out


# --- predicates -------------------------------------------------------------------------------------------

def compare(left: Column, op: Column | str, right: Column) -> Column:
    """``left op right`` where the operator may itself be a column."""
    if isinstance(op, str):
        table = {
            "=": left == right, "!=": left != right, "<": left < right, "<=": left <= right,
            ">": left > right, ">=": left >= right,
        }
        return table[op]
    return (
        F.when(op == "=", left == right).when(op == "!=", left != right).when(op == "<", left < right)
        .when(op == "<=", left <= right).when(op == ">", left > right).when(op == ">=", left >= right)
    )


def common_condition(key: Column | str, op: Column | str, value: Column | str) -> Column:
    """One condition on a catalogue column; key, operator and value may be columns or plain values."""
    def lit(x):
        return F.lit(x) if isinstance(x, str) else x

    key, op, value = lit(key), lit(op), F.trim(lit(value))
    wanted = F.lower(F.when(key == "ext", F.regexp_replace(value, r"^\.", "")).otherwise(value))
    text = F.lower(
        F.when(key == "name", F.col("name")).when(key == "ext", F.col("ext")).when(key == "mime", F.col("mimeclass"))
    )
    textual = F.when(op == "~", text.contains(wanted)).when(op == "=", text == wanted).otherwise(text != wanted)
    number = F.when(key == "size", F.col("size")).when(key == "mtime", F.col("mtime")).cast("double")
    kind = F.when(key == "mtime", F.lit("date")).otherwise(F.lit("bytes"))
    numeric = compare(number, op, values.parse_numeric_value(value, kind))
    return F.when(key.isin("size", "mtime"), numeric).otherwise(textual)


def common_filter(df: DataFrame, key: str, op: str, value: str) -> DataFrame:
    """Name, extension and media class compare without case; size and mtime as numbers."""
    if key in ("size", "mtime") and op == "~":
        raise ValueError(f"operator ~ is not valid for {key}")
    return df.where(common_condition(key, op, value))


def meta_condition(op: str, value: str, field_type: str) -> Column:
    """Condition on ``value``/``num`` of one metadata row, ``!=`` being read as ``=`` by the anti-join."""
    value = value.strip()
    if op == "~":
        return F.lower("value").contains(value.lower())
    if field_type in NUMERIC_TYPES:
        wanted = values.parse_numeric_value(F.lit(value), F.lit(field_type))
        return compare(F.col("num"), "=" if op == "!=" else op, wanted)
    if field_type == "bool":
        value = {"true": "yes", "false": "no"}.get(value.lower(), value)
    return F.lower("value") == value.lower()


def meta_exists(files: DataFrame, file_meta: DataFrame, key: str, op: str, value: str,
                field_type: str = "text") -> DataFrame:
    """Files with at least one value of ``key`` that satisfies the condition."""
    hits = file_meta.where((F.col("key") == key) & meta_condition(op, value, field_type)).select("path")
    return files.join(hits, "path", "left_semi")


def meta_not_equal(files: DataFrame, file_meta: DataFrame, key: str, value: str,
                   field_type: str = "text") -> DataFrame:
    """Files with no value of ``key`` equal to ``value``: lacking the key passes, one match among many fails."""
    hits = file_meta.where((F.col("key") == key) & meta_condition("=", value, field_type)).select("path")
    return files.join(hits, "path", "left_anti")


# --- filters of a batch of requests ------------------------------------------------------------------------

def exploded_filters(requests: DataFrame) -> DataFrame:
    """One row per request filter: ``request_id, fno, key, op, value``."""
    return requests.select("request_id", F.posexplode("meta").alias("fno", "f")).select(
        "request_id", "fno", F.trim("f.key").alias("key"), F.trim("f.op").alias("op"), F.trim("f.value").alias("value")
    )


def column_filters() -> Column:
    """All column conditions of a request joined to a catalogue row (request columns carry the prefix ``r_``)."""
    scope = F.rtrim("r_path", F.lit("/"))
    scoped = F.col("r_path").isNull() | (F.col("r_path") == "") | (F.col("dir") == scope) | F.col("dir").startswith(
        F.concat(scope, F.lit("/"))
    )
    exts = F.transform("r_exts", lambda e: F.lower(F.regexp_replace(F.trim(e), r"^\.", "")))
    ext_ok = F.col("r_exts").isNull() | (F.size("r_exts") == 0) | F.array_contains(exts, F.col("ext"))
    return (
        scoped & ext_ok
        & ((F.coalesce("r_min_size", F.lit(-1)) < 0) | (F.col("size") >= F.col("r_min_size")))
        & ((F.coalesce("r_max_size", F.lit(-1)) < 0) | (F.col("size") <= F.col("r_max_size")))
        & ((F.coalesce("r_after", F.lit(0)) <= 0) | (F.col("mtime") >= F.col("r_after")))
        & ((F.coalesce("r_before", F.lit(0)) <= 0) | (F.col("mtime") <= F.col("r_before")))
        & F.forall(
            F.filter(F.coalesce("r_meta", F.array().cast("array<struct<key:string,op:string,value:string>>")),
                     lambda f: ~f["key"].contains(".")),
            lambda f: F.coalesce(common_condition(f["key"], f["op"], f["value"]), F.lit(False)),
        )
    )


# --- validation -------------------------------------------------------------------------------------------

def validate_filters(requests: DataFrame, catalog: DataFrame, max_filters: int | None = None) -> DataFrame:
    """The first invalid metadata filter of each request as ``(request_id, error_code, message)``; ``max_filters``, if given,
    refuses requests with more."""
    kind = F.col("type")
    numeric = kind.isin(*NUMERIC_TYPES)
    number = values.parse_numeric_value("value", "type")
    problem = (
        F.when(kind.isNull(), F.concat(F.lit("unknown metadata key: "), F.col("key")))
        .when(~F.col("op").isin(*OPS), F.concat(F.lit("invalid operator for "), F.col("key")))
        .when(F.col("op").isin(*ORDER_OPS) & ~numeric, F.concat(F.lit("ordering needs a numeric field: "), F.col("key")))
        .when(numeric & (F.col("op") != "~") & number.isNull(), F.concat(F.lit("not a valid value for "), F.col("key")))
        .when(F.col("key").isin("size", "mtime") & (F.col("op") == "~"), F.concat(F.lit("~ is not valid for "), F.col("key")))
    )
    checked = (
        exploded_filters(requests).join(catalog.select("key", "type"), "key", "left")
        .withColumn("message", problem).where("message IS NOT NULL")
        .groupBy("request_id").agg(F.min_by("message", "fno").alias("message"))
    )
    if max_filters is not None:
        too_many = requests.where(F.size("meta") > max_filters).select(
            "request_id", F.lit(f"at most {max_filters} metadata filters per search").alias("message")
        )
        checked = too_many.unionByName(checked.join(too_many, "request_id", "left_anti"))
    return (
        checked.select("request_id", F.lit("BAD_REQUEST").alias("error_code"), "message")
    )


def with_limits(requests: DataFrame) -> DataFrame:
    """Page bounds as they will be used: the limit asked for, 100 for unset, offset at least 0."""
    limit = F.coalesce("limit", F.lit(0))
    return requests.withColumn(
        "limit",
        F.when(limit <= 0, F.lit(fixed.DEFAULT_LIMIT)).otherwise(limit).cast("long"),
    ).withColumn("offset", F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)).cast("long"))


def has_filter() -> Column:
    return (
        (F.coalesce("path", F.lit("")) != "") | (F.coalesce(F.size("exts"), F.lit(0)) > 0)
        | (F.coalesce("min_size", F.lit(-1)) >= 0) | (F.coalesce("max_size", F.lit(-1)) >= 0)
        | (F.coalesce("after", F.lit(0)) > 0) | (F.coalesce("before", F.lit(0)) > 0)
        | (F.coalesce(F.size("meta"), F.lit(0)) > 0)
    )


def validate_requests(requests: DataFrame, max_window: int | None = None) -> DataFrame:
    """Requests that cannot run: bad mode or sort, nothing to search for, or a page beyond the window (None: no window)."""
    from ..functions.text import split_query

    window = F.col("offset") + F.col("limit")
    message = (
        F.when(~F.coalesce(F.nullif("mode", F.lit("")), F.lit("both")).isin("name", "content", "both"),
               F.lit("invalid search mode"))
        .when((F.size(split_query("q")) == 0) & ~has_filter(), F.lit("no searchable terms and no filters"))
        .when(~F.coalesce("sort", F.lit("")).isin("", "relevance", "name", "size", "mtime"), F.lit("invalid sort"))
        .when(~F.coalesce("dir", F.lit("")).isin("", "asc", "desc"), F.lit("invalid sort direction"))
        .when(F.lit(False) if max_window is None else window > max_window, F.lit(f"offset+limit must not exceed {max_window}"))
    )
    return (
        with_limits(requests).withColumn("message", message).where("message IS NOT NULL")
        .select("request_id", F.lit("BAD_REQUEST").alias("error_code"), "message")
    )


def validate_facet_keys(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Facet keys that cannot be enumerated: unknown ones and name, size, mtime."""
    message = (
        F.when(F.col("type").isNull(), F.concat(F.lit("unknown metadata key: "), F.col("key")))
        .when(~F.col("key").contains(".") & ~F.col("key").isin(*ENUMERABLE_COMMON),
              F.concat(F.lit("values cannot be enumerated: "), F.col("key")))
    )
    return (
        keys.join(catalog.select("key", "type"), "key", "left").withColumn("message", message)
        .where("message IS NOT NULL").select("key", F.lit("BAD_REQUEST").alias("error_code"), "message")
    )


def to_entries(files: DataFrame) -> DataFrame:
    """Catalogue rows as listing entries."""
    return files.select(
        "name", "path",
        F.when(paths.is_archive_name("name"), F.lit("archive")).otherwise(F.lit("file")).alias("type"),
        "size", "mtime", paths.mime_by_ext("ext").alias("mime"), F.lit("").alias("target"),
    )


def merge_conditions(conditions: DataFrame) -> DataFrame:
    """Size and time conditions ``(request_id, key, op, value)`` folded into the tightest bounds per request."""
    key, op, v = F.col("key"), F.col("op"), F.col("value")
    size, when = key == "size", key == "mtime"
    return conditions.groupBy("request_id").agg(
        F.max(F.when(size & (op == ">"), v + 1).when(size & op.isin(">=", "="), v)).alias("min_size"),
        F.min(F.when(size & (op == "<"), F.greatest(F.lit(0), v - 1)).when(size & op.isin("<=", "="), v)).alias("max_size"),
        F.max(F.when(when & (op == ">"), v)).alias("after"),
        F.min(F.when(when & (op == "<"), v)).alias("before"),
    )
