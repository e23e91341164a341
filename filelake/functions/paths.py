"""Column functions over paths, file names and archive entry names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SEPARATOR = "!/"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def lookup(table: dict, key: Column) -> Column:
    """Value of a small literal map, NULL when the key is absent."""
    return F.try_element_at(_literal_map(table), key)


def clean_dir(path: str) -> str:
    """A root or scope as given by a user, without a trailing slash (``/`` stays)."""
    cut = re.sub(r"/+", "/", path)
    return cut.rstrip("/") or "/"


def file_ext(name: Column | str) -> Column:
    """Lower-case text after the last dot; empty without a dot. ``.bashrc`` has extension ``bashrc``."""
    return F.lower(F.regexp_extract(_col(name), r"\.([^.]*)$", 1))


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """Everything before the last slash, ``/`` for a file directly under the root."""
    p = _col(path)
    cut = F.regexp_replace(p, r"/[^/]*$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def parent_path(path: Column | str) -> Column:
    """One step up; leaving an archive lands on the archive file. NULL at the top."""
    p = F.regexp_replace(_col(path), r"!?/+$", "")
    up = F.regexp_replace(p, r"!?/[^/]*$", "")
    return (
        F.when((p == "") | ~p.contains("/"), F.lit(None).cast("string"))
        .when(up == "", F.lit("/"))
        .otherwise(up)
    )


def dir_of(path: Column | str) -> Column:
    return F.coalesce(parent_path(path), F.lit("/"))


def crumbs(path: Column | str) -> Column:
    """Array of ``(label, path, archive)`` from the root down, across archive layers."""
    layers = F.transform(
        F.split(_col(path), re.escape(SEPARATOR)), lambda layer: F.filter(F.split(layer, "/"), lambda x: x != "")
    )

    def one_layer(parts: Column, i: Column) -> Column:
        before = F.array_join(F.transform(F.slice(layers, 1, i), lambda x: F.array_join(x, "/")), SEPARATOR)
        head = F.when(i == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), before, F.lit(SEPARATOR)))
        return F.transform(
            parts,
            lambda part, j: F.struct(
                part.alias("label"),
                F.concat(head, F.array_join(F.slice(parts, 1, j + 1), "/")).alias("path"),
                ((i < F.size(layers) - 1) & (j == F.size(parts) - 1)).alias("archive"),
            ),
        )

    root = F.array(F.struct(F.lit("/").alias("label"), F.lit("/").alias("path"), F.lit(False).alias("archive")))
    return F.concat(root, F.flatten(F.transform(layers, one_layer)))


def ancestors(path: Column | str) -> Column:
    """The path itself and every directory above it, ``/`` included, shortest first."""
    parts = F.split(F.regexp_replace(_col(path), r"^/", ""), "/")
    below = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))
    return F.when(_col(path) == "/", F.array(F.lit("/"))).otherwise(F.concat(F.array(F.lit("/")), below))


def within(path: Column | str, root: str) -> Column:
    """``path`` is ``root`` or lies below it, element-wise; ``/`` contains every absolute path."""
    p, root = _col(path), clean_dir(root)
    if root == "/":
        return p.startswith("/")
    return (p == root) | p.startswith(root + "/")


def within_any(path: Column | str, roots: Iterable[str]) -> Column:
    """Union over roots; no roots match nothing."""
    cond = F.lit(False)
    for i, root in enumerate(roots):
        cond = within(path, root) if i == 0 else cond | within(path, root)
    return cond


def skip_dir(directory: Column | str, root: Column | str = "/", names: Iterable[str] = fixed.SKIP_DIR_NAMES,
             prefix: str = fixed.SKIP_DIR_PREFIX) -> Column:
    """True when any element of ``directory`` below ``root`` is a pruned name (the root's own never are)."""
    d = _col(directory)
    r = F.rtrim(F.lit(root) if isinstance(root, str) else root, F.lit("/"))
    below = F.split(F.substr(d, F.length(r) + 1), "/")
    return F.exists(below, lambda x: x.isin(*names) | x.startswith(prefix))


def is_archive_name(name: Column | str) -> Column:
    """The lower-cased name ends with an archive suffix and is longer than it."""
    alternatives = "|".join(re.escape(s[1:]) for s in fixed.ARCHIVE_SUFFIXES)
    return F.lower(_col(name)).rlike(rf"(?s).\.({alternatives})$")


def archive_format(name: Column | str) -> Column:
    """Format of an archive name, ``other`` for suffixes with no built-in reader, NULL for other files."""
    low = F.lower(_col(name))
    out = None
    for fmt, suffixes in fixed.ARCHIVE_FORMATS:
        test = low.rlike("(?s).(" + "|".join(re.escape(s) for s in suffixes) + ")$")
        out = F.when(test, F.lit(fmt)) if out is None else out.when(test, F.lit(fmt))
    return out.when(is_archive_name(name), F.lit("other"))


def mime_by_name(name: Column | str) -> Column:
    """MIME type from the extension alone, empty when unknown."""
    return mime_by_ext(file_ext(name))


def mime_by_ext(ext: Column | str) -> Column:
    return F.coalesce(lookup(fixed.MIME_BY_EXT, _col(ext)), F.lit(""))


def mime_class(name: Column | str) -> Column:
    """``archive`` for archive names, else the major MIME type, else empty."""
    return F.when(is_archive_name(name), F.lit("archive")).otherwise(F.substring_index(mime_by_name(name), "/", 1))


def category_of_ext(ext: Column | str) -> Column:
    """Metadata category of an extension (leading dot and case ignored), NULL when there is none."""
    table = {e: kind for kind, exts in fixed.CATEGORY_EXTENSIONS.items() for e in exts}
    return lookup(table, F.lower(F.regexp_replace(_col(ext), r"^\.", "")))


def media_kind(mime: Column | str, name: Column | str) -> Column:
    """``video`` or ``audio``: the MIME type decides, the extension covers the rest; else NULL."""
    base = F.lower(F.trim(F.substring_index(F.coalesce(_col(mime), F.lit("")), ";", 1)))
    by_ext = {e: "video" for e in fixed.PLAYER_VIDEO_EXTENSIONS} | {e: "audio" for e in fixed.PLAYER_AUDIO_EXTENSIONS}
    ext = F.lower(F.regexp_extract(_col(name), r"(?s).\.([^.]+)$", 1))
    return (
        F.when(base.startswith("video/"), F.lit("video"))
        .when(base.startswith("audio/"), F.lit("audio"))
        .otherwise(lookup(by_ext, ext))
    )


def clean_entry_name(name: Column | str) -> Column:
    """Normal form of a stored archive entry name; NULL for absolute, escaping, empty or NUL names."""
    n = _col(name)
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & can_pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    cleaned = F.array_join(F.aggregate(F.split(n, "/"), empty, step), "/")
    bad = n.startswith("/") | n.contains("\x00") | (cleaned == "") | (cleaned == "..") | cleaned.startswith("../")
    return F.when(~bad, cleaned)


def virtual_path(archive_path: Column | str, entry_path: Column | str) -> Column:
    return F.concat(_col(archive_path), F.lit(SEPARATOR), _col(entry_path))
