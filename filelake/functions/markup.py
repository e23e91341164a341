"""Reducing HTML to text that keeps only mark tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .paths import _col

_TAG = r"<[^>]*>"


def _decode_entities(text: Column) -> Column:
    """Entities decoded once: text is cut at entities, each is replaced, and the pieces are joined again."""
    pattern = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z]+);"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.split(text, pattern)

    def decoded(name: Column) -> Column:
        whole = F.concat(F.lit("&"), name, F.lit(";"))
        decimal = F.when(name.rlike("^#[0-9]"), F.substr(name, F.lit(2)).try_cast("int"))
        hexa = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("int"))
        code = F.coalesce(decimal, hexa)
        bytes4 = F.unhex(F.lpad(F.hex(code), 8, "0"))
        char = F.when((code > 0) & ~code.isin(2, 3) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(bytes4, "UTF-32"))
        named = F.coalesce(*[F.when(F.lower(name) == k, F.lit(v)) for k, v in fixed.NAMED_ENTITIES.items()])
        return F.coalesce(char, named, whole)

    # Pieces and entities are walked side by side, so both arrays are made once.
    glued = F.zip_with(between, found, lambda piece, name: F.concat(piece, F.when(name.isNotNull(), decoded(name)).otherwise(F.lit(""))))
    return F.array_join(glued, "")


def _escape(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def _marks_only(text: Column) -> Column:
    """Tags taken from left to right: what lies within a tag is no tag of its own. Marks become control characters."""
    tags = F.regexp_extract_all(text, F.lit(_TAG), F.lit(0))
    mark = lambda tag: F.when(tag.rlike(r"(?i)^<mark\s*>$"), "\x02").when(tag.rlike(r"(?i)^</mark\s*>$"), "\x03").otherwise("")
    pieces = F.zip_with(F.split(text, _TAG), tags, lambda piece, tag: F.concat(piece, F.when(tag.isNotNull(), mark(tag)).otherwise("")))
    return F.array_join(pieces, "")


def strip_markup(html: Column | str, max_chars: int | None = None) -> Column:
    """Text of HTML with all tags removed but mark tags, entities decoded once and escaped again.

    Opening and closing marks travel as two control characters through decoding, which never yields those two;
    self-closing marks vanish. A
    closing mark with nothing open is dropped and an open one is closed at the end. The whole text is read unless
    ``max_chars`` (65 536 for a result page's snippets) says otherwise.
    """
    source = _col(html) if max_chars is None else F.substring(_col(html), 1, max_chars)
    source = F.regexp_replace(source, "[\x02\x03]", "")
    text = _escape(_decode_entities(_marks_only(source)))
    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        opens, closes = p == "\x02", (p == "\x03") & (acc["open"] > 0)
        depth = F.when(opens, acc["open"] + 1).when(closes, acc["open"] - 1).otherwise(acc["open"])
        shown = F.when(opens, F.lit("<mark>")).when(closes, F.lit("</mark>")).when(p == "\x03", F.lit("")).otherwise(p)
        return F.struct(depth.alias("open"), F.concat(acc["out"], F.array(shown)).alias("out"))

    pieces = F.split(text, "(?<=[\x02\x03])|(?=[\x02\x03])")
    return F.aggregate(pieces, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.repeat(F.lit("</mark>"), acc["open"])))
