"""Tokenising, query splitting and text extraction as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .paths import _col


@cache
def _accent_table() -> tuple[str, str]:
    """Precomposed lower-case letters and their base letters, from the Unicode decompositions."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and char == char.lower() and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            source.append(char)
            target.append(parts[0])
    return "".join(source), "".join(target)


def fold(text: Column | str) -> Column:
    """Lower case without diacritics. Texts of plain ASCII skip the accent table."""
    low = F.lower(_col(text))
    source, target = _accent_table()
    stripped = F.regexp_replace(F.translate(low, source, target), r"[̀-ͯ]", "")
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(stripped)


def tokenize_names(text: Column | str) -> Column:
    """Letters, digits and ``. _ -`` make a token, so ``server.log`` is one."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}._-]+"), F.lit(0))


def tokenize_body(text: Column | str) -> Column:
    """Letters and digits make a token; everything else separates."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def split_query(q: Column | str) -> Column:
    """Search text as an array of ``(kind, text)``, kind being ``term`` or ``phrase``.

    A quote toggles phrase mode and ends the word before it; an open quote runs to the end. Bare upper-case
    AND, OR, NOT, NEAR and parts without a letter or digit are dropped.
    """
    pieces = F.split(F.coalesce(_col(q), F.lit("")), '"')

    def piece(text: Column, i: Column) -> Column:
        phrase = F.array(F.struct(F.lit("phrase").alias("kind"), text.alias("text")))
        words = F.filter(
            F.split(text, r"(?U)\s+"), lambda w: ~w.isin("AND", "OR", "NOT", "NEAR")
        )
        terms = F.transform(words, lambda w: F.struct(F.lit("term").alias("kind"), w.alias("text")))
        return F.when(i % 2 == 1, phrase).otherwise(terms)

    return F.filter(F.flatten(F.transform(pieces, piece)), lambda p: p["text"].rlike(r"[\p{L}\p{Nd}]"))


def is_binary(raw: Column | str, sniff: int | None = fixed.BINARY_SNIFF_BYTES) -> Column:
    """A NUL byte in the first ``sniff`` bytes (None: anywhere)."""
    head = F.hex(_col(raw) if sniff is None else F.substring(_col(raw), 1, sniff))
    return head.rlike("^(..)*?00")


def sanitize_body(text: Column | str) -> Column:
    """Without NUL and the two characters that later delimit marks."""
    return F.regexp_replace(_col(text), r"[\x00\x02\x03]", "")


def extract_text(raw: Column | str, cap: int | None = None) -> Column:
    """Body text of raw bytes: NULL when binary, invalid UTF-8 replaced; with ``cap`` only so many bytes are read."""
    read = _col(raw) if cap is None else F.substring(_col(raw), 1, cap)
    text = F.make_valid_utf8(read.cast("string"))
    return F.when(~is_binary(raw), sanitize_body(text))


def detect_encoding(raw: Column | str, at_start: bool = True) -> Column:
    """Byte-order mark, else UTF-8 when valid (a character cut at the end is forgiven), else windows-1252."""
    b = _col(raw)
    out = F.when(F.lit(False), F.lit(""))
    if at_start:
        for name, mark in fixed.BYTE_ORDER_MARKS:
            out = out.when(F.substring(b, 1, len(mark)) == F.lit(mark), F.lit(name))
    whole = F.is_valid_utf8(b.cast("string"))
    # The last one to three bytes may start a character that the window cut in half.
    tails = [
        (r"(C[2-9A-F]|D.|E.|F[0-4])$", 1),
        (r"(E.|F[0-4])[89AB].$", 2),
        (r"F[0-4][89AB].[89AB].$", 3),
    ]
    cut_ok = F.lit(False)
    for pattern, n in tails:
        last = F.hex(F.substr(b, F.greatest(F.octet_length(b) - (n - 1), F.lit(1)), F.lit(n)))
        rest = F.substr(b, F.lit(1), F.greatest(F.octet_length(b) - n, F.lit(0)))
        cut_ok = cut_ok | (last.rlike("^" + pattern) & F.is_valid_utf8(rest.cast("string")))
    return out.when(whole | cut_ok, F.lit("utf-8")).otherwise(F.lit(fixed.FALLBACK_ENCODING))
