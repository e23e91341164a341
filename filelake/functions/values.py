"""Column functions over metadata values, filters and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .paths import _col, lookup

FILTER_PATTERN = r"(?s)^\s*([a-z]+(?:\.[A-Za-z]+)?)\s*(>=|<=|!=|=|~|>|<)\s*(.*\S)\s*$"
DIGITS = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def printable(value: Column | str) -> Column:
    """Tab and line ends become spaces, other controls go, blanks at both ends go."""
    v = F.regexp_replace(F.translate(_col(value), "\t\n\r", "   "), r"[\x00-\x1f\x7f]", "")
    return F.regexp_replace(v, r"^\s+|\s+$", "")


def cut_bytes(text: Column, max_bytes: int | None = None) -> Column:
    """At most ``max_bytes`` of UTF-8, whole characters only, no blanks left at the cut; the whole text if unset."""
    if max_bytes is None:
        return text
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.regexp_replace(_longest_valid(raw, max_bytes), r"\s+$", ""))


def clean_value(value: Column | str, max_bytes: int | None = None) -> Column:
    """A metadata value as stored: printable, trimmed, and cut on a character boundary where a limit is asked for."""
    return cut_bytes(printable(value), max_bytes)


def _longest_valid(raw: Column, max_bytes: int) -> Column:
    shorter = [F.substring(raw, 1, max_bytes - k).cast("string") for k in (0, 1, 2, 3)]
    return F.coalesce(*[F.when(F.is_valid_utf8(s), s) for s in shorter])


def format_number(value: Column | str) -> Column:
    """Integers without a point, anything else with at most four decimals and no trailing zeros."""
    v = _col(value)
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    # Halves go to the even digit; the decimal holds every double that has a fraction.
    exact = F.bround(v.try_cast("decimal(38,10)"), 4).cast("decimal(38,4)").cast("string")
    text = F.regexp_replace(F.coalesce(exact, F.format_string("%.4f", v)), r"0+$", "")
    return F.when(whole, v.cast("long").cast("string")).when(v.isNotNull(), F.regexp_replace(text, r"\.$", ""))


def finite_number(text: Column | str) -> Column:
    """The finite double a text spells in decimal form, else NULL."""
    t = _col(text)
    d = F.when(t.rlike(DIGITS), t.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def parse_numeric_value(value: Column | str, field_type: Column | str) -> Column:
    """Number behind a filter value; date fields also take RFC 3339 and ISO dates, as unix seconds (UTC)."""
    v = _col(value)
    kind = _col(field_type)
    zoned = F.when(
        v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), v.try_cast("timestamp")
    )
    plain = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"), v.try_cast("timestamp"))
    stamp = F.floor(F.unix_micros(F.coalesce(zoned, plain)) / F.lit(1_000_000)).cast("double")
    return F.coalesce(finite_number(v), F.when(kind == "date", stamp))


def parse_filter(text: Column | str) -> Column:
    """``<key><op><value>`` as a struct; the first operator after the key wins. NULL when malformed."""
    t = _col(text)
    part = [F.regexp_extract(t, FILTER_PATTERN, i) for i in (1, 2, 3)]
    return F.when(
        t.rlike(FILTER_PATTERN), F.struct(part[0].alias("key"), part[1].alias("op"), part[2].alias("value"))
    )


def bytes_of(value: Column | str, unit: Column | str) -> Column:
    """Bytes of a number with a unit, rounded half up; NULL when empty, negative or not a number."""
    n = finite_number(F.trim(_col(value)))
    mult = F.coalesce(lookup(fixed.BYTE_UNITS, _col(unit)), F.lit(1))
    return F.when(n >= 0, F.floor(n * mult.cast("double") + 0.5).cast("long"))


def split_bytes(n: Column | str) -> Column:
    """``(value, unit)`` with the largest unit that divides ``n`` exactly."""
    v = _col(n)
    out = None
    for unit, mult in sorted(fixed.BYTE_UNITS.items(), key=lambda u: -u[1]):
        cond = (v >= mult) & (v % mult == 0)
        pair = F.struct((v / mult).cast("long").cast("string").alias("value"),
                        F.lit(unit).alias("unit"))
        out = F.when(cond, pair) if out is None else out.when(cond, pair)
    return out.otherwise(F.struct(v.cast("string").alias("value"), F.lit("B").alias("unit")))


def year_of(text: Column | str) -> Column:
    """Four-digit year 1000..2999 at the start, not followed by a fifth digit; else 0."""
    y = F.regexp_extract(F.trim(_col(text)), r"^([12][0-9]{3})(?![0-9])", 1)
    return F.when(y == "", F.lit(0)).otherwise(y.try_cast("int")).cast("long")


def leading_int(text: Column | str) -> Column:
    """Leading decimal digits (``3/12`` gives 3), at most nine; 0 without any."""
    n = F.regexp_extract(_col(text), r"^([0-9]{1,9})", 1)
    return F.when(n == "", F.lit(0)).otherwise(n.try_cast("int")).cast("long")
