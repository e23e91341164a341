"""Column functions over media probe records (a struct of ``format`` and ``streams``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col
from .values import finite_number


def positive_number(text: Column | str) -> Column:
    """Finite number not below zero, else 0."""
    n = finite_number(F.trim(_col(text)))
    return F.when(n >= 0, n).otherwise(F.lit(0.0))


def positive_int(text: Column | str) -> Column:
    n = F.when(F.trim(_col(text)).rlike("^[+-]?[0-9]+$"), F.trim(_col(text)).try_cast("long"))
    return F.when(n >= 0, n).otherwise(F.lit(0)).cast("long")


def round_half_away(v: Column, decimals: int) -> Column:
    p = float(10**decimals)
    return F.signum(v) * F.floor(F.abs(v) * p + 0.5) / p


def _rate(text: Column | str) -> Column:
    t = _col(text)
    n, d = finite_number(F.substring_index(t, "/", 1)), finite_number(F.regexp_extract(t, "^[^/]*/(.*)$", 1))
    return F.when(t.contains("/") & (d != 0) & (n > 0), round_half_away(n / F.nullif(d, F.lit(0.0)), 3))


def fps(average: Column | str, nominal: Column | str, sane: bool = True) -> Column:
    """First usable of two ``n/d`` rates, three decimals; rates above 1000 are skipped when ``sane``; else 0."""
    rates = [_rate(average), _rate(nominal)]
    if sane:
        rates = [F.when(r <= 1000, r) for r in rates]
    return F.coalesce(*rates, F.lit(0.0))


def clock_seconds(text: Column | str) -> Column:
    """``HH:MM:SS.fraction`` in seconds, else 0."""
    t = F.trim(_col(text))
    h, m = F.split_part(t, F.lit(":"), F.lit(1)), F.split_part(t, F.lit(":"), F.lit(2))
    s = F.split_part(t, F.lit(":"), F.lit(3))
    ok = t.rlike(r"^[0-9]+:[0-9]+:([0-9]+\.?[0-9]*|\.[0-9]+)$")
    seconds = h.try_cast("int") * 3600.0 + m.try_cast("int") * 60.0 + s.try_cast("double")
    return F.coalesce(F.when(ok, seconds), F.lit(0.0))


def tag_value(tags: Column | str, *names: str) -> Column:
    """First non-blank value among the names, keys compared without case; NULL when there is none."""
    entries = F.map_entries(_col(tags))

    def one(name: str) -> Column:
        hits = F.filter(entries, lambda e: (F.lower(e["key"]) == name.lower()) & (F.trim(e["value"]) != ""))
        return F.try_element_at(hits, F.lit(1))["value"]

    return F.coalesce(*[one(n) for n in names])


def duration_of(probe: Column | str) -> Column:
    """Container duration, else the first stream's own duration or DURATION tag; 0 when unknown."""
    p = _col(probe)
    per_stream = F.transform(
        p["streams"],
        lambda s: F.when(positive_number(s["duration"]) > 0, positive_number(s["duration"]))
        .otherwise(clock_seconds(tag_value(s["tags"], "DURATION"))),
    )
    first = F.try_element_at(F.filter(per_stream, lambda d: d > 0), F.lit(1))
    whole = positive_number(p["format"]["duration"])
    return F.when(whole > 0, whole).otherwise(F.coalesce(first, F.lit(0.0)))


def container_of(format_name: Column | str, ext: Column | str) -> Column:
    """The file's own extension when the format list has it, matroska for mkv/mka, else the first name."""
    names, e = F.split(F.coalesce(_col(format_name), F.lit("")), ","), _col(ext)
    return (
        F.when(F.array_contains(names, e), e)
        .when(e.isin("mkv", "mka") & F.array_contains(names, "matroska"), F.lit("matroska"))
        .otherwise(F.nullif(names[0], F.lit("")))
    )


def bit_depth(raw_bits: Column | str, pix_fmt: Column | str) -> Column:
    """Raw sample bits (1..32), else read off the pixel format, 8 by default; 0 without a pixel format."""
    bits, pf = positive_int(raw_bits), F.coalesce(_col(pix_fmt), F.lit(""))
    out = F.when((bits > 0) & (bits <= 32), bits).when(pf == "", F.lit(0)).when(pf.rlike("p16|16le$|16be$"), F.lit(16))
    for n in (14, 12, 10, 9):
        out = out.when(pf.contains(f"p{n}"), F.lit(n))
    return out.otherwise(F.lit(8)).cast("long")


def hdr_class(side_data: Column | str, transfer: Column | str) -> Column:
    """dolbyvision when any side data says so, else hdr10, hlg or none by the transfer characteristic."""
    dovi = F.exists(_col(side_data), lambda d: F.lower(d["side_data_type"]).contains("dovi"))
    return (
        F.when(F.coalesce(dovi, F.lit(False)), F.lit("dolbyvision")).when(_col(transfer) == "smpte2084", F.lit("hdr10"))
        .when(_col(transfer) == "arib-std-b67", F.lit("hlg")).otherwise(F.lit("none"))
    )
