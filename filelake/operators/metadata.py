"""Decoded media, image and package records to searchable ``(path, key, value, num)`` rows.

Each job builds one array of fields per file and explodes it, so mapping, clean-up and the removal of repeats
stay inside the row and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import fixed, paths, probe, values

FIELD = "struct<key:string,value:string,num:double>"


# --- fields ------------------------------------------------------------------------------------------------

def text_field(key: str, value: Column, keep: Column | None = None) -> Column:
    f = F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), F.lit(None).cast("double").alias("num"))
    return f if keep is None else F.when(keep, f)


def number_field(key: str, value: Column, keep: Column) -> Column:
    v = value.cast("double")
    return F.when(keep, F.struct(F.lit(key).alias("key"), values.format_number(v).alias("value"), v.alias("num")))


def normalize_array(fields: Column, max_fields: int | None = None, max_bytes: int | None = None) -> Column:
    """Clean-up of one file's fields: no key or no content drops a field, non-finite numbers go, an empty value
    with a number shows the number, repeats of a key and value keep the first. Limits only where asked for."""
    # Each transform names a value once, so no expression is worked out twice per field.
    present = F.filter(fields, lambda f: f.isNotNull() & (F.coalesce(f["key"], F.lit("")) != ""))
    clean = F.transform(present, lambda f: F.struct(
        f["key"].alias("key"), values.printable(f["value"]).alias("value"), F.when(F.abs(f["num"]) < float("inf"), f["num"]).alias("num")))
    shown = F.transform(clean, lambda f: F.struct(
        f["key"].alias("key"),
        F.when(F.coalesce(f["value"], F.lit("")) != "", values.cut_bytes(f["value"], max_bytes)).otherwise(values.format_number(f["num"])).alias("value"),
        f["num"].alias("num")))
    held = F.filter(shown, lambda f: f["value"].isNotNull())
    # The array is bound once; a field stays where its key and value stand for the first time.
    first = F.element_at(F.transform(F.array(held), lambda fs: F.element_at(F.transform(
        F.array(F.transform(fs, lambda f: F.struct(f["key"].alias("key"), f["value"].alias("value")))),
        lambda pairs: F.filter(fs, lambda f, i: F.array_position(pairs, F.get(pairs, i)) == i + 1)), 1)), 1)
    return first if max_fields is None else F.slice(first, 1, max_fields)


def to_rows(df: DataFrame, fields: Column, max_fields: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row per field of each file. The outer form keeps Catalyst from building the array once more in a filter."""
    arrays = df.select("path", fields.alias("_fields")).select("path", normalize_array(F.col("_fields"), max_fields, max_bytes).alias("_fields"))
    return arrays.select("path", F.inline_outer("_fields")).where("key IS NOT NULL")


def dedupe_fields(rows: DataFrame) -> DataFrame:
    """Exact (key, value) repeats of a file become one row."""
    return rows.groupBy("path", "key", "value").agg(F.max("num").alias("num"))


def normalize_fields(rows: DataFrame, max_fields: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The same clean-up for rows ``(path, ord, key, value, num)`` that are not one array per file; repeats stay.

    Without limits nothing is shuffled. With ``max_fields`` the first so many of each file are returned.
    """
    num = F.when(F.abs("num") < float("inf"), F.col("num"))
    value = F.coalesce(values.clean_value("value", max_bytes), F.lit(""))
    cleaned = rows.where(F.coalesce("key", F.lit("")) != "").select("path", "ord", "key", value.alias("value"), num.alias("num"))
    shown = cleaned.withColumn("value", F.when(F.col("value") != "", F.col("value")).otherwise(values.format_number("num")))
    shown = shown.where("value IS NOT NULL")
    if max_fields is not None:
        rank = F.row_number().over(W.partitionBy("path").orderBy("ord"))
        shown = shown.withColumn("_r", rank).where(F.col("_r") <= max_fields)
    return shown.select("path", "key", "value", "num")


# --- media -------------------------------------------------------------------------------------------------

def parse_probes(probes: DataFrame) -> DataFrame:
    """``(path, json)`` to ``(path, probe)``; unreadable JSON gives a NULL probe."""
    return probes.select("path", F.from_json("json", schema.PROBE).alias("probe"))


def _language(s: Column) -> Column:
    lang = F.lower(F.trim(probe.tag_value(s["tags"], "language")))
    return F.when(lang != "und", lang)


def _container_columns(p: Column, ext: Column) -> dict[str, Column]:
    """Facts of the container as columns, so each is worked out once however often a field uses it."""
    return {
        "_duration": probe.duration_of(p), "_rate": probe.positive_int(p["format"]["bit_rate"]),
        "_container": probe.container_of(p["format"]["format_name"], ext),
    }


def _container_fields(group: str) -> list[Column]:
    c = F.col
    out = [number_field(f"{group}.durationSec", c("_duration"), c("_duration") > 0), number_field(f"{group}.bitrate", c("_rate"), c("_rate") > 0)]
    return [*out, text_field("video.container", c("_container"))] if group == "video" else out


def video_fields(probes: DataFrame) -> DataFrame:
    """Fields of the first real video stream, of every audio and subtitle stream, and of the container.

    Attached pictures are skipped, and still-image codecs too where the file has other streams.
    """
    p = F.col("probe")
    streams = F.coalesce(p["streams"], F.array().cast(schema.PROBE["streams"].dataType))
    name = lambda s: F.coalesce(s["codec_name"], F.lit(""))
    real = F.filter(
        F.col("streams"),
        lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 1)
        & (name(s) != "") & ~(name(s).isin(*fixed.STILL_CODECS) & (F.size("streams") > 1)),
    )
    v = F.col("v")
    sized = (v["width"] > 0) & (v["height"] > 0) & (v["width"] <= 65536) & (v["height"] <= 65536)
    tracks = F.transform(
        F.filter("streams", lambda s: s["codec_type"].isin("audio", "subtitle")),
        lambda s: F.struct((s["codec_type"] == "audio").alias("audio"), s["codec_name"].alias("codec"), s["channels"].alias("channels"),
                           _language(s).alias("lang")))
    facts = (
        probes.withColumn("streams", streams).withColumn("v", F.try_element_at(real, F.lit(1)))
        .withColumns({
            "_depth": probe.bit_depth(v["bits_per_raw_sample"], v["pix_fmt"]), "_fps": probe.fps(v["avg_frame_rate"], v["r_frame_rate"]),
            "_hdr": probe.hdr_class(v["side_data_list"], v["color_transfer"]), "_tracks": tracks,
            **_container_columns(p, paths.file_ext(paths.base_name("path")))})
    )
    has = v.isNotNull()
    picture = F.array(
        text_field("video.codec", v["codec_name"], has), number_field("video.width", v["width"], has & sized),
        number_field("video.height", v["height"], has & sized), text_field("video.hdr", F.col("_hdr"), has),
        number_field("video.bitDepth", F.col("_depth"), has & (F.col("_depth") > 0)),
        number_field("video.fps", F.col("_fps"), has & (F.col("_fps") > 0)),
    )
    others = F.flatten(F.transform("_tracks", lambda t: F.when(
        t["audio"], F.array(
            text_field("video.audioCodec", t["codec"]),
            number_field("video.audioChannels", t["channels"], (t["channels"] > 0) & (t["channels"] <= 64)), text_field("video.audioLang", t["lang"])),
    ).otherwise(F.array(text_field("video.subtitleLang", t["lang"])))))
    found = F.filter(F.concat(picture, others), lambda f: f.isNotNull() & (F.coalesce(f["value"], F.lit("")) != ""))
    all_fields = F.concat("_found", F.array(*_container_fields("video")))
    none = F.array().cast(f"array<{FIELD}>")
    return to_rows(facts.withColumn("_found", found), F.when(F.size("_found") > 0, all_fields).otherwise(none))


def audio_fields(probes: DataFrame, tags: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Tag fields first, then facts of the first audio stream; format tags stand in where there is no tag record,
    and the codec implied by the extension where there is nothing at all.

    ``tags(path, artist, album_artist, album, title, genre, year, track)`` has one row per tagged file.
    """
    p, t = F.col("probe"), F.col("t")
    tag_rows = tags.select("path", F.struct(*[c for c in tags.columns if c != "path"]).alias("t"))
    both = probes.select("path", "probe").join(tag_rows, "path", "full_outer")
    if candidates is not None:
        both = candidates.select("path").join(both, "path", "left")
    both = both.withColumn("a", F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1)))
    a, tagged, probed = F.col("a"), t.isNotNull(), p.isNotNull()
    text_tags = ("artist", "album_artist", "album", "title", "genre")
    keys = dict(zip(text_tags, ("audio.artist", "audio.albumArtist", "audio.album", "audio.title", "audio.genre")))
    own = [text_field(keys[c], t[c], tagged) for c in text_tags]
    own.append(number_field("audio.year", t["year"], tagged & (t["year"] > 0) & (t["year"] < 3000)))
    own.append(number_field("audio.track", t["track"], tagged & (t["track"] > 0) & (t["track"] < 10000)))
    ext = paths.file_ext(paths.base_name("path"))
    both = both.withColumns({"_sample": probe.positive_int(a["sample_rate"]), **_container_columns(p, ext)})
    rate = F.col("_sample")
    stream = [
        text_field("audio.codec", a["codec_name"]), number_field("audio.sampleRate", rate, (rate > 0) & (rate <= 1_000_000)),
        number_field("audio.channels", a["channels"], (a["channels"] > 0) & (a["channels"] <= 64)),
    ]
    ft = p["format"]["tags"]
    loose = probed & ~tagged
    year, track = values.year_of(probe.tag_value(ft, "date", "year")), values.leading_int(probe.tag_value(ft, "track"))
    names = {"artist": ("artist",), "album_artist": ("album_artist", "albumartist"), "album": ("album",), "title": ("title",), "genre": ("genre",)}
    from_format = [text_field(keys[c], probe.tag_value(ft, *n), loose) for c, n in names.items()]
    from_format += [number_field("audio.year", year, loose & (year > 0)), number_field("audio.track", track, loose & (track > 0) & (track < 10000))]
    fields = F.filter(F.array(*own, *stream, *_container_fields("audio"), *from_format),
                      lambda f: f.isNotNull() & (F.coalesce(f["value"], F.lit("")) != ""))
    implied = F.array(text_field("audio.codec", paths.lookup(fixed.CODEC_BY_EXT, ext)))
    return to_rows(both.withColumn("_f", fields), F.when((F.size("_f") == 0) & ~tagged, implied).otherwise(F.col("_f")))


def image_fields(exif: DataFrame) -> DataFrame:
    """Range-checked and rounded image facts; a record that says nothing beyond "no GPS" gives no rows.

    Columns: path, make, model, lens, software, iso, f_number, exposure_time, focal_length, date_taken (timestamp),
    width, height, ifd_width, ifd_height, orientation, lat, lon.
    """
    c = F.col
    r = probe.round_half_away
    own = (F.coalesce("width", F.lit(0)) > 0) & (F.coalesce("height", F.lit(0)) > 0)
    w, h = F.when(own, c("width")).otherwise(c("ifd_width")), F.when(own, c("height")).otherwise(c("ifd_height"))
    sized = (w > 0) & (h > 0) & (w <= 1 << 17) & (h <= 1 << 17)
    lat, lon = F.coalesce("lat", F.lit(0.0)), F.coalesce("lon", F.lit(0.0))
    located = ((lat != 0) | (lon != 0)) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    taken = c("date_taken")
    dated = (F.year(taken) > 1900) & (F.year(taken) < 2200)
    date = F.struct(F.lit("image.dateTaken").alias("key"), F.date_format(taken, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"),
                    F.unix_seconds(taken).cast("double").alias("num"))
    names = F.array(*[F.lit(o) for o in fixed.ORIENTATIONS])
    facts = F.array(
        text_field("image.cameraMake", c("make")), text_field("image.cameraModel", c("model")),
        text_field("image.lens", c("lens")), text_field("image.software", c("software")),
        number_field("image.iso", c("iso"), (c("iso") > 0) & (c("iso") < 10_000_000)),
        number_field("image.fNumber", r(c("f_number"), 2), (c("f_number") > 0) & (c("f_number") < 1000)),
        number_field("image.exposureTime", r(c("exposure_time"), 6), (c("exposure_time") > 0) & (c("exposure_time") < 1e6)),
        number_field("image.focalLength", r(c("focal_length"), 2), (c("focal_length") > 0) & (c("focal_length") < 100_000)),
        F.when(dated, date), number_field("image.width", w, sized), number_field("image.height", h, sized),
        text_field("image.orientation", F.when(c("orientation").between(1, 8), F.get(names, (c("orientation") - 1).cast("int")))),
    )
    facts = F.filter(facts, lambda f: f.isNotNull() & (F.coalesce(F.trim(f["value"]), F.lit("")) != ""))
    place = F.when(located, F.array(
        text_field("image.gps", F.lit("yes")), number_field("image.gpsLat", r(lat, 6), located),
        number_field("image.gpsLon", r(lon, 6), located))).otherwise(F.array(text_field("image.gps", F.lit("no"))))
    none = F.array().cast(f"array<{FIELD}>")
    return to_rows(exif.withColumn("_f", facts), F.when((F.size("_f") > 0) | located, F.concat("_f", place)).otherwise(none))


# --- packages ----------------------------------------------------------------------------------------------

def split_depends(text: Column | str, most: int | None = None) -> Column:
    """Bare package names of a dependency list: versions, architectures and restrictions cut off."""
    t = F.col(text) if isinstance(text, str) else text
    names = F.transform(
        F.split(t, "[,|]"),
        lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"(?s)[(\[<].*$", ""), r"^\s+|\s+$", ""), r"(?s)^([^:]+):.*$", "$1"),
    )
    found = F.filter(names, lambda n: n != "")
    return found if most is None else F.slice(found, 1, most)


def control_entries(control: Column) -> Column:
    """Fields of the first paragraph of a control text as structs ``key`` (lower case) and ``value``, in order;
    continuation lines are kept on their own lines."""
    paragraphs = F.split(F.regexp_replace(control, "\r\n", "\n"), r"\n[ \t]*(?:\n[ \t]*)*\n")
    lines = lambda p: F.split(F.regexp_replace(p, r"\n[ \t]+", "\x01"), "\n")
    fields = F.transform(paragraphs, lambda p: F.filter(lines(p), lambda line: line.rlike(r"^[^ \t:][^:]*:")))
    first = F.try_element_at(F.filter(fields, lambda ls: F.size(ls) > 0), F.lit(1))
    trimmed = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[^:]*:", ""), r"^\s+|\s+$", "")
    return F.transform(first, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.regexp_replace(trimmed(x), r"\s*\x01\s*", "\n").alias("value")))


def control_field(entries: Column, key: str) -> Column:
    """Value of one field among ``control_entries``; the last one counts."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))["value"]


def deb_fields(control: DataFrame) -> DataFrame:
    """Fields of ``(path, control)`` package descriptions. Each text is cut into its fields once."""
    wanted = ("package", "version", "architecture", "section", "maintainer", "description", "installed-size", "depends", "pre-depends")
    entries = control.select("path", control_entries(F.col("control")).alias("_entries"))
    parsed = entries.select("path", *[control_field(F.col("_entries"), k).alias(k.replace("-", "_")) for k in wanted])
    kib = F.when(F.trim("installed_size").rlike("^[0-9]{1,18}$"), F.trim("installed_size").try_cast("long"))
    depends = F.transform(
        split_depends(F.concat_ws(",", "depends", "pre_depends")), lambda d: text_field("package.depends", d))
    fields = F.array(
        text_field("package.format", F.lit("deb")), text_field("package.name", F.col("package")),
        text_field("package.version", F.col("version")), text_field("package.arch", F.col("architecture")),
        text_field("package.section", F.col("section")), text_field("package.maintainer", F.col("maintainer")),
        text_field("package.summary", F.split_part("description", F.lit("\n"), F.lit(1))),
        number_field("package.installedSize", kib * 1024, kib < 1 << 40),
    )
    return to_rows(parsed, F.concat(fields, depends))


def rpm_fields(tag_rows: DataFrame) -> DataFrame:
    """Fields of package header tags ``(path, tag, strings array<string>, number long)``."""
    def text_of(name: str) -> Column:
        return F.max(F.when(F.col("tag") == fixed.RPM_TAGS[name], F.try_element_at("strings", F.lit(1)))).alias(name)

    names = ("name", "version", "release", "arch", "summary", "group", "packager", "license", "vendor")
    keys = ("name", "version", "release", "arch", "summary", "section", "maintainer", "license", "vendor")
    wide = tag_rows.groupBy("path").agg(
        *[text_of(n) for n in names],
        F.max(F.when(F.col("tag") == fixed.RPM_TAGS["size"], F.col("number"))).alias("size"),
        F.max(F.when(F.col("tag") == fixed.RPM_TAGS["requires"], F.col("strings"))).alias("requires"),
    )
    real = F.filter("requires", lambda d: ~d.startswith("rpmlib(") & ~d.startswith("/"))
    fields = [text_field("package.format", F.lit("rpm"))] + [text_field(f"package.{k}", F.col(n)) for k, n in zip(keys, names)]
    fields.append(number_field("package.installedSize", F.col("size"), F.col("size") >= 0))
    depends = F.coalesce(F.transform(real, lambda d: text_field("package.depends", d)), F.array().cast(f"array<{FIELD}>"))
    return to_rows(wide, F.concat(F.array(*fields), depends))


# --- all categories ----------------------------------------------------------------------------------------

Extractor = Callable[[DataFrame], DataFrame]


def extract_metadata(candidates: DataFrame, extractors: dict[str, Extractor]) -> tuple[DataFrame, DataFrame]:
    """Run one extractor per category over the candidates of that category.

    An extractor maps ``(path, ext)`` rows to ``(path, key, value, num)`` rows, plus ``error`` for a file it could
    not read. Returns the metadata rows and the error rows; one bad file costs only itself.
    """
    tagged = candidates.withColumn("category", paths.category_of_ext("ext"))
    out = None
    for category, extractor in extractors.items():
        rows = extractor(tagged.where(F.col("category") == category).select("path", "ext"))
        if "error" not in rows.columns:
            rows = rows.withColumn("error", F.lit(None).cast("string"))
        rows = rows.select("path", "key", "value", "num", "error")
        out = rows if out is None else out.unionByName(rows)
    return out.where("error IS NULL AND key IS NOT NULL").drop("error"), out.where("error IS NOT NULL").select("path", "error")
