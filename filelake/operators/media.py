"""Playback planning over tables of probes, devices and keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed, paths, probe

BAD_REQUEST, ENCODING_ERROR, TOO_LARGE = "BAD_REQUEST", "ENCODING_ERROR", "TOO_LARGE"


def probe_records(parsed: DataFrame) -> DataFrame:
    """Parsed probes ``(path, probe)`` as flat records: container, duration, bitrate, start, the video stream a
    session would use (attached pictures skipped), audio and subtitle tracks; ``error_code`` when nothing plays."""
    p = F.col("probe")
    rows = parsed.withColumn("v", F.try_element_at(F.filter(
        p["streams"], lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 1)),
        F.lit(1)))
    v = F.col("v")

    def tag(s: Column, name: str) -> Column:
        return F.coalesce(probe.tag_value(s["tags"], name), F.lit(""))

    def tracks(kind: str) -> Column:
        return F.coalesce(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.filter(p["streams"], lambda s: F.lit(False)))

    audio = F.transform(tracks("audio"), lambda s: F.struct(
        s["index"].alias("index"), s["codec_name"].alias("codec"), s["channels"].alias("channels"), tag(s, "language").alias("lang"),
        tag(s, "title").alias("title"), (F.coalesce(s["disposition"]["default"], F.lit(0)) == 1).alias("default")))
    subtitles = F.transform(tracks("subtitle"), lambda s: F.struct(
        s["index"].alias("index"), s["codec_name"].alias("codec"), tag(s, "language").alias("lang"), tag(s, "title").alias("title")))
    video = F.when(v.isNotNull(), F.struct(
        v["index"].alias("index"), v["codec_name"].alias("codec"), v["profile"].alias("profile"), v["width"].alias("width"),
        v["height"].alias("height"), probe.fps(v["avg_frame_rate"], v["r_frame_rate"], sane=False).alias("fps"),
        probe.positive_int(v["bit_rate"]).alias("bitrate")))
    out = rows.select(
        "path", p["format"]["format_name"].alias("container"), probe.duration_of(p).alias("duration_sec"),
        probe.positive_int(p["format"]["bit_rate"]).alias("bitrate"), probe.positive_number(p["format"]["start_time"]).alias("start_sec"),
        video.alias("video"), audio.alias("audio"), subtitles.alias("subtitles"), p.isNull().alias("_unread"))
    nothing = F.col("video").isNull() & (F.coalesce(F.size("audio"), F.lit(0)) <= 0)
    return out.withColumn("error_code", F.when(F.col("_unread") | nothing, F.lit(ENCODING_ERROR))).drop("_unread")


def pick_audio(audio: Column | str, index: Column | str) -> Column:
    """The requested track, else the default-flagged one, else the first; NULL when the index is not a track."""
    tracks = F.col(audio) if isinstance(audio, str) else audio
    i = F.coalesce(F.col(index) if isinstance(index, str) else index, F.lit(-1))
    asked = F.try_element_at(F.filter(tracks, lambda t: t["index"] == i), F.lit(1))
    flagged = F.try_element_at(F.filter(tracks, lambda t: t["default"]), F.lit(1))
    return F.when(i >= 0, asked).otherwise(F.coalesce(flagged, F.try_element_at(tracks, F.lit(1))))


def known_codecs(can: Column | str) -> Column:
    """A device's codec list in lower case with aliases resolved."""
    c = F.col(can) if isinstance(can, str) else can
    clean = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(F.transform(clean, lambda x: F.coalesce(paths.lookup(fixed.CODEC_ALIASES, x), x)), lambda x: x != ""))


def codec_name(codec: Column) -> Column:
    named = F.when(codec.startswith("pcm_"), F.lit("PCM")).otherwise(F.upper(codec))
    return F.coalesce(paths.lookup(fixed.CODEC_NAMES, codec), named)


def container_name(container: Column) -> Column:
    return F.coalesce(paths.lookup(fixed.CONTAINER_NAMES, container), F.upper(F.substring_index(container, ",", 1)))


def max_rate(height: Column | str) -> Column:
    """Bitrate ceiling of re-encoded video by output height."""
    h = F.col(height) if isinstance(height, str) else height
    out = None
    for top, rate in fixed.BITRATE_LADDER:
        out = F.when(h <= top, F.lit(rate)) if out is None else out.when(h <= top, F.lit(rate))
    return out.otherwise(F.lit(fixed.BITRATE_TOP)).cast("long")


def even_height(height: Column) -> Column:
    return (height - height % 2).cast("int")


def even_width(width: Column, height: Column, new_height: Column) -> Column:
    """Width for the new height, aspect kept, rounded to the nearest whole and then up to even."""
    w = F.floor(width.cast("double") * new_height / F.nullif(height, F.lit(0)) + 0.5)
    return F.when((width > 0) & (height > 0) & (new_height > 0), w + w % 2).otherwise(F.lit(0)).cast("int")


def scaled_size(width: Column | str, height: Column | str, max_height: Column | str) -> Column:
    """``(width, height)`` of a downscaled picture, both even."""
    w, h, m = (F.col(c) if isinstance(c, str) else c for c in (width, height, max_height))
    return F.struct(even_width(w, h, even_height(m)).alias("width"), even_height(m).alias("height"))


def playback_plan(records: DataFrame, devices: DataFrame, requests: DataFrame, sparse: DataFrame | None = None,
                  max_segments: int | None = None) -> DataFrame:
    """What to do with the chosen streams of each request.

    ``requests(request_id, path, device_id, audio_index, max_height)`` meet probe records by path and
    ``devices(device_id, can)`` by id. A stream is copied when the device plays its codec and segments can carry
    it; a lower height, or keyframes too far apart (``sparse(path, sparse)``), re-encode the video. With ``max_segments``
    plans of more segments are refused with an error code.
    """
    asked = requests.join(records, "path").join(devices.select("device_id", known_codecs("can").alias("can")), "device_id", "left")
    if sparse is not None:
        asked = asked.join(sparse.select("path", "sparse"), "path", "left")
    else:
        asked = asked.withColumn("sparse", F.lit(False))
    asked = asked.withColumn("a", pick_audio("audio", "audio_index")).withColumn(
        "can", F.coalesce("can", F.array().cast("array<string>")))
    v, a, want = F.col("video"), F.col("a"), F.coalesce("max_height", F.lit(0))
    index = F.coalesce("audio_index", F.lit(-1))
    error = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(want < 0, F.lit(BAD_REQUEST))
        .when((index >= 0) & a.isNull(), F.lit(BAD_REQUEST)).when(F.col("duration_sec") <= 0, F.lit(ENCODING_ERROR))
    )
    has_v, has_a = v.isNotNull(), a.isNotNull()
    plays_v, plays_a = F.array_contains("can", v["codec"]), F.array_contains("can", a["codec"])
    smaller = (want > 0) & (want < v["height"])
    size = scaled_size(v["width"], v["height"], want)
    video_reason = (
        F.when(~has_v, F.lit(None).cast("string"))
        .when(smaller, F.concat(F.lit("downscaling "), v["height"].cast("string"), F.lit("p to "), size["height"].cast("string"), F.lit("p at the client's request")))
        .when(~plays_v, F.concat(codec_name(v["codec"]), F.lit(" video is not supported by this browser")))
        .when(~v["codec"].isin(*fixed.TS_VIDEO_CODECS), F.concat(codec_name(v["codec"]), F.lit(" video cannot be carried in MPEG-TS segments")))
        .when(F.coalesce("sparse", F.lit(False)), F.lit("keyframes are too far apart to cut the video into segments without re-encoding"))
    )
    audio_reason = (
        F.when(~has_a, F.lit(None).cast("string"))
        .when(~plays_a, F.concat(codec_name(a["codec"]), F.lit(" audio is not supported by this browser")))
        .when(~a["codec"].isin(*fixed.TS_AUDIO_CODECS), F.concat(codec_name(a["codec"]), F.lit(" audio cannot be carried in MPEG-TS segments")))
    )
    made = asked.withColumns({"error_code": error, "vr": video_reason, "ar": audio_reason})
    copy_v, copy_a = has_v & F.col("vr").isNull(), has_a & F.col("ar").isNull()
    remux = F.col("vr").isNull() & F.col("ar").isNull()
    kept = (
        F.when(copy_v & has_v, F.lit("video is copied without re-encoding"))
        .when(copy_a & has_v & ~copy_v, F.lit("audio is copied without re-encoding"))
    )
    reason = F.when(
        remux, F.concat(container_name(F.col("container")), F.lit(" container is not playable directly; streams are copied without re-encoding"))
    ).otherwise(F.concat_ws("; ", "vr", "ar", kept))
    out_h = F.when(has_v & smaller, size["height"]).otherwise(F.lit(0))
    ok = F.col("error_code").isNull()
    seg = F.when(copy_v, F.lit(fixed.REMUX_SEGMENT_SECONDS)).otherwise(F.lit(fixed.SEGMENT_SECONDS))
    planned = made.select(
        "request_id", "path", F.when(remux, F.lit("remux")).otherwise(F.lit("transcode")).alias("mode"), reason.alias("reason"),
        copy_v.alias("copy_video"), copy_a.alias("copy_audio"), v["index"].alias("video_index"), a["index"].alias("audio_index"),
        out_h.alias("out_height"), F.when(has_v & smaller, size["width"]).otherwise(F.lit(0)).alias("out_width"),
        F.when(has_v & ~copy_v, max_rate(F.when(out_h > 0, out_h).otherwise(v["height"]))).otherwise(F.lit(0)).cast("long").alias("max_rate"),
        "duration_sec", "start_sec", seg.alias("seg_sec"), "error_code", ok.alias("_ok"),
    ).withColumn("segment_count", segment_count("duration_sec", "seg_sec"))
    if max_segments is not None:
        planned = planned.withColumn(
            "error_code", F.coalesce("error_code", F.when(F.col("segment_count") > max_segments, F.lit(TOO_LARGE))))
    keep = ("request_id", "path", "error_code")
    return planned.select(*[c if c in keep else F.when(F.col("error_code").isNull(), F.col(c)).alias(c) for c in planned.columns if c != "_ok"])


def segment_count(duration: Column | str, seg: Column | str) -> Column:
    """Segments of a duration; a tail under half a second joins the one before. 0 when unknown."""
    d, s = (F.col(c) if isinstance(c, str) else c for c in (duration, seg))
    n = F.ceil((d - fixed.MIN_TAIL_SECONDS) / F.nullif(s, F.lit(0.0)) - 1e-9)
    return F.when((d > 0) & (s > 0), F.greatest(n, F.lit(1))).otherwise(F.lit(0)).cast("long")


def numbered(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row once per number 0..count-1. Numbers are made in stretches of 4 096, so no array grows with the count."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(cast({count} as long) - 1) div 4096"))).alias("_block")
    blocks = rows.where(F.col(count) > 0).select("*", block)
    last = F.least(F.col(count).cast("long"), (F.col("_block") + 1) * 4096) - 1
    return blocks.select("*", F.explode(F.sequence(F.col("_block") * 4096, last)).alias(name)).drop("_block")


def segment_schedule(plans: DataFrame, max_segments: int | None = None) -> DataFrame:
    """``(path, duration_sec, seg_sec)`` to one row per segment; with ``max_segments`` a file beyond it is refused as
    one row with ``error_code``."""
    counted = plans.withColumn("_count", segment_count("duration_sec", "seg_sec"))
    over = F.lit(False) if max_segments is None else F.col("_count") > max_segments
    fine = counted.where((F.col("_count") > 0) & ~over)
    rows = numbered(fine.select("path", "duration_sec", "seg_sec", "_count"), "_count", "n")
    start = F.col("n") * F.col("seg_sec")
    out = rows.select(
        "path", "n", start.alias("start"),
        F.when(F.col("n") == F.col("_count") - 1, F.col("duration_sec") - start).otherwise(F.col("seg_sec")).alias("duration"),
        F.lit(None).cast("string").alias("error_code"))
    if max_segments is None:
        return out
    refused = counted.where(over).select("path", F.lit(TOO_LARGE).alias("error_code"))
    return out.unionByName(refused, allowMissingColumns=True)


def boundary_keyframes(plans: DataFrame, keyframes: DataFrame) -> DataFrame:
    """For each segment boundary the last keyframe at or before it: ``path, m, pts, dts`` (NULL without one).

    ``plans(path, seg_sec, segment_count)``. Every keyframe belongs to the first boundary not before it, so a
    grouped maximum per (path, boundary) does the heavy work on the map side; filling the empty boundaries then
    touches at most one row per segment.
    """
    k = keyframes.join(plans.select("path", "seg_sec", "segment_count"), "path")
    guess = F.ceil(F.col("pts") / F.col("seg_sec"))
    first = F.when((guess - 1) * F.col("seg_sec") >= F.col("pts"), guess - 1).when(guess * F.col("seg_sec") < F.col("pts"), guess + 1).otherwise(guess)
    hits = (
        k.withColumn("m", F.greatest(first, F.lit(0)).cast("long")).where(F.col("m") < F.col("segment_count"))
        .groupBy("path", "m").agg(F.max(F.struct("pts", "dts")).alias("k"))
    )
    grid = numbered(plans.select("path", "segment_count"), "segment_count", "m").select("path", "m")
    w = W.partitionBy("path").orderBy("m")
    return grid.join(hits, ["path", "m"], "left").select(
        "path", "m", F.last("k", ignorenulls=True).over(w).alias("k")
    ).select("path", "m", F.col("k.pts").alias("pts"), F.col("k.dts").alias("dts"))


def fresh_boundaries(marks: DataFrame) -> DataFrame:
    """Adds ``fresh``: the boundary starts on a keyframe later than the one before; boundary 0 always does."""
    w = W.partitionBy("path").orderBy("m")
    later = F.col("pts").isNotNull() & (F.col("pts") > F.lag("pts").over(w))
    return marks.withColumn("fresh", (F.col("m") == 0) | F.coalesce(later, F.lit(False)))


def sparse_keyframes(plans: DataFrame, keyframes: DataFrame, samples: int | None = fixed.SPARSE_SAMPLES) -> DataFrame:
    """``(path, sparse)``: among the first ``samples`` inner boundaries (None: all) one has no keyframe or that of the one before."""
    few = plans if samples is None else plans.withColumn("segment_count", F.least("segment_count", F.lit(samples + 1)))
    marks = fresh_boundaries(boundary_keyframes(few, keyframes))
    bad = F.col("pts").isNull() | ~F.col("fresh")
    return marks.groupBy("path").agg(F.bool_or(bad).alias("sparse"))


def segment_cuts(plans: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Where each segment starts and stops and whether its video is copied.

    ``plans(path, seg_sec, segment_count, start_sec, copy_video)``. ``end_raw`` is in the source's own timeline,
    NULL for the last segment. A copied segment ends in decode order just where the next keyframe is cut.
    """
    own = ("path", "seg_sec", "segment_count", "start_sec", "copy_video")
    p = plans.select(*own)
    copied = fresh_boundaries(boundary_keyframes(p.where("copy_video"), keyframes))
    grid = numbered(p, "segment_count", "m")
    w = W.partitionBy("path").orderBy("m")
    ahead = grid.join(copied, ["path", "m"], "left").withColumns({
        "next_fresh": F.lead("fresh").over(w), "next_pts": F.lead("pts").over(w), "next_dts": F.lead("dts").over(w)})
    nominal = (F.col("m") + 1) * F.col("seg_sec") + F.col("start_sec")
    copy = F.col("copy_video") & F.coalesce("fresh", F.lit(False))
    fresh_next = F.coalesce("next_fresh", F.lit(False))
    end = (
        F.when(F.col("m") == F.col("segment_count") - 1, F.lit(None).cast("double"))
        .when(~F.col("copy_video"), nominal).when(fresh_next & copy, F.col("next_dts")).when(fresh_next, F.col("next_pts"))
        .when(copy, nominal - (F.coalesce("next_pts", F.lit(0.0)) - F.coalesce("next_dts", F.lit(0.0)))).otherwise(nominal)
    )
    return ahead.select("path", F.col("m").alias("n"), (F.col("m") * F.col("seg_sec")).alias("start"), end.alias("end_raw"), copy.alias("copy_video"))
