"""Metadata rows and playback plans, from probes, image facts and packages derived from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, markup, probe
from ..operators import media, metadata, ordered, patterns
from . import views
from .registry import query
from .sql import with_views

CONTAINERS = (("matroska,webm", "mkv"), ("mov,mp4,m4a,3gp,3g2,mj2", "mp4"), ("avi", "avi"), ("mpegts", "ts"))
VIDEO_CODECS, AUDIO_CODECS = ("h264", "hevc", "vp9", "mpeg2video"), ("aac", "ac3", "flac", "truehd")
LANGS = ("eng", "ger", "und", "FRE")


def _nth(values, col):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values) + 1).cast("int"))


def probe_json(spark, sf_dir):
    """One probe text per order, one stream per line item: the first is video unless the order is audio only,
    returned items are subtitles."""
    def nth(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))

    def stream(x, i):
        no, quantity = i + 1, x["l_quantity"]
        is_video, is_sub = (no == 1) & (F.col("l_orderkey") % 6 != 0), x["l_returnflag"] == "R"
        codec = F.when(is_video, nth(VIDEO_CODECS, x["l_suppkey"])).when(is_sub, F.lit("subrip")).otherwise(nth(AUDIO_CODECS, x["l_suppkey"]))
        return F.struct(
            i.alias("index"), F.when(is_video, "video").when(is_sub, "subtitle").otherwise("audio").alias("codec_type"), codec.alias("codec_name"),
            (quantity * 40).cast("int").alias("width"), (quantity * 24).cast("int").alias("height"),
            F.when(x["l_linestatus"] == "O", "yuv420p10le").otherwise("yuv420p").alias("pix_fmt"),
            nth(("smpte2084", "bt709", "arib-std-b67"), x["l_suppkey"]).alias("color_transfer"),
            F.when(x["l_tax"] == 0, F.lit("0/0")).otherwise(F.concat((quantity * 1000).cast("int").cast("string"), F.lit("/1001"))).alias("avg_frame_rate"),
            F.lit("25/1").alias("r_frame_rate"), no.alias("channels"), (no * 8000).cast("string").alias("sample_rate"),
            F.create_map(F.lit("LANGUAGE"), nth(LANGS, x["l_partkey"]), F.lit("Duration"), F.lit("01:02:03.5")).alias("tags"),
            F.struct((no == 3).cast("int").alias("default"), F.lit(0).alias("attached_pic")).alias("disposition"))

    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_tax")
    grouped = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.sum("l_quantity").alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    grouped = grouped.withColumn("streams", F.transform("items", stream))
    key = F.col("l_orderkey")
    names = F.element_at(F.array(*[F.lit(c) for c, _ in CONTAINERS]), (key % 4 + 1).cast("int"))
    fmt = F.struct(
        names.alias("format_name"), F.when(key % 5 != 0, (F.col("q") * 60).cast("long").cast("string")).alias("duration"),
        F.col("cents").cast("string").alias("bit_rate"),
        F.create_map(F.lit("ARTIST"), F.concat(F.lit("f"), key.cast("string")), F.lit("date"), F.lit("2019-05-01"),
                     F.lit("track"), F.concat((key % 12).cast("string"), F.lit("/12"))).alias("tags"))
    ext = F.element_at(F.array(*[F.lit(e) for _, e in CONTAINERS]), (key % 4 + 1).cast("int"))
    return grouped.select(key, F.concat(F.lit("/lake/media/o"), key.cast("string"), F.lit("."), ext).alias("path"),
                          F.to_json(F.struct(fmt.alias("format"), "streams")).alias("json"))


STREAMS = """
WITH li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus, l_tax) AS INT) AS no,
  l_orderkey AS k FROM lineitem)
, kinds AS (SELECT *, CASE WHEN no = 1 AND k % 6 <> 0 THEN 'video' WHEN l_returnflag = 'R' THEN 'subtitle' ELSE 'audio' END AS kind FROM li)
, st AS (SELECT k, no, kind, '/lake/media/o' || CAST(k AS VARCHAR) || '.' || ['mkv','mp4','avi','ts'][k % 4 + 1] AS path,
  CASE kind WHEN 'video' THEN ['h264','hevc','vp9','mpeg2video'][l_suppkey % 4 + 1] WHEN 'subtitle' THEN 'subrip'
       ELSE ['aac','ac3','flac','truehd'][l_suppkey % 4 + 1] END AS codec,
  CAST(l_quantity * 40 AS INT) AS width, CAST(l_quantity * 24 AS INT) AS height, l_linestatus = 'O' AS deep,
  ['hdr10','none','hlg'][l_suppkey % 3 + 1] AS hdr,
  CASE WHEN l_tax = 0 THEN 25.0 ELSE floor(CAST(CAST(l_quantity * 1000 AS INT) AS DOUBLE) / 1001 * 1000 + 0.5) / 1000 END AS fps,
  ['eng','ger',NULL,'fre'][l_partkey % 4 + 1] AS lang, l_quantity, l_extendedprice FROM kinds)
, pr AS (SELECT k, path, CASE WHEN k % 5 <> 0 THEN CAST(sum(l_quantity) * 60 AS DOUBLE) ELSE 3723.5 END AS duration,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bit_rate, bool_or(kind = 'video') AS has_video, bool_or(kind = 'audio') AS has_audio FROM st GROUP BY k, path)
"""

# Files with at least one field of their own; a file of languageless subtitles has none.
DESCRIBED = "(SELECT * FROM pr WHERE k IN (SELECT k FROM st WHERE kind <> 'subtitle' OR lang IS NOT NULL)) described"


def _shown(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.4f', CAST({v} AS DOUBLE)), '0'), '.') END"


def _num(key: str, v: str, source: str) -> str:
    return f"SELECT path, '{key}' AS key, {_shown(v)} AS value, CAST({v} AS DOUBLE) AS num FROM {source}"


def _txt(key: str, v: str, source: str) -> str:
    return f"SELECT path, '{key}' AS key, CAST({v} AS VARCHAR) AS value, CAST(NULL AS DOUBLE) AS num FROM {source}"


VIDEO_ROWS = " UNION ".join([
    _txt("video.codec", "codec", "st WHERE kind = 'video'"), _num("video.width", "width", "st WHERE kind = 'video'"),
    _num("video.height", "height", "st WHERE kind = 'video'"), _txt("video.hdr", "hdr", "st WHERE kind = 'video'"),
    _num("video.bitDepth", "CASE WHEN deep THEN 10 ELSE 8 END", "st WHERE kind = 'video'"), _num("video.fps", "fps", "st WHERE kind = 'video'"),
    _txt("video.audioCodec", "codec", "st WHERE kind = 'audio'"), _num("video.audioChannels", "no", "st WHERE kind = 'audio'"),
    _txt("video.audioLang", "lang", "st WHERE kind = 'audio' AND lang IS NOT NULL"),
    _txt("video.subtitleLang", "lang", "st WHERE kind = 'subtitle' AND lang IS NOT NULL"),
    _num("video.durationSec", "duration", DESCRIBED), _num("video.bitrate", "bit_rate", DESCRIBED),
    _txt("video.container", "['matroska','mp4','avi','mpegts'][k % 4 + 1]", DESCRIBED),
])


def probes(spark, sf_dir):
    return metadata.parse_probes(probe_json(spark, sf_dir))


@query(STREAMS + VIDEO_ROWS)
def video_fields(spark, sf_dir):
    return metadata.video_fields(probes(spark, sf_dir))


_AUDIO_FIRST = "(SELECT DISTINCT ON (k) * FROM st WHERE kind = 'audio' ORDER BY k, no)"


@query(STREAMS + f""", tags AS (SELECT o_orderkey AS k, 'c' || CAST(o_custkey AS VARCHAR) AS artist, o_orderpriority AS genre, CAST(year(o_orderdate) AS INT) AS yr,
        CAST(o_orderkey % 20 AS INT) AS track FROM orders WHERE o_orderstatus = 'F')
    , paths AS (SELECT k, path FROM pr)
    , first AS {_AUDIO_FIRST}
    , loose AS (SELECT k, path FROM pr WHERE k NOT IN (SELECT k FROM tags))
    """ + " UNION ALL ".join([
        _txt("audio.artist", "artist", "tags JOIN paths USING (k)"), _txt("audio.genre", "genre", "tags JOIN paths USING (k)"),
        _num("audio.year", "yr", "tags JOIN paths USING (k)"), _num("audio.track", "track", "tags JOIN paths USING (k) WHERE track > 0"),
        _txt("audio.codec", "codec", "first"), _num("audio.sampleRate", "no * 8000", "first"), _num("audio.channels", "no", "first"),
        _num("audio.bitrate", "bit_rate", "pr"), _num("audio.durationSec", "duration", "pr"),
        _txt("audio.artist", "'f' || k", "loose"), _num("audio.year", "2019", "loose"), _num("audio.track", "k % 12", "loose WHERE k % 12 > 0")]))
def audio_fields(spark, sf_dir):
    p = probe_json(spark, sf_dir)
    orders = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("artist"),
        F.lit("").alias("album_artist"), F.lit("").alias("album"), F.lit(None).cast("string").alias("title"),
        F.col("o_orderpriority").alias("genre"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 20).cast("int").alias("track"))
    tags = orders.join(p.select("l_orderkey", "path"), "l_orderkey").drop("l_orderkey")
    return metadata.audio_fields(metadata.parse_probes(p), tags)


_EXIF_SQL = """WITH e AS (SELECT '/lake/img/p' || CAST(p_partkey AS VARCHAR) || '.jpg' AS path, p_brand AS make, p_name AS model, p_size * 100 AS iso,
    p_retailprice / 500 AS f_number, 1.0 / p_size AS exposure, p_retailprice * 100 AS focal, TIMESTAMP '1895-01-01' + to_days(CAST(p_partkey * 20 AS INT)) AS taken,
    p_size * 100 AS width, p_size * 80 AS height, CAST(p_partkey % 10 AS INT) AS orientation, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey % 200) - 100 + 0.1234567 END AS lat,
    CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey % 370) - 185 + 0.7654321 END AS lon FROM part)
, x AS (SELECT *, floor(f_number * 100 + 0.5) / 100 AS fr, floor(exposure * 1000000 + 0.5) / 1000000 AS er, floor(focal * 100 + 0.5) / 100 AS fl,
    (lat <> 0 OR lon <> 0) AND abs(lat) <= 90 AND abs(lon) <= 180 AS located, sign(lat) * floor(abs(lat) * 1000000 + 0.5) / 1000000 AS latr,
    sign(lon) * floor(abs(lon) * 1000000 + 0.5) / 1000000 AS lonr FROM e)
"""


@query(_EXIF_SQL + " UNION ALL ".join([
    _txt("image.cameraMake", "make", "x"), _txt("image.cameraModel", "model", "x"), _num("image.iso", "iso", "x"), _num("image.fNumber", "fr", "x"),
    _num("image.exposureTime", "er", "x"), _num("image.focalLength", "fl", "x WHERE focal < 100000"), _num("image.width", "width", "x"), _num("image.height", "height", "x"),
    "SELECT path, 'image.dateTaken', strftime(taken, '%Y-%m-%dT%H:%M:%SZ'), CAST(epoch(taken) AS DOUBLE) FROM x WHERE year(taken) > 1900 AND year(taken) < 2200",
    _txt("image.orientation", "['normal','mirror-horizontal','rotate-180','mirror-vertical','mirror-horizontal-rotate-270','rotate-90','mirror-horizontal-rotate-90','rotate-270'][orientation]",
         "x WHERE orientation BETWEEN 1 AND 8"),
    _txt("image.gps", "CASE WHEN located THEN 'yes' ELSE 'no' END", "x"), _num("image.gpsLat", "latr", "x WHERE located"), _num("image.gpsLon", "lonr", "x WHERE located")]))
def image_fields(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None)
    e = views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("/lake/img/p"), k.cast("string"), F.lit(".jpg")).alias("path"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"),
        none.cast("string").alias("lens"), F.lit(" ").alias("software"), (F.col("p_size") * 100).alias("iso"), (F.col("p_retailprice") / 500).alias("f_number"),
        (F.lit(1.0) / F.col("p_size")).alias("exposure_time"), (F.col("p_retailprice") * 100).alias("focal_length"),
        F.timestamp_seconds(F.lit(-2366755200) + k * 20 * 86400).alias("date_taken"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 80).alias("height"),
        F.lit(0).alias("ifd_width"), F.lit(0).alias("ifd_height"), (k % 10).cast("int").alias("orientation"),
        F.when(k % 3 == 0, 0.0).otherwise((k % 200) - 100 + 0.1234567).alias("lat"), F.when(k % 3 == 0, 0.0).otherwise((k % 370) - 185 + 0.7654321).alias("lon"))
    return metadata.image_fields(e)


def control_texts(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("\nPackage: pkg"), k, F.lit("\nVersion: 1."), F.col("p_size").cast("string"), F.lit("\nARCHITECTURE: amd64\nInstalled-Size: "),
        (F.col("p_size") * 3).cast("string"), F.lit("\nMaintainer:  "), F.col("p_brand"), F.lit("\nDepends: libc6 (>= 2.34), lib"), F.col("p_size").cast("string"),
        F.lit(" | alt:any [amd64],\n , libc6\nPre-Depends: dpkg\nDescription: "), F.col("p_name"), F.lit("\n long text\n .\n more\n \nPackage: other\nSection: x\n"))
    return views.table(spark, sf_dir, "part").select(F.concat(F.lit("/lake/pkg/p"), k, F.lit(".deb")).alias("path"), text.alias("control"))


@query("""WITH p AS (SELECT '/lake/pkg/p' || CAST(p_partkey AS VARCHAR) || '.deb' AS path, * FROM part)
""" + " UNION ALL ".join([
    _txt("package.format", "'deb'", "p"), _txt("package.name", "'pkg' || CAST(p_partkey AS VARCHAR)", "p"), _txt("package.version", "'1.' || CAST(p_size AS VARCHAR)", "p"),
    _txt("package.arch", "'amd64'", "p"), _txt("package.maintainer", "p_brand", "p"), _txt("package.summary", "p_name", "p"), _num("package.installedSize", "p_size * 3 * 1024", "p"),
    "SELECT path, 'package.depends', unnest(['libc6', 'lib' || CAST(p_size AS VARCHAR), 'alt', 'dpkg']), NULL FROM p"]))
def deb_fields(spark, sf_dir):
    return metadata.deb_fields(control_texts(spark, sf_dir))


@query("""SELECT p_partkey, unnest(['libc6', p_brand, 'alt', 'foo', p_name]) AS dep FROM part""")
def split_depends(spark, sf_dir):
    t = F.concat(F.lit("libc6 (>= 2.34),"), "p_brand", F.lit(" | alt:any [amd64],, foo <!nocheck>,"), "p_name")
    return views.table(spark, sf_dir, "part").select("p_partkey", F.explode(metadata.split_depends(t)).alias("dep"))


@query("""WITH s AS (SELECT '/lake/pkg/s' || CAST(s_suppkey AS VARCHAR) || '.rpm' AS path, * FROM supplier)
""" + " UNION ALL ".join([
    _txt("package.format", "'rpm'", "s"), _txt("package.name", "s_name", "s"), _txt("package.version", "CAST(s_nationkey AS VARCHAR)", "s"), _txt("package.license", "'MIT'", "s"),
    _num("package.installedSize", "s_suppkey * 1000", "s"), "SELECT path, 'package.depends', unnest(['glibc', 'lib' || CAST(s_nationkey AS VARCHAR)]), NULL FROM s"]))
def rpm_fields(spark, sf_dir):
    def tag(no, strings, number):
        return F.struct(F.lit(no).alias("tag"), strings.cast("array<string>").alias("strings"), number.cast("long").alias("number"))

    none = F.lit(None)
    tags = F.array(
        tag(1000, F.array("s_name"), none), tag(1001, F.array(F.col("s_nationkey").cast("string")), none), tag(1014, F.array(F.lit("MIT")), none),
        tag(1009, none, F.col("s_suppkey") * 1000), tag(9999, F.array(F.lit("unused")), none),
        tag(1049, F.array(F.lit("rpmlib(X)"), F.lit("glibc"), F.lit("/bin/sh"), F.concat(F.lit("lib"), F.col("s_nationkey").cast("string")), F.lit("glibc")), none))
    rows = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("/lake/pkg/s"), F.col("s_suppkey").cast("string"), F.lit(".rpm")).alias("path"), F.inline(tags))
    return metadata.rpm_fields(rows)


@query(with_views("file_meta") + "SELECT path, key, value, max(num) AS num FROM file_meta GROUP BY path, key, value")
def dedupe_fields(spark, sf_dir):
    m = views.file_meta(spark, sf_dir)
    return metadata.dedupe_fields(m.unionByName(m))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS value, generate_subscripts(regexp_split_to_array(text, '[ \\n]'), 1) AS ord FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS path, 'doc.word' AS key, trim(regexp_replace(value, '[\\x00-\\x1f\\x7f]', '', 'g')) AS value, CAST(NULL AS DOUBLE) AS num FROM w
    WHERE trim(regexp_replace(value, '[\\x00-\\x1f\\x7f]', '', 'g')) <> ''""")
def normalize_fields(spark, sf_dir):
    words = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "[ \n]")).alias("ord", "value"))
    return metadata.normalize_fields(words.select("path", "ord", F.lit("doc.word").alias("key"), "value", F.lit(float("nan")).alias("num")))


@query(STREAMS + """, v AS (SELECT path, count(*) AS n FROM (""" + VIDEO_ROWS + """) GROUP BY path)
    SELECT path, n FROM v WHERE path LIKE '%.mkv' OR path LIKE '%.mp4' OR path LIKE '%.avi' OR path LIKE '%.ts'""")
def extract_metadata(spark, sf_dir):
    """All video candidates through the extractor of their category; files with unreadable probes become errors."""
    p = probe_json(spark, sf_dir)
    candidates = p.select("path", F.substring_index("path", ".", -1).alias("ext"))

    def video(files):
        parsed = metadata.parse_probes(p.join(files.select("path"), "path", "left_semi"))
        bad = parsed.where("probe IS NULL").select("path", F.lit("unreadable probe").alias("error"))
        return metadata.video_fields(parsed).unionByName(bad, allowMissingColumns=True)

    rows, _ = metadata.extract_metadata(candidates, {"video": video})
    return rows.groupBy("path").agg(F.count("*").alias("n"))


# --- probe values -----------------------------------------------------------------------------------------

@query(STREAMS + """SELECT path, no, fps, CASE WHEN deep THEN 10 ELSE 8 END AS depth, hdr, coalesce(lang, 'und') AS lang FROM st""")
def stream_facts(spark, sf_dir):
    """Frame rate, bit depth, dynamic range and language tag of every stream."""
    s = probes(spark, sf_dir).select("path", F.explode("probe.streams").alias("s"))
    return s.select(
        "path", (F.col("s.index") + 1).alias("no"), probe.fps("s.avg_frame_rate", "s.r_frame_rate").alias("fps"),
        probe.bit_depth("s.bits_per_raw_sample", "s.pix_fmt").alias("depth"), probe.hdr_class("s.side_data_list", "s.color_transfer").alias("hdr"),
        F.lower(probe.tag_value("s.tags", "language")).alias("lang"))


@query(STREAMS + """SELECT path, duration, ['matroska','mp4','avi','mpegts'][k % 4 + 1] AS container FROM pr""")
def duration_and_container(spark, sf_dir):
    ext = F.substring_index("path", ".", -1)
    return probes(spark, sf_dir).select("path", probe.duration_of("probe").alias("duration"),
                                        probe.container_of("probe.format.format_name", ext).alias("container"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS clock, ts FROM events)
    SELECT event_id, epoch(ts) - 86400 * floor(epoch(ts) / 86400) AS seconds, 0.0 AS none FROM t""")
def clock_seconds(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    clock = F.date_format("ts", "HH:mm:ss.SSSSSS")
    return e.select("event_id", F.round(probe.clock_seconds(clock), 6).alias("seconds"), probe.clock_seconds(F.date_format("ts", "HH:mm")).alias("none"))


# --- planning ---------------------------------------------------------------------------------------------

def records(spark, sf_dir):
    return media.probe_records(probes(spark, sf_dir))


@query(STREAMS + """SELECT pr.path, pr.duration AS duration_sec, pr.bit_rate AS bitrate, v.codec AS video_codec, v.height,
      (SELECT count(*) FROM st s WHERE s.k = pr.k AND kind = 'audio') AS audio, (SELECT count(*) FROM st s WHERE s.k = pr.k AND kind = 'subtitle') AS subtitles,
      CASE WHEN v.codec IS NULL AND NOT has_audio THEN 'ENCODING_ERROR' END AS error_code
    FROM pr LEFT JOIN st v ON v.k = pr.k AND v.kind = 'video'""")
def probe_records(spark, sf_dir):
    return records(spark, sf_dir).select(
        "path", "duration_sec", "bitrate", F.col("video.codec").alias("video_codec"), F.col("video.height").alias("height"),
        F.size("audio").cast("long").alias("audio"), F.size("subtitles").cast("long").alias("subtitles"), "error_code")


def play_requests(spark, sf_dir):
    """One request per order: the customer's nation is the device; some ask for a track or a height."""
    o = views.table(spark, sf_dir, "orders")
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("device_id"))
    ext = _nth([e for _, e in CONTAINERS], "o_orderkey")
    key = F.col("o_orderkey")
    return o.join(c, "o_custkey").select(
        key.alias("request_id"), F.concat(F.lit("/lake/media/o"), key.cast("string"), F.lit("."), ext).alias("path"), "device_id",
        F.when(key % 7 == 0, F.lit(2)).otherwise(F.lit(-1)).alias("audio_index"), F.when(key % 3 == 0, F.lit(481)).otherwise(F.lit(0)).alias("max_height"))


def devices(spark, sf_dir):
    n = F.col("n_nationkey")
    can = F.when(n % 4 == 0, F.array(F.lit("AVC1"), F.lit("mp4a"))).when(n % 4 == 1, F.array(F.lit("h265"), F.lit(" h264 "), F.lit("aac"), F.lit("ac-3"))) \
        .when(n % 4 == 2, F.array(F.lit("vp9"), F.lit("flac"), F.lit("mpeg-2"))).otherwise(F.array().cast("array<string>"))
    return views.table(spark, sf_dir, "nation").select(n.alias("device_id"), can.alias("can"))


_PICKED = """, req AS (SELECT o_orderkey AS k, c_nationkey % 4 AS d, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE -1 END AS ai, CASE WHEN o_orderkey % 3 = 0 THEN 481 ELSE 0 END AS mh
      FROM orders JOIN customer ON o_custkey = c_custkey)
, chosen AS (SELECT r.k, r.d, r.ai, r.mh, v.codec AS vc, v.height, v.width, a.codec AS ac, a.no AS ano, pr.duration, pr.path, pr.has_audio FROM req r JOIN pr USING (k)
      LEFT JOIN st v ON v.k = r.k AND v.kind = 'video'
      LEFT JOIN st a ON a.k = r.k AND a.kind = 'audio' AND a.no = CASE WHEN r.ai >= 0 THEN r.ai + 1 ELSE coalesce(
        (SELECT min(no) FROM st x WHERE x.k = r.k AND x.kind = 'audio' AND x.no = 3), (SELECT min(no) FROM st x WHERE x.k = r.k AND x.kind = 'audio')) END)
, judged AS (SELECT *, CASE d WHEN 0 THEN vc = 'h264' WHEN 1 THEN vc IN ('hevc', 'h264') WHEN 2 THEN vc IN ('vp9', 'mpeg2video') ELSE false END AS pv,
      CASE d WHEN 0 THEN ac = 'aac' WHEN 1 THEN ac IN ('aac', 'ac3') WHEN 2 THEN ac = 'flac' ELSE false END AS pa, vc IS NOT NULL AS hv, ac IS NOT NULL AS ha FROM chosen)
, reasons AS (SELECT *, CASE WHEN NOT hv THEN NULL WHEN mh > 0 AND mh < height THEN 'downscaling ' || CAST(height AS VARCHAR) || 'p to 480p at the client''s request'
      WHEN NOT pv THEN CASE vc WHEN 'h264' THEN 'H.264' WHEN 'hevc' THEN 'HEVC' WHEN 'vp9' THEN 'VP9' ELSE 'MPEG-2' END || ' video is not supported by this browser'
      WHEN vc = 'vp9' THEN 'VP9 video cannot be carried in MPEG-TS segments' END AS vr,
    CASE WHEN NOT ha THEN NULL WHEN NOT pa THEN CASE ac WHEN 'aac' THEN 'AAC' WHEN 'ac3' THEN 'AC-3' WHEN 'flac' THEN 'FLAC' ELSE 'TrueHD' END || ' audio is not supported by this browser'
      WHEN ac IN ('flac', 'truehd') THEN 'FLAC audio cannot be carried in MPEG-TS segments' END AS ar,
    CASE WHEN NOT hv AND NOT has_audio THEN 'ENCODING_ERROR' WHEN ai >= 0 AND NOT ha THEN 'BAD_REQUEST' END AS error_code FROM judged)
, planned AS (SELECT *, hv AND vr IS NULL AS cv, ha AND ar IS NULL AS ca, CASE WHEN hv AND mh > 0 AND mh < height THEN 480 ELSE 0 END AS oh FROM reasons)
"""


@query(STREAMS + _PICKED + """SELECT k AS request_id, path, error_code, CASE WHEN error_code IS NULL THEN CASE WHEN vr IS NULL AND ar IS NULL THEN 'remux' ELSE 'transcode' END END AS mode,
    CASE WHEN error_code IS NULL THEN CASE WHEN vr IS NULL AND ar IS NULL
      THEN ['Matroska','MP4','AVI','MPEG-TS'][k % 4 + 1] || ' container is not playable directly; streams are copied without re-encoding'
      ELSE concat_ws('; ', vr, ar, CASE WHEN cv THEN 'video is copied without re-encoding' WHEN ca AND hv AND NOT cv THEN 'audio is copied without re-encoding' END) END END AS reason,
    CASE WHEN error_code IS NULL THEN cv END AS copy_video, CASE WHEN error_code IS NULL THEN ca END AS copy_audio,
    CASE WHEN error_code IS NULL THEN oh END AS out_height,
    CASE WHEN error_code IS NULL THEN CASE WHEN oh > 0 THEN CAST(floor(CAST(width AS DOUBLE) * 480 / height + 0.5) AS INT) + CAST(floor(CAST(width AS DOUBLE) * 480 / height + 0.5) AS INT) % 2 ELSE 0 END END AS out_width,
    CASE WHEN error_code IS NULL THEN CASE WHEN hv AND NOT cv THEN CASE WHEN CASE WHEN oh > 0 THEN oh ELSE height END <= 480 THEN 1500000 WHEN height <= 720 AND oh = 0 THEN 3000000
       WHEN height <= 1080 AND oh = 0 THEN 6000000 ELSE 12000000 END ELSE 0 END END AS max_rate,
    CASE WHEN error_code IS NULL THEN CAST(greatest(1, ceil((duration - 0.5) / CASE WHEN cv THEN 10 ELSE 4 END - 1e-9)) AS BIGINT) END AS segment_count FROM planned""")
def playback_plan(spark, sf_dir):
    plan = media.playback_plan(records(spark, sf_dir), devices(spark, sf_dir), play_requests(spark, sf_dir))
    return plan.select("request_id", "path", "error_code", "mode", "reason", "copy_video", "copy_audio", "out_height", "out_width", "max_rate", "segment_count")


@query(STREAMS + _PICKED + "SELECT k AS request_id, CASE WHEN ano IS NOT NULL THEN ano - 1 END AS audio_index FROM chosen")
def pick_audio(spark, sf_dir):
    asked = play_requests(spark, sf_dir).join(records(spark, sf_dir).select("path", "audio"), "path")
    return asked.select("request_id", media.pick_audio("audio", "audio_index")["index"].alias("audio_index"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 40 AS INT) AS w, CAST(l_quantity * 24 AS INT) AS h, CAST(l_suppkey % 900 + 101 AS INT) AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, m - m % 2 AS height, CAST(floor(CAST(w AS DOUBLE) * (m - m % 2) / h + 0.5) AS INT) + CAST(floor(CAST(w AS DOUBLE) * (m - m % 2) / h + 0.5) AS INT) % 2 AS width,
      CASE WHEN h <= 480 THEN 1500000 WHEN h <= 720 THEN 3000000 WHEN h <= 1080 THEN 6000000 ELSE 12000000 END AS max_rate FROM v""")
def scaled_size(spark, sf_dir):
    v = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 40).cast("int").alias("w"), (F.col("l_quantity") * 24).cast("int").alias("h"),
        (F.col("l_suppkey") % 900 + 101).cast("int").alias("m"))
    size = media.scaled_size("w", "h", "m")
    return v.select("l_orderkey", "l_linenumber", size["height"].alias("height"), size["width"].alias("width"), media.max_rate("h").alias("max_rate"))


@query(STREAMS + """, p AS (SELECT path, duration, CAST(greatest(1, ceil((duration - 0.5) / 90 - 1e-9)) AS BIGINT) AS c FROM pr)
    , g AS (SELECT path, duration, c, unnest(range(0, c)) AS n FROM p)
    SELECT path, n, n * 90.0 AS start, CASE WHEN n = c - 1 THEN duration - n * 90.0 ELSE 90.0 END AS duration FROM g""")
def segment_schedule(spark, sf_dir):
    plans = records(spark, sf_dir).select("path", "duration_sec", F.lit(90.0).alias("seg_sec"))
    return media.segment_schedule(plans).select("path", "n", "start", "duration")


SEG = 43200.0


def keyframes(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    pts = (views.epoch_micros("ts") - F.lit(1704067200000000)) / F.lit(1e6)
    return e.select(F.concat(F.lit("/lake/media/u"), F.col("user_id").cast("string"), F.lit(".mkv")).alias("path"), pts.alias("pts"), (pts - 0.08).alias("dts"))


def keyframe_plans(spark, sf_dir):
    return keyframes(spark, sf_dir).groupBy("path").agg(F.max("pts").alias("end")).select(
        "path", F.lit(SEG).alias("seg_sec"), media.segment_count("end", F.lit(SEG)).alias("segment_count"), F.lit(1.5).alias("start_sec"),
        (F.length("path") % 2 == 0).alias("copy_video"))


_KEYFRAMES = f"""WITH kf AS (SELECT '/lake/media/u' || CAST(user_id AS VARCHAR) || '.mkv' AS path, (epoch_us(ts) - 1704067200000000) / 1e6 AS pts,
      (epoch_us(ts) - 1704067200000000) / 1e6 - 0.08 AS dts FROM events)
, plans AS (SELECT path, CAST(greatest(1, ceil((max(pts) - 0.5) / {SEG} - 1e-9)) AS BIGINT) AS c, length(path) % 2 = 0 AS copy_video FROM kf GROUP BY path)
, grid AS (SELECT path, c, copy_video, unnest(range(0, c)) AS m FROM plans)
, marks AS (SELECT g.path, g.c, g.copy_video, g.m, k.pts, k.dts FROM grid g ASOF LEFT JOIN kf k ON g.path = k.path AND g.m * {SEG} >= k.pts)
, fresh AS (SELECT *, m = 0 OR coalesce(pts > lag(pts) OVER (PARTITION BY path ORDER BY m), false) AS fr FROM marks)
"""


@query(_KEYFRAMES + "SELECT path, m, pts, dts FROM marks")
def boundary_keyframes(spark, sf_dir):
    return media.boundary_keyframes(keyframe_plans(spark, sf_dir), keyframes(spark, sf_dir))


@query(_KEYFRAMES + "SELECT path, bool_or(pts IS NULL OR NOT fr) AS sparse FROM fresh WHERE m <= 5 GROUP BY path")
def sparse_keyframes(spark, sf_dir):
    return media.sparse_keyframes(keyframe_plans(spark, sf_dir), keyframes(spark, sf_dir))


@query(_KEYFRAMES + f""", ahead AS (SELECT *, lead(fr) OVER w AS nf, lead(pts) OVER w AS np, lead(dts) OVER w AS nd, copy_video AND fr AS cp, (m + 1) * {SEG} + 1.5 AS nominal
      FROM fresh WINDOW w AS (PARTITION BY path ORDER BY m))
    SELECT path, m AS n, m * {SEG} AS start, cp AS copy_video, CASE WHEN m = c - 1 THEN NULL WHEN NOT copy_video THEN nominal WHEN nf AND cp THEN nd WHEN nf THEN np
      WHEN cp THEN nominal - (coalesce(np, 0) - coalesce(nd, 0)) ELSE nominal END AS end_raw FROM ahead""")
def segment_cuts(spark, sf_dir):
    return media.segment_cuts(keyframe_plans(spark, sf_dir), keyframes(spark, sf_dir))


@query(_KEYFRAMES + f"""SELECT b.path, b.pts, k.pts AS point_pts, k.dts FROM (SELECT path, m * {SEG} + 7 AS pts FROM grid) b
       ASOF LEFT JOIN kf k ON b.path = k.path AND b.pts >= k.pts""")
def asof_last(spark, sf_dir):
    """The last keyframe at or before arbitrary times, without assuming a fixed grid."""
    p = keyframe_plans(spark, sf_dir).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segment_count") - 1)).alias("m"))
    times = p.select("path", (F.col("m") * SEG + 7).alias("pts"))
    return ordered.asof_last(keyframes(spark, sf_dir), times, ["path"], "pts", "dts")


# --- patterns and markup ----------------------------------------------------------------------------------

USER_PATTERNS = (*fixed.PRIVATE_PATTERNS, ("email", r"[a-z0-9._]+@[a-z0-9.-]+\.[a-z]+"), ("ipv4", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
                 ("phone", r"\+[0-9]+ \([0-9]+\) [0-9]{3}-[0-9]{4}"))


@query(r"""WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
""" + " UNION ALL ".join(
    f"SELECT id, CAST(line_no AS BIGINT) AS line_no, '{name}' AS pattern, unnest(regexp_extract_all(line, '(?i)({p})', 1)) AS match FROM lines" for name, p in USER_PATTERNS))
def scan_patterns(spark, sf_dir):
    return patterns.scan_patterns(views.table(spark, sf_dir, "documents"), "doc_id", "text", USER_PATTERNS).select("id", "line_no", "pattern", "match")


@query(r"""WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents), hits AS (
""" + " UNION ALL ".join(
    f"SELECT id, '{name}' AS pattern, unnest(regexp_extract_all(line, '(?i)({p})', 1)) AS match FROM lines" for name, p in USER_PATTERNS)
    + ") SELECT pattern, count(*) AS matches, count(DISTINCT id) AS texts FROM hits GROUP BY pattern")
def pattern_counts(spark, sf_dir):
    return patterns.pattern_counts(patterns.scan_patterns(views.table(spark, sf_dir, "documents"), "doc_id", "text", USER_PATTERNS))


@query("""WITH m AS (SELECT page_id, regexp_replace(replace(replace(html, '<b>', chr(2)), '</b>', chr(3)), '<[^>]*>', '', 'g') AS t FROM pages)
    , d AS (SELECT page_id, replace(replace(replace(t, '&amp;', chr(1)), '&quot;', '"'), '"', chr(4)) AS t FROM m)
    SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), chr(1), '&amp;'), chr(4), '&quot;'), '<', '&lt;'), '>', '&gt;'),
      chr(2), '<mark>'), chr(3), '</mark>') || repeat('</mark>', CAST(len(string_split(t, chr(2))) - len(string_split(t, chr(3))) AS INT)) AS text FROM d""")
def strip_markup(spark, sf_dir):
    """Pages with their bold tags read as marks."""
    html = F.replace(F.replace("html", F.lit("<b>"), F.lit("<MARK >")), F.lit("</b>"), F.lit("</mark>"))
    return views.table(spark, sf_dir, "pages").select("page_id", markup.strip_markup(html).alias("text"))
