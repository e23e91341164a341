"""Schemas of the tables the catalogue is made of."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()

SCAN = _struct(("path", S), ("dir", S), ("name", S), ("ext", S), ("size", L), ("mtime", L))

FILES = _struct(
    ("path", S), ("dir", S), ("name", S), ("ext", S), ("size", L), ("mtime", L), ("mimeclass", S),
    ("content_indexed", B), ("meta_extracted", B), ("gen", L),
)

CONTENT = _struct(("path", S), ("body", S))

FILE_META = _struct(("path", S), ("key", S), ("value", S), ("num", D))

META_FILTER = _struct(("key", S), ("op", S), ("value", S))

REQUESTS = _struct(
    ("request_id", S), ("q", S), ("mode", S), ("path", S), ("exts", T.ArrayType(S)),
    ("min_size", L), ("max_size", L), ("after", L), ("before", L), ("meta", T.ArrayType(META_FILTER)),
    ("sort", S), ("dir", S), ("limit", L), ("offset", L),
)

ARCHIVE_RECORDS = _struct(
    ("archive_path", S), ("ord", L), ("raw", S), ("size", L), ("mtime", L), ("is_dir", B), ("symlink", S),
)

MEMBERS = _struct(
    ("archive_path", S), ("entry_path", S), ("bytes", T.BinaryType()), ("error_code", S), ("message", S),
)

DECODED = _struct(
    ("path", S), ("text", S), ("encoding", S), ("sniffed", S), ("lossy", B), ("length", L),
)

WINDOWS = _struct(
    ("path", S), ("n", L), ("offset", L), ("length", L), ("text", S), ("lossy", B),
)

PROBE = _struct(
    ("format", _struct(
        ("format_name", S), ("duration", S), ("bit_rate", S), ("start_time", S), ("tags", T.MapType(S, S)),
    )),
    ("streams", T.ArrayType(_struct(
        ("index", I), ("codec_type", S), ("codec_name", S), ("profile", S), ("width", I), ("height", I),
        ("pix_fmt", S), ("bits_per_raw_sample", S), ("color_transfer", S), ("avg_frame_rate", S),
        ("r_frame_rate", S), ("channels", I), ("sample_rate", S), ("bit_rate", S), ("duration", S),
        ("tags", T.MapType(S, S)),
        ("disposition", _struct(("default", I), ("attached_pic", I))),
        ("side_data_list", T.ArrayType(_struct(("side_data_type", S)))),
    ))),
)
