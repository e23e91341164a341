"""Small case tables for column functions."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from filelake.functions import decode, fixed, markup, paths, text, values
from filelake.operators import metadata


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_parent_and_crumbs(spark):
    cases = {"/a/b.zip!/x/y": "/a/b.zip!/x", "/a/b.zip!/x": "/a/b.zip", "/a/b.zip!/": "/a", "/a/b/": "/a", "/a": "/", "/": None, "a": None}
    got = one(spark, [(p,) for p in cases], "p string", paths.parent_path("p"))
    assert got == list(cases.values())
    crumbs = one(spark, [("/m/s.tar.gz!/w/c.zip!/a",)], "p string", paths.crumbs("p"))[0]
    assert [(c["label"], c["path"], c["archive"]) for c in crumbs] == [
        ("/", "/", False), ("m", "/m", False), ("s.tar.gz", "/m/s.tar.gz", True), ("w", "/m/s.tar.gz!/w", False),
        ("c.zip", "/m/s.tar.gz!/w/c.zip", True), ("a", "/m/s.tar.gz!/w/c.zip!/a", False)]


def test_entry_names(spark):
    cases = {"a//b/./c": "a/b/c", "a/b/../c/": "a/c", "../x": None, "/etc": None, "a/../..": None, ".": None, "": None, "..a": "..a", "a\x00": None}
    assert one(spark, [(p,) for p in cases], "p string", paths.clean_entry_name("p")) == list(cases.values())


def test_names_and_scopes(spark):
    assert one(spark, [(".bashrc",), ("a.TAR.gz",), ("none",)], "n string", paths.file_ext("n")) == ["bashrc", "gz", ""]
    assert one(spark, [("a.tar.gz",), (".zip",), ("x.TGZ",), ("y.deb",), ("t.txt",)], "n string", paths.archive_format("n")) == [
        "tar.gz", None, "tar.gz", "other", None]
    rows = [("/mnt/user",), ("/mnt/user/a",), ("/mnt/user2",)]
    assert one(spark, rows, "p string", paths.within("p", "/mnt/user/")) == [True, True, False]
    assert one(spark, rows, "p string", paths.within_any("p", [])) == [False] * 3
    assert one(spark, rows, "p string", paths.within("p", "/")) == [True] * 3


@pytest.mark.parametrize("value,kind,want", [
    ("800.0", "number", 800.0), ("1e3", "number", 1000.0), ("x", "number", None), ("NaN", "number", None), ("2024-01-02", "date", 1704153600.0),
    ("2024-01-02T03:04:05", "date", 1704164645.0), ("2024-01-02T03:04:05+01:00", "date", 1704161045.0), ("2024-13-02", "date", None), ("", "date", None)])
def test_numeric_values(spark, value, kind, want):
    assert one(spark, [(value, kind)], "v string, k string", values.parse_numeric_value("v", "k")) == [want]


def test_filters_and_numbers(spark):
    got = one(spark, [("image.iso>=800",), ("audio.title=a=b",), (" size > 1 ",), ("Bad.key=1",), ("name~",), ("x",)], "t string", values.parse_filter("t"))
    assert [tuple(g) if g else None for g in got] == [("image.iso", ">=", "800"), ("audio.title", "=", "a=b"), ("size", ">", "1"), None, None, None]
    assert one(spark, [(800.0,), (2.8,), (0.03125,), (-3.10,), (None,)], "v double", values.format_number("v")) == ["800", "2.8", "0.0312", "-3.1", None]
    assert one(spark, [("2019-05-01",), ("20195",), ("999",), ("",)], "t string", values.year_of("t")) == [2019, 0, 0, 0]


def test_clean_value_cuts_whole_characters(spark):
    long = "é" * 300 + "x"
    got = one(spark, [(" a\tb\x01c\n",), (long,), ("€" * 200,), ("𝄞" * 200,)], "v string", values.clean_value("v", 512))
    assert one(spark, [(long,)], "v string", values.clean_value("v")) == [long]
    assert got[0] == "a bc" and got[1] == "é" * 256 and got[2] == "€" * 170 and got[3] == "𝄞" * 128


def test_query_splitting(spark):
    cases = {'foo "bar baz" qux': [("term", "foo"), ("phrase", "bar baz"), ("term", "qux")], 'a"b c': [("term", "a"), ("phrase", "b c")],
             "AND or NOT ** x": [("term", "or"), ("term", "x")], '"" - "*"': [], 'no"AND"': [("term", "no"), ("phrase", "AND")]}
    got = one(spark, [(q,) for q in cases], "q string", text.split_query("q"))
    assert [[(p["kind"], p["text"]) for p in g] for g in got] == list(cases.values())


def test_fold_follows_unicode(spark):
    words = ["Élan", "naïve", "ÅNGSTRÖM", "straße", "ét́e", "łódź", "plain"]
    want = ["".join(c for c in unicodedata.normalize("NFD", w.lower()) if not 0x300 <= ord(c) <= 0x36F) for w in words]
    assert one(spark, [(w,) for w in words], "w string", text.fold("w")) == want


def test_text_extraction(spark):
    rows = [(b"ok\xff\x02 text",), (b"bin\x00ary",), (b"a" * 9000 + b"\x00b",)]
    got = one(spark, [(bytearray(r[0]),) for r in rows], "b binary", text.extract_text("b"))
    assert got == ["ok� text", None, "a" * 9000 + "b"]


def test_detection(spark):
    cases = [(b"\xef\xbb\xbfx", "utf-8"), (b"\xff\xfe\x00\x00x", "utf-32le"), (b"\xff\xfex\x00", "utf-16le"), ("né".encode()[:-1], "utf-8"),
             (b"caf\xe9 ok", "windows-1252"), ("€".encode()[:2], "utf-8"), (b"", "utf-8")]
    got = one(spark, [(bytearray(b),) for b, _ in cases], "b binary", text.detect_encoding("b"))
    assert got == [w for _, w in cases] == [decode.sniff(b) for b, _ in cases]


@pytest.mark.parametrize("encoding", sorted(fixed.ENCODINGS))
def test_windows_join_to_the_text(spark, encoding):
    sample = "Hello world, 123. " * 7
    for extra in ("Žluťoučký kůň", "Съешь ещё", "日本語テキスト", "한국어", "简体中文", "Ελληνικά", "Grüße çà", "مرحبا"):
        try:
            (sample + extra).encode(fixed.ENCODINGS[encoding])
        except UnicodeEncodeError:
            continue
        sample += extra * 5
    raw = sample.encode(fixed.ENCODINGS[encoding])
    whole = decode.decode_bytes(raw, encoding)
    assert whole == (sample, len(raw), False)
    if encoding == "iso-2022-jp":
        return
    df = spark.createDataFrame([("p", bytearray(raw))], "path string, bytes binary")
    rows = decode.text_windows(df, 13, encoding).orderBy("n").collect()
    assert "".join(r["text"] for r in rows) == sample
    assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
    assert sum(r["length"] for r in rows) == len(raw) and all(r["length"] > 0 for r in rows)


def test_markup(spark):
    cases = {"a &amp;&amp; <b>b</b>": "a &amp;&amp; b", "<mark>x</mark > y": "<mark>x</mark> y", "</mark>x<mark>y": "x<mark>y</mark>",
             "<mark/>z": "z", "&#60;mark&#x3e;": "&lt;mark&gt;", "1 < 2": "1 &lt; 2", "&copy; &nope;": "&amp;copy; &amp;nope;", "&quot;": "&quot;"}
    assert one(spark, [(k,) for k in cases], "h string", markup.strip_markup("h")) == list(cases.values())


def test_control_text(spark):
    control = "Package: tool\nVersion: 1.0\nInstalled-Size: 12\nDepends: libc6 (>= 2.3), a | b:any [amd64]\nDescription: first\n more\n\nPackage: other\n"
    rows = metadata.deb_fields(spark.createDataFrame([("/t.deb", control)], "path string, control string")).collect()
    got = {(r["key"], r["value"]) for r in rows}
    assert {("package.name", "tool"), ("package.installedSize", "12288"), ("package.summary", "first"), ("package.depends", "a"), ("package.depends", "b")} <= got
    assert ("package.name", "other") not in got


def test_field_limit(spark):
    rows = spark.range(1000).select(F.concat(F.lit("/f"), (F.col("id") >= 0).cast("string")).alias("path"), F.col("id").alias("ord"), F.lit("a.b").alias("key"), F.lit(None).cast("string").alias("value"),
                                    F.col("id").cast("double").alias("num"))
    assert metadata.normalize_fields(rows).count() == 1000
    kept = metadata.normalize_fields(rows, max_fields=256)
    assert sorted(int(r["value"]) for r in kept.collect()) == list(range(256))
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_mark_in_attribute(spark):
    cases = {'<a title="<mark>">hi</mark>': "&quot;&gt;hi", "<MARK >a</mark><mark/>b": "<mark>a</mark>b", "x<mark>y": "x<mark>y</mark>", "a<b": "a&lt;b", None: None}
    assert one(spark, [(c,) for c in cases], "h string", markup.strip_markup("h")) == list(cases.values())


def test_repeated_fields_keep_the_first(spark):
    rows = spark.createDataFrame([("/f", [("a.b", "1", 1.0), ("a.b", "1", 1.00001), ("a.c", "1", None), ("a.b", "2", None)])], "path string, f array<struct<key string, value string, num double>>")
    got = [(r.key, r.value, r.num) for r in metadata.to_rows(rows, F.col("f")).collect()]
    assert sorted(got, key=str) == sorted([("a.b", "1", 1.0), ("a.c", "1", None), ("a.b", "2", None)], key=str)
