"""Listing, archives, snapshots and planning rules on small fixtures."""

import os

from pyspark.sql import functions as F

from filelake.operators import archive_tables, catalog, media, metadata, ordered
from filelake.sources import archives, listing, snapshots
from filelake.streaming import changes


def test_scan_files(spark, tmp_path):
    for p in ("a/b/c/.hidden", "a/_under.TXT", "node_modules/x.js", "a/.git/config", ".Trash-1000/t", "keep/.gitignore", "d1/d2/d3/d4/d5/deep.md"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("hello")
    os.symlink(tmp_path / "a/_under.TXT", tmp_path / "link.txt")
    os.mkfifo(tmp_path / "pipe")
    rows = listing.scan_files(spark, [str(tmp_path), str(tmp_path / "nope")], dirs_per_task=2).collect()
    got = {r["path"][len(str(tmp_path)) + 1:]: r for r in rows}
    assert set(got) == {"a/b/c/.hidden", "a/_under.TXT", "keep/.gitignore", "d1/d2/d3/d4/d5/deep.md"}
    assert got["a/_under.TXT"]["ext"] == "txt" and got["a/_under.TXT"]["size"] == 5 and got["keep/.gitignore"]["ext"] == "gitignore"
    rooted = listing.scan_files(spark, [str(tmp_path / "node_modules")]).collect()
    assert [r["name"] for r in rooted] == ["x.js"]
    bodies = listing.read_bodies(spark.createDataFrame(rows), cap=3).collect()
    assert {bytes(b["bytes"]) for b in bodies} == {b"hel"} and len(bodies) == 4


def test_archives_hostile_and_broken(spark):
    files = [("a/b/c.txt", b"1"), ("a/b/c.txt", b"22"), ("x", b"f"), ("x/y", b"g"), ("../up", b"h"), ("d", None)]
    df = spark.createDataFrame([("/h.zip", bytearray(archives.pack(files, "zip"))), ("/bad.tar.gz", bytearray(b"nope")), ("/t.7z", bytearray(b"7z")),
                                ("/cut.tar.xz", bytearray(archives.pack(files, "tar.xz")[:-40]))], "path string, bytes binary")
    records = archives.read_archives(df)
    errors = {r["archive_path"] for r in records.where("error_code IS NOT NULL").collect()}
    assert errors == {"/bad.tar.gz", "/t.7z", "/cut.tar.xz"}
    nodes = {(r["entry_path"], r["is_dir"], r["size"]) for r in archive_tables.entry_table(records).collect()}
    assert nodes == {("a", True, 0), ("a/b", True, 0), ("a/b/c.txt", False, 1), ("x", True, 0), ("x/y", False, 1), ("d", True, 0)}
    assert archive_tables.entry_table(records, max_nodes=3).count() == 0
    assert [r["error_code"] for r in archive_tables.too_many_nodes(archive_tables.all_nodes(records), 3).collect()] == ["ARCHIVE_ERROR"]


def test_nesting_stops_at_the_limit(spark):
    inner = archives.pack([("deep/file.txt", b"hello")], "zip")
    for i in range(3):
        inner = archives.pack([(f"l{i}.zip", inner)], "tar.gz" if i == 2 else "zip")
    df = spark.createDataFrame([("/n.tar.gz", bytearray(inner))], "path string, bytes binary")
    out = {(r["archive_path"], r["raw"], r["depth"]) for r in archives.expand_nested(df, max_depth=3).collect()}
    assert out == {("/n.tar.gz", "l2.zip", 1), ("/n.tar.gz!/l2.zip", "l1.zip", 2), ("/n.tar.gz!/l2.zip!/l1.zip", "l0.zip", 3)}


def test_no_limits_unless_asked_for(spark):
    import inspect

    for of, names in ((archives.read_archives, ["max_entries"]), (archives.read_members, ["cap"]), (archives.expand_nested, ["max_entries", "layer_cap", "max_depth"])):
        assert all(inspect.signature(of).parameters[n].default is None for n in names)
    many = 250_003
    inner = archives.pack([("deep.txt", b"x")], "zip")
    for _ in range(4):
        inner = archives.pack([("in.zip", inner)], "zip")
    good = archives.pack([(f"d/{k}", b"") for k in range(many)], "tar.gz")
    rows = [("/many.tar.gz", bytearray(good)), ("/cut.tar.gz", bytearray(good[: len(good) // 2])), ("/n.zip", bytearray(inner))]
    df = spark.createDataFrame(rows, "path string, bytes binary")
    records = archives.read_archives(df.where("path <> '/n.zip'")).groupBy("archive_path", "error_code").count().collect()
    assert {(r["archive_path"], r["error_code"], r["count"]) for r in records} == {("/many.tar.gz", None, many), ("/cut.tar.gz", "ARCHIVE_ERROR", 1)}
    assert {r["depth"] for r in archives.expand_nested(df.where("path = '/n.zip'"), max_depth=None).collect()} == {1, 2, 3, 4, 5}


def test_member_cap_is_exact(spark):
    df = spark.createDataFrame([("/m.tar.zst", bytearray(archives.pack([("a", b"12345"), ("b", b"123456")], "tar.zst")))], "path string, bytes binary")
    got = {r["entry_path"]: (r["bytes"] and bytes(r["bytes"]), r["error_code"]) for r in archives.read_members(df, cap=5).collect()}
    assert got == {"a": (b"12345", None), "b": (None, "TOO_LARGE")}


SCAN = "path string, dir string, name string, ext string, size long, mtime long"


def files_of(*rows):
    return [(p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1], "txt", size, mtime) for p, size, mtime in rows]


def test_rescan_is_idempotent_and_partial_walks_keep_rows(spark):
    first = catalog.initial(spark.createDataFrame(files_of(("/r/a.txt", 1, 10), ("/r/b.txt", 2, 20), ("/q/c.txt", 3, 30)), SCAN), 1)
    done = catalog.mark_extracted(first, first, "content_indexed")
    again = spark.createDataFrame(files_of(("/r/a.txt", 1, 10), ("/r/b.txt", 2, 21)), SCAN)
    state = {r["path"]: (r["content_indexed"], r["gen"]) for r in catalog.rescan(done, again, "/r", 2).collect()}
    assert state == {"/r/a.txt": (True, 2), "/r/b.txt": (False, 2), "/q/c.txt": (True, 1)}
    partial = catalog.sweep_missing(catalog.apply_scan(done, again, 2), 2, ["/"], complete=False)
    assert partial.count() == 3
    swept = catalog.sweep_missing(catalog.apply_scan(done, again, 2), 2, ["/"])
    assert sorted(map(str, catalog.sweep_missing(catalog.apply_scan(swept, again, 2), 2, ["/"]).drop("content_indexed").collect())) == sorted(
        map(str, swept.drop("content_indexed").collect()))


def test_snapshots_follow_the_manifest(spark, tmp_path):
    base = str(tmp_path / "s")
    snapshots.write_snapshot({"t": spark.range(3)}, base, 1)
    snapshots.write_snapshot({"t": spark.range(5)}, base, 2)
    spark.range(9).write.parquet(f"{base}/gen-0000000003-dead/t")
    assert snapshots.read_snapshot(spark, base, "t")["t"].count() == 5


def test_changes_take_the_last_per_path(spark):
    old = catalog.initial(spark.createDataFrame(files_of(("/r/a.txt", 1, 10), ("/r/b.txt", 2, 20)), SCAN), 1)
    rows = [(*f, op, seq) for f, op, seq in zip(files_of(("/r/a.txt", 5, 50), ("/r/a.txt", 6, 60), ("/r/b.txt", 2, 20), ("/r/n.txt", 7, 70)),
                                                ("put", "put", "delete", "put"), (1, 2, 3, 4))]
    out = {r["path"]: r["size"] for r in changes.apply_changes(old, spark.createDataFrame(rows, changes.CHANGE), 2).collect()}
    assert out == {"/r/a.txt": 6, "/r/n.txt": 7}


def test_segments_and_keyframes(spark):
    plans = spark.createDataFrame([("/v", 30.4, 10.0), ("/long", 10.0**9, 4.0), ("/none", 0.0, 4.0)], "path string, duration_sec double, seg_sec double")
    assert media.segment_schedule(plans.where("path = '/long'").withColumn("duration_sec", F.lit(10.0**6))).count() == 250_000
    rows = media.segment_schedule(plans, max_segments=100_000).collect()
    assert [(r["n"], round(r["duration"], 3)) for r in rows if r["path"] == "/v"] == [(0, 10.0), (1, 10.0), (2, 10.4)]
    assert [r["error_code"] for r in rows if r["path"] == "/long"] == ["TOO_LARGE"] and not [r for r in rows if r["path"] == "/none"]
    p = spark.createDataFrame([("/v", 10.0, 4, 0.0, True)], "path string, seg_sec double, segment_count long, start_sec double, copy_video boolean")
    k = spark.createDataFrame([("/v", t, t - 0.1) for t in (0.0, 10.0, 29.5)], "path string, pts double, dts double")
    cuts = media.segment_cuts(p, k).orderBy("n").collect()
    assert [(c["copy_video"], None if c["end_raw"] is None else round(c["end_raw"], 6)) for c in cuts] == [
        (True, 9.9), (True, 19.9), (False, 29.5), (True, None)]


def test_parts_do_not_change_the_answer(spark):
    """Two keys, one key with all rows but three, and NULL keys and values, in one part and in many."""
    t = F.pmod(F.hash("id"), F.lit(5000)).cast("double")
    value = F.when(F.col("id") % 7 > 0, F.col("id"))
    two = spark.range(400).select((F.col("id") % 2).alias("k"), t.alias("t"), F.col("id").alias("s"), value.alias("v"))
    one = spark.range(400).select(F.when(F.col("id") > 396, F.col("id")).when(F.col("id") != 5, F.lit(9)).alias("k"), t.alias("t"), F.col("id").alias("s"), value.alias("v"))
    for rows in (two, one):
        told = rows.orderBy("t", "s").collect()
        before, known, last, held = {}, {}, {}, {}
        for r in told:
            before[r["s"]] = last.get(r["k"])
            last[r["k"]] = r["v"]
            held[r["k"]] = held.get(r["k"]) if r["v"] is None else r["v"]
            known[r["s"]] = held[r["k"]]
        for n in (1, 5, 60):
            assert {r["s"]: r["p"] for r in ordered.previous(rows, ["k"], "t", "s", "v", "p", n).collect()} == before
            assert {r["s"]: r["p"] for r in ordered.last_known(rows, ["k"], "t", "s", "v", "p", n).collect()} == known
    runs = [sorted(map(str, ordered.sessions(two, ["k"], "t", "s", 20.0, n).collect())) for n in (1, 40)]
    assert runs[0] == runs[1] and len(runs[0]) > 10


def test_one_key_is_spread_over_all_parts(spark):
    rows = spark.range(8000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(0).alias("s"))
    sizes = [r["count"] for r in ordered.in_parts(rows, ["k"], "t", "s", 16).groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 8000 / 16


def test_unreadable_probes_cost_only_themselves(spark):
    probes = metadata.parse_probes(spark.createDataFrame([
        ("/a.mkv", '{"format":{"format_name":"matroska,webm"},"streams":[{"index":0,"codec_type":"video","codec_name":"mjpeg"},{"index":1,"codec_type":"video","codec_name":"h264","width":640,"height":360}]}'),
        ("/b.mkv", "not json")], "path string, json string"))
    got = {(r["path"], r["key"], r["value"]) for r in metadata.video_fields(probes).collect()}
    assert ("/a.mkv", "video.codec", "h264") in got and ("/a.mkv", "video.container", "matroska") in got and not [g for g in got if g[0] == "/b.mkv"]
    assert {r["path"]: r["error_code"] for r in media.probe_records(probes).collect()} == {"/a.mkv": None, "/b.mkv": "ENCODING_ERROR"}


def test_damaged_members_cost_only_themselves(spark):
    import io
    import zipfile

    def zipped(*files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files:
                z.writestr(name, data)
        return out.getvalue()

    inner = zipped(("x.txt", b"inner text"))
    good = zipped(("a.txt", b"first"), ("in.zip", inner), ("./in.zip", zipped(("y.txt", b"second of the name"))), ("z.txt", b"last"))
    bad = good.replace(b"inner text", b"inner tex!", 1)
    df = spark.createDataFrame([("/good.zip", bytearray(good)), ("/bad.zip", bytearray(bad))], "path string, bytes binary")
    rows = archives.expand_nested(df, max_depth=2).collect()
    listed = [(r["archive_path"], r["raw"], r["error_code"]) for r in rows if r["depth"] == 1]
    assert len(listed) == 8 and [(a, n) for a, n, e in listed if e] == [("/bad.zip", "in.zip")]
    assert {(r["archive_path"], r["raw"]) for r in rows if r["depth"] == 2} == {("/good.zip!/in.zip", "x.txt"), ("/bad.zip!/in.zip", "y.txt")}
    members = {(r["archive_path"], r["entry_path"]): (r["bytes"] is not None, r["error_code"]) for r in archives.read_members(df).collect()}
    assert members["/bad.zip", "in.zip"] == (False, "ARCHIVE_ERROR") and members["/bad.zip", "z.txt"] == (True, None)
