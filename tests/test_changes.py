"""Tables in parts under a change stream, and joins of bucketed snapshots."""

import contextlib
import io
from pathlib import Path

import pytest

from filelake.operators import catalog, index_generations
from filelake.schema import CONTENT, FILES, SCAN
from filelake.sources import bucketed, parts
from filelake.streaming import changes

DEPENDENTS = {"content": (CONTENT, "content_indexed")}


def catalogue(spark, n):
    scan = spark.createDataFrame([(f"/a/f{i}.txt", "/a", f"f{i}.txt", "txt", 10, 100) for i in range(n)], SCAN)
    bodies = spark.createDataFrame([(f"/a/f{i}.txt", f"word{i} common") for i in range(n)], CONTENT)
    return catalog.mark_extracted(catalog.initial(scan, 1), bodies, "content_indexed"), bodies


def change(path, op, seq, mtime=100):
    folder, name = path.rsplit("/", 1)
    return path, folder, name, "txt", 10, mtime, op, seq


def written(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("parts"))
    files, bodies = catalogue(spark, 40)
    parts.create({"files": files, "content": bodies}, f"{base}/tables", parts=16, last_full_scan=7)
    index_generations.create_index(files, bodies, f"{base}/index")
    return base


def rows_in_force(spark, base):
    at = parts.state(spark, f"{base}/tables")
    files = parts.read(spark, at, "files", FILES)
    return at, {(r["path"], r["mtime"], r["content_indexed"]) for r in files.collect()}, {r["path"] for r in parts.read(spark, at, "content", CONTENT).collect()}


def test_only_touched_parts_are_written(spark, made, monkeypatch):
    batch = spark.createDataFrame([
        change("/a/f3.txt", "put", 1, 200), change("/a/f3.txt", "delete", 0), change("/a/f5.txt", "delete", 2), change("/a/f9.txt", "put", 3),
        change("/a/new.txt", "put", 4), change("/a/none.txt", "delete", 5)], changes.CHANGE)
    before = parts.state(spark, f"{made}/tables")
    touched = {r[0] for r in batch.select(before.part_of()).collect()}
    old = written(f"{made}/tables")

    # a run that dies before its manifest row leaves all as it was
    announce = parts.announce
    monkeypatch.setattr(parts, "announce", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        changes.refresh_parts(spark, f"{made}/tables", batch, 2, DEPENDENTS, f"{made}/index")
    assert rows_in_force(spark, made)[1] == {(f"/a/f{i}.txt", 100, True) for i in range(40)}
    monkeypatch.setattr(parts, "announce", announce)

    for _ in range(2):  # the second call finds its generation in force
        changes.refresh_parts(spark, f"{made}/tables", batch, 2, DEPENDENTS, f"{made}/index")
    at, files, bodies = rows_in_force(spark, made)
    kept = {i for i in range(40) if i not in (3, 5)}
    assert files == {(f"/a/f{i}.txt", 100, True) for i in kept} | {("/a/f3.txt", 200, False), ("/a/new.txt", 100, False)}
    assert bodies == {f"/a/f{i}.txt" for i in kept} and (at.gen, at.last_full_scan) == (2, 7)
    fresh = {f for f in written(f"{made}/tables") - old if not f.startswith("parts/")}
    assert old <= written(f"{made}/tables")
    assert fresh and {int(f.split("part_=")[1].split("/")[0]) for f in fresh} <= touched and len(touched) < 16
    assert {p for p, g in at.of_part.items() if g == 2} == touched

    # the index equals one that is built from the tables
    index_generations.create_index(parts.read(spark, at, "files", FILES), parts.read(spark, at, "content", CONTENT), f"{made}/again")
    seen = []
    for folder in ("index", "again"):
        t = index_generations.open_generations(spark, f"{made}/{folder}")
        seen.append(({(r["corpus"], r["term"], r["df"]) for r in t.vocab.collect()}, {tuple(r) for r in t.corpus_stats.collect()},
                     {(r["corpus"], r["term"], r["path"]) for r in t.postings.collect()}))
    assert seen[0] == seen[1] and ("bodies", "common", 38) in seen[0][0]


def test_an_empty_batch_is_a_generation(spark, made):
    before = rows_in_force(spark, made)
    gen = before[0].gen + 1
    changes.refresh_parts(spark, f"{made}/tables", spark.createDataFrame([], changes.CHANGE), gen, DEPENDENTS)
    after = rows_in_force(spark, made)
    assert after[1:] == before[1:] and after[0].gen == gen


def test_a_bucketed_snapshot_does_not_move(spark, tmp_path):
    files, _ = catalogue(spark, 30)
    bucketed.write_bucketed(files, f"{tmp_path}/old", 8)
    old = bucketed.read_bucketed(spark, f"{tmp_path}/old", FILES, 8)
    scan = spark.createDataFrame([(f"/a/f{i}.txt", "/a", f"f{i}.txt", "txt", 10, 100 + i // 30) for i in range(5, 35)] + [("/a/f7.md", "/a", "f7.md", "md", 1, 1)], SCAN)
    diff = catalog.diff_snapshots(old, scan)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        diff.explain()
    assert plan.getvalue().count("Exchange") == 1 and "Bucketed: true" in plan.getvalue()
    counts = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
    assert counts == {"new": 6, "removed": 5, "unchanged": 25}
    assert sorted(map(tuple, diff.collect())) == sorted(map(tuple, catalog.diff_snapshots(files, scan).collect()))
