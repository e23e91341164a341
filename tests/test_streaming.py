"""Streams whose rows arrive out of order, over several micro-batches."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from filelake.plans.streaming_queries import run_stream
from filelake.sources.status import STATUS
from filelake.streaming import status

DAY = datetime(2024, 5, 1)


def at(h, m=0):
    return DAY + timedelta(hours=h, minutes=m)


def stream(spark, folder, *files):
    """One micro-batch per file of (index_id, ts, seq, state)."""
    for rows in files:
        full = [(i, t, q, s, 0.0, 0) for i, t, q, s in rows]
        spark.createDataFrame(full, STATUS).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_transitions_are_those_of_the_ordered_rows(spark, tmp_path):
    files = [
        [(1, at(0), 1, "idle"), (1, at(2), 3, "idle"), (2, at(1), 1, "idle")],
        [(1, at(1), 2, "crawling")],  # one batch late
        [(1, at(3), 4, "idle"), (2, at(3, 30), 2, None), (2, at(3, 30), 3, "idle")],
        [(9, at(20), 1, "idle")],  # the watermark passes all the others
        [(1, at(2, 30), 9, "crawling"), (9, at(40), 2, "idle")],  # too late: dropped
        [(9, at(60), 3, "idle")],
    ]
    got = run_stream(status.status_transitions(stream(spark, tmp_path / "in", *files), "4 hours"), "transitions").collect()
    assert sorted((r.index_id, r.ts, r.seq, r.state, r.previous) for r in got if r.index_id != 9) == [
        (1, at(0), 1, "idle", None), (1, at(1), 2, "crawling", "idle"), (1, at(2), 3, "idle", "crawling"), (2, at(1), 1, "idle", None),
        (2, at(3, 30), 2, None, "idle"), (2, at(3, 30), 3, "idle", None)]


def test_pauses_of_rows_that_arrive_late(spark, tmp_path):
    files = [
        [(1, at(0), 1, "idle"), (1, at(2), 3, "idle"), (2, at(0), 1, "idle")],
        [(1, at(1), 2, "crawling")],  # fills what would have been a pause of two hours
        [(1, at(4), 4, "idle"), (9, at(20), 1, "idle")],
        [(2, at(19), 2, "idle"), (9, at(40), 2, "idle")],
        [(9, at(60), 3, "idle")],
    ]
    got = run_stream(status.stall_alerts(stream(spark, tmp_path / "in", *files), 5400, "4 hours"), "stalls").collect()
    assert sorted((r.index_id, r.last_ts, r.due) for r in got if r.index_id != 9) == [
        (1, at(2), at(3, 30)), (1, at(4), at(5, 30)), (2, at(0), at(1, 30)), (2, at(19), at(20, 30))]


def test_the_stream_equals_the_table(spark, tmp_path):
    """Thousands of rows in random order within the delay, in six batches."""
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id"), F.lit(5)).alias("index_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), F.col("id").alias("seq"),
        F.element_at(F.array(*map(F.lit, ["idle", "crawling", "paused"])), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(3)) + 1).cast("int")).alias("state"),
        F.lit(0.0).alias("progress"), F.lit(0).cast("long").alias("last_full_scan"))
    for k in range(6):
        late = F.floor((F.col("id") + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(300))) / 720) == k
        rows.withColumn("id", F.col("seq")).where(late).drop("id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    table = spark.read.schema(STATUS).parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {tuple(r) for r in run_stream(status.status_transitions(source, "1 hour"), "transitions").collect()}
    told = table.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    want = {tuple(r) for r in status.status_transitions_batch(table.where(F.col("ts") <= F.lit(told))).collect()}
    assert len(got) > 1000 and got == want


def test_groups_of_indexes_keep_them_apart(spark, tmp_path):
    """Few groups hold many indexes, one of them unknown; a batch appends one block to a group, however many rows it has."""
    ids = [None, 0, 3, 7, 8, -2, 1 << 60]
    files = [[(i, at(h, n), h * 10 + n, "idle" if (h + n) % 3 else None) for n, i in enumerate(ids)] for h in (0, 1, 2, 5)]
    files += [[(7, at(30), 900, "idle")], [(7, at(50), 901, "idle")], [(7, at(70), 902, "idle")]]
    source = stream(spark, tmp_path / "in", *files)
    seen, changes = {}, []
    for i, t, q, state in sorted((r for f in files for r in f if r[1] <= at(66)), key=lambda r: r[1:3]):
        if i not in seen or seen[i] != state:
            changes.append((i, t, q, state, seen.get(i)))
        seen[i] = state
    got = run_stream(status.status_transitions(source, "4 hours", groups=2), "transitions").collect()
    assert len(got) == len(changes) and {tuple(r) for r in got} == set(changes)
    pauses = run_stream(status.stall_alerts(source, 5400, "4 hours", groups=2), "stalls").collect()
    want = {(i, at(2, n), at(3, 30 + n)) for n, i in enumerate(ids)} | {(i, at(5, n), at(6, 30 + n)) for n, i in enumerate(ids)}
    want |= {(7, at(30), at(31, 30)), (7, at(50), at(51, 30))}
    assert len(pauses) == len(want) and {tuple(r) for r in pauses} == want


def test_a_batch_appends_one_block_to_a_group():
    import pandas as pd

    class Handle:
        timers: list = []

        def getListState(self, name, schema):
            self.calls = []
            return type("S", (), {"appendValue": lambda _, v: self.calls.append(v)})()

        def getValueState(self, name, schema):
            return None

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            self.timers = [at]

    work, handle = status._Changes(), Handle()
    work.init(handle)
    rows = pd.DataFrame({"known": True, "id": range(5000), "ts": pd.Timestamp(DAY), "seq": range(5000), "state": "idle"})
    clock = type("T", (), {"getCurrentWatermarkInMs": lambda _: 0})()
    assert list(work.handleInputRows((0,), iter([rows[:3000], rows[3000:]]), clock)) == []
    assert len(handle.calls) == 1 and status._unpacked(handle.calls[0]).num_rows == 5000 and len(handle.timers) == 1
