"""Status feeds: thinning to one update a second, and alerts for quiet feeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import ordered

WATERMARK = "10 minutes"
STATUS_COLUMNS = ("state", "progress", "last_full_scan")


# --- one update per second --------------------------------------------------------------------------------

def coalesce_status(status: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """Newest status of each index in each second: ``index_id, second, seq, state, progress, last_full_scan``.

    Works on a stream and on a table. On a stream rows later than the watermark are dropped; the last second
    before the watermark is emitted once it has passed.
    """
    rows = status.withWatermark("ts", watermark) if status.isStreaming else status
    newest = rows.groupBy("index_id", F.window("ts", "1 second").alias("w")).agg(
        F.max_by(F.struct("seq", *STATUS_COLUMNS), F.struct("ts", "seq")).alias("s"))
    return newest.select("index_id", F.col("w.start").alias("second"), "s.*")


_TRANSITION = T.StructType([
    T.StructField("index_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
    T.StructField("state", T.StringType()), T.StructField("previous", T.StringType()),
])
_BYTES = T.StructType([T.StructField("rows", T.BinaryType())])
GROUPS = 64  # of indexes; part of the state, so a stream keeps the number it began with

Index = tuple[bool, int]  # whether the id is known, and the id


def _packed(columns: dict[str, list | np.ndarray], types: dict[str, pa.DataType]) -> tuple[bytes]:
    table = pa.table({name: pa.array(columns[name], kind) for name, kind in types.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(row: tuple) -> pa.Table:
    return pa.ipc.open_stream(row[0]).read_all()


class InOrder(StatefulProcessor):
    """Holds the rows of a group of indexes until the watermark has passed them, then hands them on in order of (index, ts, seq).

    Rows may come in any order within the watermark's delay, over any number of batches. Pending rows are a list state of
    blocks, to which a batch appends one; one timer per group, at its earliest pending row, releases them. What is kept of each
    index is one block. So a batch costs a few calls per group, and rows are handled as columns.
    """

    KEPT: dict[str, pa.DataType]
    ROWS = {"known": pa.bool_(), "id": pa.int64(), "micros": pa.int64(), "seq": pa.int64(), "state": pa.string()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _BYTES)
        self.kept = handle.getValueState("kept", _BYTES)

    def deadline(self, kept: dict[Index, tuple]) -> int | None:
        """A further time, in microseconds, at which the group has to be looked at."""
        return None

    def ordered(self, ids: list[Index], rows: pd.DataFrame, first: np.ndarray, kept: dict[Index, tuple], passed: int) -> pd.DataFrame:
        """What follows from released rows (micros, seq, state) of ``ids``; ``first`` are the places where another index begins.
        The watermark is at ``passed`` microseconds. Brings ``kept``, a tuple for each index seen so far, up to date."""
        raise NotImplementedError

    def _arm(self, due: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))  # milliseconds, not before the row

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat([b.assign(micros=b["ts"].to_numpy("datetime64[us]").astype("int64")) for b in rows])
        new = new[new["micros"] > passed]  # later rows have been released already
        if len(new):
            self.pending.appendValue(_packed({c: new[c].astype("int64").to_numpy() if c == "seq" else new[c].to_numpy() for c in self.ROWS}, self.ROWS))
            earliest, armed = int(new["micros"].min()), list(self.handle.listTimers())
            if not armed or min(armed) * 1000 > earliest:
                self._arm(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [_unpacked(block) for block in self.pending.get()]
        rows = (pa.concat_tables(blocks) if blocks else pa.schema(list(self.ROWS.items())).empty_table()).to_pandas()
        late = rows["micros"].to_numpy() > passed
        later, rows = rows[late], rows[~late]
        if len(later):
            self.pending.put([_packed({c: later[c].to_numpy() for c in self.ROWS}, self.ROWS)])
        else:
            self.pending.clear()
        rows = rows.sort_values(["known", "id", "micros", "seq"], kind="stable", ignore_index=True)
        known, number = rows["known"].to_numpy(bool), rows["id"].to_numpy("int64")
        another = np.ones(len(rows), bool)
        another[1:] = (known[1:] != known[:-1]) | (number[1:] != number[:-1])
        kept = self._kept()
        out = self.ordered(list(zip(known.tolist(), number.tolist())), rows, np.flatnonzero(another), kept, passed)
        if kept:
            ids = {"known": [i[0] for i in kept], "id": [i[1] for i in kept]}
            values = dict(zip(self.KEPT, map(list, zip(*kept.values()))))
            self.kept.update(_packed(ids | values, {"known": pa.bool_(), "id": pa.int64()} | self.KEPT))
        due = [t for t in (int(later["micros"].min()) if len(later) else None, self.deadline(kept)) if t is not None]
        self._arm(min(due) if due else None)
        if len(out):
            yield out

    def _kept(self) -> dict[Index, tuple]:
        if not self.kept.exists():
            return {}
        table = _unpacked(self.kept.get())
        return dict(zip(zip(*(table[c].to_pylist() for c in ("known", "id"))), zip(*(table[c].to_pylist() for c in self.KEPT))))

    def close(self) -> None:
        pass


def _column(ids: list[Index]) -> pd.Series:
    return pd.Series([number if known else None for known, number in ids], dtype="Int64")


class _Changes(InOrder):
    KEPT = {"state": pa.string()}

    def ordered(self, ids, rows, first, kept, passed):
        state = rows["state"].to_numpy(object)
        before = np.empty(len(rows), object)
        before[1:] = state[:-1]
        new = np.zeros(len(rows), bool)
        for at in first:
            new[at] = ids[at] not in kept
            before[at] = kept.get(ids[at], (None,))[0]
        for end in [*(first[1:] - 1), len(rows) - 1] if len(rows) else []:
            kept[ids[end]] = (state[end],)
        told = np.flatnonzero(new | (state != before))
        return pd.DataFrame({
            "index_id": _column([ids[i] for i in told]), "ts": pd.to_datetime(rows["micros"].to_numpy()[told], unit="us"),
            "seq": rows["seq"].to_numpy()[told], "state": state[told], "previous": before[told]})


def _in_order(status: DataFrame, watermark: str, processor: InOrder, schema: T.StructType, groups: int) -> DataFrame:
    """Streams with list state and timers need the RocksDB store, which is a setting of the session."""
    status.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = status.withWatermark("ts", watermark).select(
        F.pmod(F.xxhash64("index_id"), F.lit(groups)).alias("group"), F.col("index_id").isNotNull().alias("known"),
        F.coalesce("index_id", F.lit(0)).cast("long").alias("id"), "ts", "seq", "state")
    return rows.groupBy("group").transformWithStateInPandas(processor, schema, "append", "eventTime")


def status_transitions(status: DataFrame, watermark: str = WATERMARK, groups: int = GROUPS) -> DataFrame:
    """Every change of state, in order of time however rows arrive (streams only).

    A change is told once the watermark has passed it; rows later than that are dropped. What is held for an index are the
    rows of the watermark's delay, not those of its history. The table form below has no group per index at all.
    """
    return _in_order(status, watermark, _Changes(), _TRANSITION, groups)


def status_transitions_batch(status: DataFrame) -> DataFrame:
    """The same on a table, by looking one row back."""
    rows = status.withColumn("t", F.unix_micros("ts") / 1e6)
    back = ordered.previous(rows, ["index_id"], "t", "seq", "state", "previous")
    return back.where(F.col("previous").isNull() | (F.col("previous") != F.col("state"))).select(*_TRANSITION.names)


# --- quiet feeds ------------------------------------------------------------------------------------------

_ALERT = T.StructType([
    T.StructField("index_id", T.LongType()), T.StructField("last_ts", T.TimestampType()), T.StructField("due", T.TimestampType()),
])


class _Pauses(InOrder):
    KEPT = {"micros": pa.int64(), "told": pa.bool_()}

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def deadline(self, kept):
        return min((last + self.gap for last, told in kept.values() if not told), default=None)

    def ordered(self, ids, rows, first, kept, passed):
        micros = rows["micros"].to_numpy("int64")
        last = np.empty(len(rows), "int64")
        last[1:] = micros[:-1]
        paused = np.zeros(len(rows), bool)
        paused[1:] = micros[1:] - last[1:] >= self.gap
        for at in first:
            before, told = kept.get(ids[at], (None, True))
            paused[at] = not told and micros[at] - before >= self.gap
            last[at] = before or 0
        for end in [*(first[1:] - 1), len(rows) - 1] if len(rows) else []:
            kept[ids[end]] = (int(micros[end]), False)
        quiet = [i for i, (at, told) in kept.items() if not told and at + self.gap <= passed]
        pauses = [*zip([ids[i] for i in np.flatnonzero(paused)], last[paused].tolist()), *((i, kept[i][0]) for i in quiet)]
        for i in quiet:
            kept[i] = (kept[i][0], True)
        began = np.array([t for _, t in pauses], "int64")
        return pd.DataFrame({"index_id": _column([i for i, _ in pauses]), "last_ts": pd.to_datetime(began, unit="us"),
                             "due": pd.to_datetime(began + self.gap, unit="us")})


def stall_alerts(status: DataFrame, gap_seconds: float = 15.0, watermark: str = WATERMARK, groups: int = GROUPS) -> DataFrame:
    """One alert per pause of at least ``gap_seconds`` in a stream of status rows.

    Rows are taken in order of time however they arrive. A pause shows either when the next row is released or, when none
    comes, when the watermark passes the deadline.
    """
    return _in_order(status, watermark, _Pauses(round(gap_seconds * 1_000_000)), _ALERT, groups)


def stall_alerts_batch(status: DataFrame, gap_seconds: float = 15.0) -> DataFrame:
    """Pauses between two rows of a table of status rows."""
    rows = status.withColumn("t", F.unix_micros("ts"))
    back = ordered.previous(rows, ["index_id"], "t", "seq", "t", "before")
    quiet = back.where(F.col("t") - F.col("before") >= int(gap_seconds * 1_000_000))
    return quiet.select(
        "index_id", F.timestamp_micros("before").alias("last_ts"),
        F.timestamp_micros((F.col("before") + int(gap_seconds * 1_000_000)).cast("long")).alias("due"))
