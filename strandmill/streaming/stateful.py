"""Caps, strides and bounds of groups on a stream, in the order of event time, with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "group string, id bigint, outcome string"
WAITING = pa.schema([("group", pa.string()), ("id", pa.int64()), ("ms", pa.int64()), ("value", pa.float64())])
COUNTERS = pa.schema([("group", pa.string()), ("seen", pa.int64()), ("kept", pa.int64())])


def to_bytes(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def from_bytes(parts: list[bytes], schema: pa.Schema) -> pd.DataFrame:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(p).read_all() for p in parts]]).to_pandas()


class RunningCap(StatefulProcessor):
    """Keeps every ``every``-th row of a group from ``least`` on, at most ``most`` of them; all others get the reason they are skipped.

    A key is a part of the groups. Its rows wait until the watermark has passed their hour and are then judged, all
    that are due at once, by time and id, so the outcome is that of a table, whatever the batches are. State is the
    rows of open hours and two counters a group; one timer stands at a time, at the end of the first hour that waits.
    """

    def __init__(self, least: float, every: int, most: int):
        self.least, self.every, self.most = least, every, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "counters binary")
        self.waiting = handle.getListState("waiting", "rows binary")
        self.first = handle.getValueState("first", "ms bigint")

    def wait(self, frames: list[pd.DataFrame], last: int | None) -> None:
        """Adds rows to those that wait; ``last`` is where the timer stands, if there is one."""
        ends = [(int(f["ms"].min()) // HOUR + 1) * HOUR for f in frames if len(f)]
        self.waiting.appendList([(to_bytes(f, WAITING),) for f in frames if len(f)]) if ends else None
        if ends and (last is None or min(ends) < last):
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(min(ends))
            self.first.update((min(ends),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [pd.DataFrame({"group": b["group"], "id": b["id"], "ms": b["ts"].astype("datetime64[ms]").astype("int64"), "value": b["value"]}) for b in rows]
        self.wait(frames, self.first.get()[0] if self.first.exists() else None)
        yield pd.DataFrame({"group": pd.Series(dtype="str"), "id": pd.Series(dtype="int64"), "outcome": pd.Series(dtype="str")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = timerValues.getCurrentWatermarkInMs() // HOUR * HOUR
        held = from_bytes([r[0] for r in self.waiting.get()], WAITING)
        due, rest = held[held["ms"] < end].sort_values(["ms", "id"]), held[held["ms"] >= end]
        counters = from_bytes([self.counters.get()[0]] if self.counters.exists() else [], COUNTERS)
        names = pd.Index(counters["group"]).append(pd.Index(due["group"])).unique()
        counters = counters.set_index("group").reindex(names, fill_value=0)
        group = names.get_indexer(due["group"])
        before = lambda marked: pd.Series(marked.astype(np.int64)).groupby(group).cumsum().to_numpy() - marked
        added = lambda marked: np.bincount(group[marked], minlength=len(names))
        high = ~(due["value"].to_numpy() < self.least)
        on = high & ((counters["seen"].to_numpy()[group] + before(high)) % self.every == 0)
        kept = on & (counters["kept"].to_numpy()[group] + before(on) < self.most)
        outcome = np.select([~high, ~on, kept], ["below_least", "off_stride", "kept"], "over_cap")
        grown = pd.DataFrame({"group": names, "seen": counters["seen"].to_numpy() + added(high), "kept": counters["kept"].to_numpy() + added(kept)})
        self.counters.update((to_bytes(grown, COUNTERS),))
        self.waiting.clear()
        self.first.clear()
        self.wait([rest], None)
        yield pd.DataFrame({"group": due["group"].to_numpy(), "id": due["id"].to_numpy(), "outcome": outcome})

    def close(self) -> None:
        pass


def running_cap(rows: DataFrame, least: float, every: int, most: int, late: str = "2 hours", parts: int = 240) -> DataFrame:
    """``(group, id, outcome)`` of a stream ``(group, id, ts, value)``: ``kept`` or the reason, of all rows whose hour is closed.

    Rows that come later than ``late`` are dropped by the watermark. Groups are dealt to ``parts`` keys of the state,
    so its calls do not grow with the groups; a task holds the open hours of a part at a time. The session's state
    store becomes RocksDB, which holds states beyond memory.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("group"), F.lit(parts)).cast("int")).withWatermark("ts", late)
    return dealt.groupBy("_part").transformWithStateInPandas(RunningCap(least, every, most), OUT, "append", "eventtime")
