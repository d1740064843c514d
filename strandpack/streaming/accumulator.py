"""The two-tier proxy: live messages pass, bulk messages gather by sender and kind.

Each (sysid, msgid) has its own state: the records gathered so far and the next frame
number. A batch leaves when it reaches its target count, or when its deadline, counted from
the rows that it began with, passes by a processing-time timer. Frame numbers count per key, as one counter over all keys could
not be dealt out. ``batch_twin`` gives the same frames from a finished table.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandpack.functions import codec

OUTPUT = "key long, seq long, n int, n_bytes int, payload binary"


class Accumulator(StatefulProcessor):
    """Rows (key, ord, tie, v) to frames of ``target`` values each, by (ord, tie) within a micro-batch."""

    def __init__(self, target: int, deadline_ms: int | None = None):
        self.target, self.deadline = target, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "v long")
        self.seq = handle.getValueState("seq", "n long")

    def _frames(self, key, values: list[int], everything: bool):
        from strandpack.functions import codec

        seq = self.seq.get()[0] if self.seq.exists() else 0
        rows = []
        while len(values) >= self.target or (everything and values):
            part, values = values[: self.target], values[self.target :]
            data = codec.frame_encode(np.array(part, np.int64).astype(np.int32), 1, seq)
            rows.append((key[0], seq, len(part), len(data), data))
            seq += 1
        self.seq.update((seq,))
        if values:
            self.held.put([(int(v),) for v in values])
        else:
            self.held.clear()
        return pd.DataFrame(rows, columns=["key", "seq", "n", "n_bytes", "payload"])

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values(["ord", "tie"])["v"].tolist()
        was = [r[0] for r in self.held.get()] if self.held.exists() else []
        out = self._frames(key, was + new, False)
        if self.deadline and (len(out) or not was):
            # what is held now came with these rows, so earlier deadlines hold no longer
            self._forget_timers()
            if self.held.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.deadline)
        yield out

    def _forget_timers(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        values = [r[0] for r in self.held.get()] if self.held.exists() else []
        self._forget_timers()
        yield self._frames(key, values, True)

    def close(self) -> None:
        pass


def accumulate(stream: DataFrame, target: int, deadline_ms: int | None = None) -> DataFrame:
    """A streaming (key, ord, tie, v) to frames; state lives in RocksDB."""
    spark = stream.sparkSession
    # the state's planning worker does not get the files that executors are sent
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy("key").transformWithStateInPandas(Accumulator(target, deadline_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if deadline_ms else "None")


def batch_twin(rows: DataFrame, target: int, everything: bool = False) -> DataFrame:
    """The frames that a stream of these rows gives, all at once."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ord", "ascending"), ("tie", "ascending")])
        key, v = t.column("key")[0].as_py(), t.column("v").to_numpy().astype(np.int32)
        parts = [v[s : s + target] for s in range(0, len(v), target)]
        if parts and len(parts[-1]) < target and not everything:
            parts.pop()
        data = [codec.frame_encode(p, 1, s) for s, p in enumerate(parts)]
        return pa.table({"key": pa.array([key] * len(parts), pa.int64()), "seq": pa.array(range(len(parts)), pa.int64()), "n": pa.array([len(p) for p in parts], pa.int32()), "n_bytes": pa.array([len(d) for d in data], pa.int32()), "payload": pa.array(data, pa.binary())})

    return rows.groupBy("key").applyInArrow(run, OUTPUT)


def routed(stream: DataFrame, live_types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(live, bulk) branches of an event stream."""
    live = F.col("event_type").isin(live_types)
    return stream.filter(live), stream.filter(~F.coalesce(live, F.lit(False)))
