"""Change events collected into batches: a batch goes out when it has been quiet for a while, or when it is full.

State is held by key, the lane of a path: the latest action of each pending path, when the last event came and how
many batches there have been. An event-time timer stands at the last event plus the quiet time; when the watermark
passes it, what is pending goes out and the lane's pending paths are dropped. So it does as soon as ``most`` paths are
pending, or when an event comes that is later than the quiet time. Paths are dealt to lanes by a hash, so one root with
very many changes is the work of many tasks; a batch is full or quiet by lane.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events as E
from .watch import BATCH, DEBOUNCE_MS, check_bounds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COLLECTED = "lane int, batch bigint, reason string, path string, action string, seq bigint, ts timestamp"
LANES = 1


class Collector(StatefulProcessor):
    """Rows (lane, path, action, seq, at: milliseconds) to rows of ``COLLECTED``."""

    def __init__(self, quiet_ms: int, most: int):
        self.quiet_ms, self.most = quiet_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "action string, seq bigint, at bigint")
        self.meta = handle.getValueState("meta", "n int, last bigint, batches bigint")

    def _flush(self, lane: int, reason: str, batches: int) -> pd.DataFrame:
        rows = sorted(((k[0], *v) for k, v in self.pending.iterator()), key=lambda r: (r[2], r[0]))
        self.pending.clear()
        out = pd.DataFrame(rows, columns=["path", "action", "seq", "at"])
        return out.assign(lane=lane, batch=batches, reason=reason, ts=pd.to_datetime(out["at"], unit="ms"))[["lane", "batch", "reason", "path", "action", "seq", "ts"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last, batches = self.meta.get() if self.meta.exists() else (0, -1, 0)
        events = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        for path, action, seq, at in zip(events["path"], events["action"], events["seq"].tolist(), events["at"].tolist()):
            if n and at - last > self.quiet_ms:
                yield self._flush(key[0], "quiet", batches)
                n, batches = 0, batches + 1
            held = self.pending.getValue((path,)) if n and self.pending.containsKey((path,)) else None
            n += held is None
            if held is None or (at, seq) >= (held[2], held[1]):
                self.pending.updateValue((path,), (action, seq, at))
            last = max(last, at)
            if n >= self.most:
                yield self._flush(key[0], "full", batches)
                n, batches = 0, batches + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if n:
            self.handle.registerTimer(last + self.quiet_ms)
        self.meta.update((n, last, batches))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last, batches = self.meta.get()
        if n:
            yield self._flush(key[0], "quiet", batches)
            self.meta.update((0, last, batches + 1))

    def close(self) -> None:
        pass


def collected(stream: DataFrame, quiet_ms: int = DEBOUNCE_MS, most: int = BATCH, *, lanes: int = LANES, late: str = "10 seconds") -> DataFrame:
    """Batches of the stream's events (kind, path, from_path, seq, ts), the last event of each path in a batch.

    The session must keep its state in RocksDB (``PROVIDER``), as stateful processors need.
    """
    check_bounds(quiet_ms, most)
    if stream.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    each = E.expanded(stream.withWatermark("ts", late))
    keyed = each.select(F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int").alias("lane"), "path", "action", "seq", F.unix_millis("ts").alias("at"), "ts")
    return keyed.groupBy("lane").transformWithStateInPandas(Collector(quiet_ms, most), COLLECTED, "Append", "EventTime")
