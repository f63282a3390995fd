"""Change events as streams.

``debounce`` is an event-time session per path under a watermark. ``watch``
applies micro-batches of events to an index: the last event of each path wins,
deletes go before creates and changes, and a batch's number is stored in the
manifest, so a batch that is replayed after a failure isn't applied twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import events as E
from ..sources import walk
from ..sources.index_store import IndexStore
from ..sources.shared import checkpointed

EVENTS = "seq bigint, ts timestamp, kind string, path string, from_path string"
DEBOUNCE_MS, BATCH = 500, 100
#: Failures of a batch after which a query stops, the one from which it pauses, and the longest pause in seconds.
STOP_AFTER, PAUSE_FROM, MOST_PAUSE = 10, 3, 60.0


def check_bounds(debounce_ms: int = DEBOUNCE_MS, batch: int = BATCH) -> tuple[int, int]:
    if not 50 <= debounce_ms <= 10_000:
        raise ValueError("the debounce must be from 50 ms to 10 s")
    if not 1 <= batch <= 10_000:
        raise ValueError("the batch must be from 1 to 10000")
    return debounce_ms, batch


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events appended as Parquet files; ``files_per_trigger`` is the back pressure."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def debounce(stream: DataFrame, debounce_ms: int = DEBOUNCE_MS, late: str = "10 seconds") -> DataFrame:
    """One row for each burst of a path; bursts are emitted once the watermark has passed them."""
    check_bounds(debounce_ms)
    return E.debounced(stream.withWatermark("ts", late), f"{debounce_ms} milliseconds")


def _of_folders(store: IndexStore, batch: DataFrame) -> DataFrame:
    """path, action of what a batch's folder events stand for: the files below a new folder, and those the index has below one that went."""
    last = E.last_wins(batch.where(F.col("kind").startswith("Directory")).select("path", "kind", "seq")).persist()
    out = store.spark.createDataFrame([], "path string, action string")
    try:
        new, gone = last.where("kind = 'DirectoryCreated'"), last.where("kind = 'DirectoryDeleted'")
        if not new.isEmpty():
            out = out.unionByName(walk.unfolded(new).where("error is null").select("path", F.lit("created").alias("action")).distinct())
        if not gone.isEmpty():
            parts = F.split("path", "/")
            folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
            held = store.times().select("path", F.explode(folders).alias("folder"))
            below = held.join(gone.select(F.rtrim("path", F.lit("/")).alias("folder")), "folder", "left_semi").select("path").distinct()
            out = out.unionByName(checkpointed(below.withColumn("action", F.lit("deleted"))))
    finally:
        last.unpersist()
    return out


class Figures(StreamingQueryListener):
    """What a session's streaming queries have done so far, by query name or id: batches, rows, milliseconds, what ``watch`` observes of its
    events, and the error a query ended with. Register it with ``spark.streams.addListener``."""

    def __init__(self):
        self.of: dict[str, dict] = {}

    def _entry(self, key: str) -> dict:
        return self.of.setdefault(key, {"batches": 0, "rows": 0, "ms": 0, "events": {}, "error": None, "running": True})

    def onQueryStarted(self, event) -> None:
        self._entry(str(event.id))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        e = self._entry(str(p.id))
        if p.numInputRows:
            e["batches"] += 1
            e["rows"] += p.numInputRows
        e["ms"] += p.batchDuration
        for row in p.observedMetrics.values():
            for k, v in row.asDict().items():
                e["events"][k] = e["events"].get(k, 0) + (v or 0)

    def onQueryTerminated(self, event) -> None:
        self._entry(str(event.id)).update(error=event.exception, running=False)

    def onQueryIdle(self, event) -> None:
        pass


def observed(stream: DataFrame, name: str = "events") -> DataFrame:
    """``stream`` with its events counted by kind on the way, for ``Figures``."""
    kinds = {k.lower(): F.count_if(F.col("kind") == k) for k in ("Created", "Modified", "Deleted", "Renamed", "DirectoryCreated", "DirectoryDeleted")}
    return stream.observe(name, F.count(F.lit(1)).alias("all"), *(c.alias(k) for k, c in kinds.items()))


def apply_batch(store: IndexStore, batch: DataFrame, make: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame | None] | None], number: int, visible: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Apply one batch as a delta of the index; ``make`` turns rows (path) into indexed chunks, and rejects (path, error) if it has
    any. A path without chunks that isn't rejected is one that failed; its old chunks go.

    ``visible`` keeps those of the rows (path) that may be indexed. Counters: added, updated, removed, failed. The paths stay
    rows of tables throughout; nothing of the index is rewritten but what merging by size asks for.
    """
    m = store.manifest()
    counts = {"added": 0, "updated": 0, "removed": 0, "failed": 0}
    if number >= 0 and m.batch >= number:
        return counts
    # several jobs read the batch; the source is read once
    batch = batch.persist()
    try:
        return _applied(store, batch, make, number, visible) or counts
    finally:
        batch.unpersist()


def _applied(store: IndexStore, batch: DataFrame, make: Callable, number: int, visible: Callable | None) -> dict[str, int] | None:
    acts = E.last_wins(E.expanded(batch.where(~F.col("kind").startswith("Directory")))).select("path", "action")
    acts = acts.unionByName(_of_folders(store, batch).join(acts, "path", "left_anti"))
    gone, wanted = acts.where("action = 'deleted'").select("path"), acts.where("action <> 'deleted'").select("path")
    if visible is not None:
        wanted = visible(wanted)
    acts = gone.withColumn("deleted", F.lit(True)).unionByName(wanted.withColumn("deleted", F.lit(False)))
    if acts.isEmpty():
        return None
    # only what the index knows can be deleted
    gone = acts.where("deleted").select("path").join(store.times().select("path"), "path", "left_semi")
    wanted = acts.where("not deleted").select("path")
    made = make(wanted)
    rows, rejects = made if isinstance(made, tuple) else (made, None)
    done = rows.select(F.col("file_path").alias("path")).distinct() if rows is not None else None
    lost = (wanted.join(done, "path", "left_anti") if done is not None else wanted).withColumn("error", F.lit("no chunks"))
    failed = lost if rejects is None else rejects.select("path", "error").unionByName(lost.join(rejects, "path", "left_anti"))
    return store.upsert(rows, wanted.withColumn("mtime", F.current_timestamp()), gone, rejects=failed, batch=number)[1]


def watch(stream: DataFrame, store: IndexStore, make: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame | None] | None], checkpoint: str, *, every: str | None = None, seen: list[dict[str, int]] | None = None, visible: Callable[[DataFrame], DataFrame] | None = None, sleep: Callable[[float], None] = time.sleep) -> StreamingQuery:
    """Start applying ``stream`` to ``store``; without ``every`` it takes what is there and ends.

    A batch that fails is tried again, from the third time on after a pause that doubles; after ``STOP_AFTER`` failures in a row the
    query stops with the last error, and starts there again. ``seen`` gets each batch's counters.
    """

    def each(batch: DataFrame, number: int) -> None:
        for failures in range(STOP_AFTER):
            try:
                counts = apply_batch(store, batch, make, number, visible)
                break
            except Exception:
                if failures + 1 == STOP_AFTER:
                    raise
                if failures + 1 >= PAUSE_FROM:
                    sleep(min(MOST_PAUSE, 2.0 ** (failures + 1 - PAUSE_FROM)))
        if seen is not None:
            seen.append(counts)

    writer = observed(stream).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The record sink: what is there now, appended exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def latest(store_rows: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """State of a keyed change log: the latest row by key."""
    return E.last_wins(store_rows.withColumnRenamed(key, "path"), order).withColumnRenamed("path", key)
