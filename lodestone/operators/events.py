"""File events: kinds, last event wins, debouncing.

Events are rows (path, from_path, kind, ts, seq); kinds are Modified, Created,
Deleted, Renamed, DirectoryCreated and DirectoryDeleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expanded(events: DataFrame) -> DataFrame:
    """action (modified, created, deleted) and path; a rename deletes one path and creates another."""
    one = lambda action, path: F.struct(F.lit(action).alias("action"), F.col(path).alias("path"))
    k = F.col("kind")
    acts = (
        F.when(k == "Modified", F.array(one("modified", "path")))
        .when(k.isin("Created", "DirectoryCreated"), F.array(one("created", "path")))
        .when(k.isin("Deleted", "DirectoryDeleted"), F.array(one("deleted", "path")))
        .when(k == "Renamed", F.array(one("deleted", "from_path"), one("created", "path")))
    )
    keep = [c for c in events.columns if c not in ("kind", "path", "from_path")]
    return events.select(*keep, F.explode(acts).alias("a")).select(*keep, "a.action", "a.path")


def by_kind(events: DataFrame) -> DataFrame:
    return expanded(events).groupBy("action").agg(F.count("*").alias("events"), F.countDistinct("path").alias("paths"))


def last_wins(events: DataFrame, order: str = "seq") -> DataFrame:
    """The last event of each path; an aggregate, so a busy path is combined before the shuffle."""
    rest = [c for c in events.columns if c != "path"]
    return events.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("e")).select("path", "e.*")


def debounced(events: DataFrame, gap: str = "500 milliseconds", ts: str = "ts") -> DataFrame:
    """Bursts: events of a path less than ``gap`` apart become one with the latest kind, from first to last time."""
    spans = events.groupBy("path", F.session_window(ts, gap).alias("w"))
    return spans.agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max_by("kind", F.struct(F.col(ts), F.col("seq"))).alias("kind")).drop("w")


def batches(events: DataFrame, most: int = 100, order: str = "seq", by: str = "user_id") -> DataFrame:
    """Events in order within each source, cut into batches of ``most``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return events.withColumn("batch", F.floor(n / F.lit(most)))
