"""Differences of two file listings by equi and anti joins on the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removed(indexed: DataFrame, current: DataFrame) -> DataFrame:
    return indexed.select("path").distinct().join(current, "path", "left_anti")


def added(indexed: DataFrame, current: DataFrame) -> DataFrame:
    return current.join(indexed, "path", "left_anti").select("path")


def changed(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """In both, and the stored time is missing or differs, earlier or later, in microseconds."""
    old = indexed.select("path", F.col("mtime").alias("stored"))
    return current.join(old, "path").where(F.col("stored").isNull() | (F.col("mtime") != F.col("stored"))).select("path")


def retained(chunks: DataFrame, *gone: DataFrame, path: str = "file_path") -> DataFrame:
    """Chunks of files in none of the listings given."""
    out = chunks
    for g in gone:
        out = out.join(g.select(F.col("path").alias(path)), path, "left_anti")
    return out


def update_result(indexed: DataFrame, current: DataFrame, before: int, after: int) -> DataFrame:
    """One row: added, updated, removed, chunks before and after, delta, has_changes."""
    kinds = [d.select(F.lit(k).alias("k")) for k, d in (("a", added(indexed, current)), ("u", changed(indexed, current)), ("r", removed(indexed, current)))]
    n = lambda k: F.count(F.when(F.col("k") == k, 1))
    r = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).agg(n("a").alias("added"), n("u").alias("updated"), n("r").alias("removed"))
    return r.withColumns({"before": F.lit(before).cast("bigint"), "after": F.lit(after).cast("bigint"), "delta": F.lit(after - before).cast("bigint"), "has_changes": (F.col("added") + F.col("updated") + F.col("removed")) > 0})


def united(*listings: DataFrame) -> DataFrame:
    """Every path of the listings once."""
    out = listings[0].select("path")
    for x in listings[1:]:
        out = out.unionByName(x.select("path"))
    return out.distinct()
