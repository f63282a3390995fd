"""Whole-relation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_stats(chunks: DataFrame, *, path: str = "file_path", tokens: str = "token_count", vector: str | None = "embedding") -> DataFrame:
    """Chunks, files, tokens, mean tokens (0 of nothing) and dimensions of the first row."""
    dims = F.coalesce(F.first(F.size(vector)), F.lit(0)) if vector else F.lit(0)
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct(path).alias("total_files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg(tokens), F.lit(0.0)).alias("average_tokens"), dims.cast("bigint").alias("dimensions"))


def success_rate(done: Column, failed: Column) -> Column:
    """Percent; 100 of nothing."""
    return F.when(done + failed > 0, 100.0 * done / F.when(done + failed > 0, done + failed)).otherwise(100.0)


def incremental_stats(batches: DataFrame) -> DataFrame:
    """Merged counters of update batches (columns processed, added, updated, removed, chunks_added, chunks_removed, failed)."""
    names = ("processed", "added", "updated", "removed", "chunks_added", "chunks_removed", "failed")
    merged = batches.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return merged.withColumn("success_rate", success_rate(F.col("processed") - F.col("failed"), F.col("failed")))


def indexing_stats(files: DataFrame, most_files: int = 10_000_000, most_chunks: int = 100_000) -> DataFrame:
    """Counters of an indexing run over rows (chunks, failed), clamped."""
    n, bad = F.least(F.count("*"), F.lit(most_files)), F.least(F.count(F.when(F.col("failed"), 1)), F.lit(most_files))
    return files.agg(n.alias("files"), bad.alias("failed"), F.coalesce(F.sum(F.least("chunks", F.lit(most_chunks))), F.lit(0)).alias("chunks")).withColumn("success_rate", success_rate(F.col("files") - F.col("failed"), F.col("failed")))


def parallel_stats(files: DataFrame, *by: str, failed: str = "failed", ms: str = "ms") -> DataFrame:
    """By some columns, or of all: files, failures and the mean milliseconds of a file that didn't fail (0 of none)."""
    bad = F.count_if(F.col(failed))
    return files.groupBy(*by).agg(F.count("*").alias("files"), bad.alias("failed"), (F.count("*") - bad).alias("successful"), F.coalesce(F.avg(F.when(~F.col(failed), F.col(ms))), F.lit(0.0)).alias("average_ms"))


def file_times(rows: DataFrame, path: str, mtime: str) -> DataFrame:
    return rows.groupBy(path).agg(F.max(mtime).alias("mtime"))


def benchmark_means(runs: DataFrame, by: str, *metrics: str) -> DataFrame:
    return runs.groupBy(by).agg(*(F.avg(m).alias(m) for m in metrics))


def resource_summary(samples: DataFrame, value: str) -> DataFrame:
    """Greatest value and the integer mean."""
    return samples.agg(F.max(value).alias("peak"), F.floor(F.avg(value)).alias("mean"))
