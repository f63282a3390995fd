"""Batches that go out when quiet and when full, state that is dropped, and a restart that repeats nothing."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import collect as K
from lodestone.streaming import watch as W

EVENTS = "seq long, kind string, path string, from_path string, ms long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(K.PROVIDER)
    spark.conf.set(K.PROVIDER, K.ROCKSDB)
    yield spark
    spark.conf.set(K.PROVIDER, before)


def put(spark, path, rows):
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_millis("ms")).select("seq", "ts", "kind", "path", "from_path")
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, most=3):
    q = K.collected(W.source(spark, str(tmp_path / "e"), 1), 500, most, late="0 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    q.awaitTermination(300)
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    return sorted((r.batch, r.reason, r.path, r.action, r.seq) for r in rows)


def test_quiet_full_and_restart(rocks, tmp_path):
    e = str(tmp_path / "e")
    put(rocks, e, [(0, "Created", "a", None, 1000), (1, "Modified", "a", None, 1200), (2, "Modified", "b", None, 1300)])
    put(rocks, e, [(3, "Modified", "x", None, 5000), (4, "Renamed", "z", "y", 5100), (5, "Deleted", "q", None, 5200)])
    first = run(rocks, tmp_path)
    quiet = [(0, "quiet", "a", "modified", 1), (0, "quiet", "b", "modified", 2)]
    full = [(1, "full", "x", "modified", 3), (1, "full", "y", "deleted", 4), (1, "full", "z", "created", 4)]
    # q is still pending: the watermark hasn't passed its quiet time
    assert first == [*quiet, *full]
    assert run(rocks, tmp_path) == first
    put(rocks, e, [(6, "Created", "late", None, 60_000)])
    put(rocks, e, [(7, "Created", "end", None, 120_000)])
    again = run(rocks, tmp_path)
    assert again[: len(first)] == first and (2, "quiet", "q", "deleted", 5) in again and (3, "quiet", "late", "created", 6) in again
    assert len(again) == len({r[2] for r in again}) and "end" not in {r[2] for r in again}


def test_state_is_dropped_by_a_timer(rocks, tmp_path):
    e = str(tmp_path / "e")
    put(rocks, e, [(0, "Created", "a", None, 1000)])
    put(rocks, e, [(1, "Created", "other", None, 50_000)])
    put(rocks, e, [(2, "Created", "a", None, 90_000)])
    got = run(rocks, tmp_path, most=100)
    assert [r[2:] for r in got if r[2] == "a"][:1] == [("a", "created", 0)] and [r[0] for r in got] == list(range(len(got)))


def test_bounds_and_provider(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"), F.lit("Created").alias("kind"), F.lit("p").alias("path"), F.lit(None).cast("string").alias("from_path"))
    with pytest.raises(ValueError, match="RocksDB"):
        K.collected(stream)
    with pytest.raises(ValueError):
        K.collected(stream, 500, 0)
