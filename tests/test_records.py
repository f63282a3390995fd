"""Record files: round trips in batches and streams, splits, cuts, damage and wrong magic; the vector cache."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import records as R
from lodestone.sources.vector_cache import VectorCache


@pytest.fixture
def saved(spark, tmp_path):
    R.register(spark)
    df = spark.range(5000).select("id", F.repeat(F.lit("naïve "), (F.col("id") % 7).cast("int")).alias("text"), F.array(F.col("id").cast("float"), F.lit(None).cast("float")).alias("v"), F.when(F.col("id") % 3 > 0, F.struct(F.col("id").alias("k"))).alias("s"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    df.repartition(3).write.format("records").mode("append").save(str(tmp_path / "r"))
    yield df, tmp_path / "r"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def files(path):
    return sorted(path.glob("*.records"))


@pytest.mark.parametrize("split", [20_000, R.SPLIT_BYTES])
def test_round_trip_at_any_split(spark, saved, split):
    df, path = saved
    got = spark.read.format("records").option("split", split).load(str(path))
    assert got.schema.simpleString() == df.schema.simpleString()
    assert got.rdd.getNumPartitions() >= (3 if split > 20_000 else 9)
    assert sorted(map(tuple, got.select("id", "text").collect())) == sorted(map(tuple, df.select("id", "text").collect()))
    assert got.where("s is null").count() == df.where("s is null").count() and got.agg(F.sum(F.get("v", F.lit(0)))).first()[0] == sum(range(5000))


def test_every_block_is_read_once_by_plain_ranges(saved):
    _, path = saved
    for p in files(path):
        size = os.path.getsize(p)
        whole = [b.num_rows for b in R.blocks(str(p), 0, size)]
        for step in (333, 5000):
            assert sum(b.num_rows for a in range(0, size, step) for b in R.blocks(str(p), a, min(a + step, size))) == sum(whole)


def test_append_and_overwrite(spark, saved):
    df, path = saved
    df.limit(10).write.format("records").mode("append").save(str(path))
    assert spark.read.format("records").load(str(path)).count() == 5010
    df.limit(7).write.format("records").mode("overwrite").save(str(path))
    assert spark.read.format("records").load(str(path)).count() == 7 and not list(path.glob(".*.records"))


def test_cut_damaged_and_foreign_files(spark, saved):
    _, path = saved
    p = files(path)[0]
    data = p.read_bytes()
    read = lambda: spark.read.format("records").load(str(path)).count()
    for bad, says in ((data[:-5], "cut short"), (data[:20], "header is cut short"), (b"PNG" + data, "isn't a record file"), (data[:8] + b"\x07" + data[9:], "version 7"), (data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 255]) + data[len(data) // 2 + 1 :], "damaged|cut short|cannot find|mark")):
        p.write_bytes(bad)
        with pytest.raises(Exception, match=says):
            read()
    p.write_bytes(data)
    assert read() == 5000
    with pytest.raises(Exception, match="no record files"):
        spark.read.format("records").load(str(path / "none")).count()


def test_a_failing_task_leaves_nothing(spark, saved):
    df, path = saved
    before = files(path)
    bad = df.withColumn("id", F.when(F.col("id") == 4321, F.raise_error(F.lit("bad row")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="bad row"):
        bad.write.format("records").mode("append").save(str(path))
    R.sweep(str(path), grace=-5)
    assert files(path) == before and spark.read.format("records").load(str(path)).count() == 5000


def test_stream_commits_once(spark, saved, tmp_path):
    df, _ = saved
    for k in range(3):
        df.where(f"id % 3 = {k}").select("id", "text").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema("id bigint, text string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("records").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.format("records").load(str(tmp_path / "out")).count() == df.where(f"id % 3 <= {k}").count()
    w = R.StreamWriter(str(tmp_path / "out"), df.select("id", "text").schema)
    again = [w.write(iter(df.select("id", "text").limit(4).toArrow().to_batches()))]
    w.commit(again, 2)
    w.commit([w.write(iter(df.select("id", "text").limit(4).toArrow().to_batches()))], 2)
    assert spark.read.format("records").load(str(tmp_path / "out")).count() == df.where("id % 3 <= 1").count() + 4


def test_an_edited_file_embeds_only_what_is_new(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(texts):
        made.add(len(texts))
        return texts.map(lambda t: None if t == "bad" else [float(len(t))])

    cache = VectorCache(spark, str(tmp_path), "org/some-model.v1")
    rows = lambda *texts: spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "n int, content string, text_digest int")
    got = lambda df: [None if r.embedding is None else r.embedding[0] for r in df.orderBy("n").collect()]
    out = cache.embedded(rows("a", "bb", "a", None, "", "bad"), embed)
    assert got(out) == [1, 2, 1, None, 0, None] and made.value == 4 and "text_digest" in out.columns and cache.size() == 3
    assert got(cache.embedded(rows("bb", "ccc", "a"), embed)) == [2, 3, 1] and made.value == 5
    assert got(cache.embedded(rows("ccc"), embed)) == [3] and made.value == 5
    assert VectorCache(spark, str(tmp_path), "other").size() == 0
    cache.compact()
    assert cache.size() == 4 and len(cache._parts()) == 1 and got(cache.embedded(rows("a"), embed)) == [1] and made.value == 5
    cache.clear()
    assert cache.size() == 0
