"""Folder events, paths that git ignores, batches that fail, and what an update writes, on a real tree."""

import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding
from lodestone.plans import pipeline
from lodestone.plans.config import Settings
from lodestone.sources import files as S
from lodestone.sources.index_store import IndexStore
from lodestone.streaming import watch as W

EVENTS = "seq long, kind string, path string, from_path string"


def EMBED(c):
    return embedding.mock_embedding(c, 8)


def maker(spark):
    def make(paths):
        return pipeline.read(spark, paths, Settings(), EMBED)[:2]

    return make


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS).withColumn("ts", F.timestamp_seconds("seq")).select("seq", "ts", "kind", "path", "from_path")


def held(store, root):
    return {os.path.relpath(r.file_path, root): r.content for r in store.load().collect()}


def test_folder_events_and_ignored_paths(spark, tmp_path):
    root = tmp_path / "t"
    (root / "old").mkdir(parents=True)
    for name in ("a.py", "old/x.py", "old/y.py", "oldish.py"):
        (root / name).write_text(f"text of {name}")
    (root / ".gitignore").write_text("*.tmp\nskip/\n")
    subprocess.run(["git", "-C", str(root), "init", "-q"], check=True)
    subprocess.run(["git", "-C", str(root), "add", "a.py", "old", "oldish.py"], check=True, capture_output=True)
    store = IndexStore(spark, str(tmp_path / "i"), buckets=4)
    pipeline.build(spark, str(root), store, embed=EMBED)
    assert set(held(store, root)) == {"a.py", "old/x.py", "old/y.py", "oldish.py"}
    (root / "new/deep").mkdir(parents=True)
    (root / "skip").mkdir()
    for name in ("new/n.py", "new/deep/m.py", "new/z.tmp", "skip/s.py"):
        (root / name).write_text(f"text of {name}")
    (root / "a.py").write_text("changed")
    (root / "new/bin").write_bytes(b"\0" * 50)
    rows = [(1, "DirectoryCreated", f"{root}/new", None), (2, "DirectoryDeleted", f"{root}/old", None), (3, "Modified", f"{root}/a.py", None), (4, "Created", f"{root}/skip/s.py", None), (5, "Created", f"{root}/gone.py", None), (6, "Deleted", f"{root}/never.py", None)]
    counts = W.apply_batch(store, events(spark, rows), maker(spark), 0, lambda paths: S.visible(spark, str(root), paths))
    assert held(store, root) == {n: f"text of {n}" for n in ("oldish.py", "new/n.py", "new/deep/m.py")} | {"a.py": "changed"}
    assert counts == {"added": 2, "updated": 1, "removed": 2, "failed": 2}
    assert {os.path.relpath(r.path, root): r.error for r in store.rejects().collect()} == {"gone.py": "read: No such file or directory", "new/bin": "no chunks"}
    assert len(store.manifest().parts) <= 2 and store.validate(deep=True) == []


def test_a_batch_that_fails_is_tried_again(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=2)
    start = spark.createDataFrame([("a", "old")], "file_path string, content string")
    store.save(embedding.embedded(start, EMBED))
    events(spark, [(0, "Modified", "a", None)]).write.parquet(str(tmp_path / "e"))
    left, slept = [3], []

    def make(paths):
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("no")
        return embedding.embedded(paths.select(F.col("path").alias("file_path"), F.lit("new").alias("content")), EMBED)

    seen, figures = [], W.Figures()
    spark.streams.addListener(figures)
    q = W.watch(W.source(spark, str(tmp_path / "e")), store, make, str(tmp_path / "c"), seen=seen, sleep=slept.append)
    q.awaitTermination(120)
    for _ in range(100):
        if not figures.of.get(str(q.id), {"running": True})["running"]:
            break
        time.sleep(0.1)
    spark.streams.removeListener(figures)
    got = figures.of[str(q.id)]
    # the one event was read by each of four tries
    assert (got["batches"], got["rows"], got["error"]) == (1, 4, None) and got["ms"] > 0 and got["events"]["all"] >= 1 and got["events"]["modified"] >= 1
    assert seen == [{"added": 0, "updated": 1, "removed": 0, "failed": 0}] and slept == [1.0]
    left[0], slept[:] = 1000, []
    events(spark, [(1, "Modified", "a", None)]).write.mode("append").parquet(str(tmp_path / "e"))
    with pytest.raises(Exception, match="no"):
        W.watch(W.source(spark, str(tmp_path / "e")), store, make, str(tmp_path / "c"), seen=seen, sleep=slept.append).awaitTermination(120)
    assert left[0] == 1000 - W.STOP_AFTER and slept == [min(W.MOST_PAUSE, 2.0**k) for k in range(W.STOP_AFTER - W.PAUSE_FROM)] and len(seen) == 1
    left[0] = 0
    W.watch(W.source(spark, str(tmp_path / "e")), store, make, str(tmp_path / "c"), seen=seen).awaitTermination(120)
    assert len(seen) == 2


def test_figures_of_a_run_and_the_cache(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "big.py").write_text("\n".join(f"word{i} again and so on" for i in range(200)))
    (root / "b.bin").write_bytes(b"\0" * 100)
    made = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def embed(texts):
        made.add(len(texts))
        return texts.map(lambda t: [float(len(t)), 1.0])

    store = IndexStore(spark, str(tmp_path / "i"))
    m = pipeline.build(spark, str(root), store, embed=embed)
    assert {k: m.stats[k] for k in ("files", "failed", "binary", "bytes")} == {"files": 2, "failed": 0, "binary": 1, "bytes": (root / "big.py").stat().st_size + 100}
    assert m.stats["chunks"] == m.chunks and m.stats["tokens"] >= 1000 and m.stats["read_seconds"] > 0 and m.stats["write_seconds"] > 0
    assert made.value == m.chunks == store.load().count() and m.chunks > 2
    text = (root / "big.py").read_text()
    (root / "big.py").write_text(text[: text.rindex("again")] + "changed at the end")
    os.utime(root / "big.py", (1e9, 1e9))
    before = made.value
    m = pipeline.update(spark, str(root), store, embed=embed)
    assert 1 <= made.value - before <= 2 and m.stats["files"] == 1 and m.stats["updated"] == 1
    hits = store.load().where("chunk_index = 0").withColumns({"similarity": F.lit(1.0), "rank": F.lit(0)})
    (root / "big.py").write_text("short now")
    assert [r.content for r in pipeline.fresh_content(hits.drop("embedding", "norm")).collect()] == ["short now"]
