"""Sources, the index table, streaming, configuration and the service."""

import io
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding, search
from lodestone.plans import config as C
from lodestone.plans import pipeline, service
from lodestone.sources import files as S
from lodestone.sources import output
from lodestone.sources.index_store import IndexStore, StoreError
from lodestone.streaming import watch as W

EMBED = lambda t: embedding.mock_embedding(t, 8)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/main.rs": b"fn main() { run the parser }", "src/lib.py": "def naïve(): pass\n".encode(), "doc/a b+c.md": b"# Title\nwords here", ".hidden": b"dot", "bin.dat": b"\0" * 100, "wide.txt": "﻿wide text".encode("utf-16-le"), "mark.txt": b"\xef\xbb\xbfmarked", "bad.txt": b"ok \xff bad", "empty.txt": b""}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return root


def test_discovery_and_decoding(spark, tree):
    listing = S.discover(spark, str(tree))
    assert {os.path.relpath(r.path, tree) for r in listing.collect()} >= {"src/main.rs", ".hidden", "doc/a b+c.md"}
    assert listing.where("is_git_tracked").count() == 0 and S.discover(spark, str(tree), 20).where("size_bytes > 20").count() == 0
    got = {os.path.relpath(r.path, tree): r for r in S.read_files(spark, listing).collect()}
    assert len(got) == 9 and "doc/a b+c.md" in got
    assert got["bin.dat"].is_binary and got["bin.dat"].text == "" and got["bin.dat"].encoding == "binary"
    assert got["wide.txt"].text == "wide text" and got["mark.txt"].text == "marked" and got["bad.txt"].text == "ok � bad"
    assert got["src/lib.py"].language == "python" and got["doc/a b+c.md"].line_count == 2 and (got["empty.txt"].text, got["empty.txt"].line_count) == ("", 0)
    with pytest.raises(FileNotFoundError):
        S.discover(spark, str(tree / "none"))


def test_git_discovery(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), *a], check=True, capture_output=True)
    git("init")
    (tree / ".gitignore").write_text("*.dat\n")
    git("add", "src", ".gitignore")
    tracked = S.discover(spark, str(tree))
    assert tracked.count() == 3 and tracked.where("is_git_tracked").count() == 3
    both = {os.path.relpath(r.path, tree) for r in S.discover(spark, str(tree), untracked=True).collect()}
    assert "doc/a b+c.md" in both and "bin.dat" not in both
    rows = spark.createDataFrame([(str(tree / n),) for n in ("bin.dat", "x.rs", "src/main.rs")], "path string")
    assert {os.path.relpath(r.path, tree) for r in S.visible(spark, str(tree), rows).collect()} == {"x.rs", "src/main.rs"}


def test_small_readers(spark, tmp_path):
    good, bad = tmp_path / "m.gguf", tmp_path / "n.gguf"
    good.write_bytes(b"GGUF" + (3).to_bytes(4, "little") + b"\0" * 4)
    bad.write_bytes(b"GGUX" + b"\0" * 8)
    assert S.gguf_version(str(good)) == 3
    with pytest.raises(ValueError):
        S.gguf_version(str(bad))
    (tmp_path / "t.txt").write_text("a\n\n  \nb\nc\n")
    assert sorted(r.text for r in S.sample_texts(spark, 2, str(tmp_path / "t.txt")).collect()) == ["a", "b"]
    assert S.sample_texts(spark, 10).count() == 10
    (tmp_path / "c.json").write_text('{"search": {"limit": 3}}')
    assert S.load_config(str(tmp_path / "none.yml"), str(tmp_path / "c.json")) == {"search": {"limit": 3}} and S.load_config() == {}
    (tmp_path / "c.yml").write_text("search:\n  limit: 4 # four\n  name: 'x'\ntop: true\n")
    assert S._plain_yaml((tmp_path / "c.yml").read_text()) == {"search": {"limit": 4, "name": "x"}, "top": True}
    assert S.directory_sizes(str(tmp_path / "none")) == {}


def test_index_life_cycle(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert not store.exists() and store.validate()
    m = pipeline.build(spark, str(tree), store, embed=EMBED)
    assert store.exists() and store.validate() == [] and m.dimensions == 8 and m.chunks == store.load().count()
    hit = pipeline.ask(store, "fn main() { run the parser }", search.SearchRequest(3), EMBED).collect()
    assert hit[0]["rank"] == 0 and hit[0].similarity == pytest.approx(1, abs=1e-6)
    (tree / "src/main.rs").write_text("changed text")
    os.utime(tree / "src/main.rs", (1e9, 1e9))
    (tree / "new.py").write_text("print(1)")
    (tree / ".hidden").unlink()
    pipeline.update(spark, str(tree), store, embed=EMBED)
    rows = {os.path.relpath(r.file_path, tree): r.content for r in store.load().collect()}
    assert rows["src/main.rs"] == "changed text" and "new.py" in rows and ".hidden" not in rows and "src/lib.py" in rows
    assert len(store.versions()) == 2 and len(store.compact(1)) == 1
    with pytest.raises(StoreError):
        store.load("other-model")
    store.clear()
    assert not store.exists()
    with pytest.raises(C.DiscoveryError):
        (tmp_path / "nothing").mkdir()
        pipeline.build(spark, str(tmp_path / "nothing"), store)


def test_mixed_dimensions_and_format(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "file_path string, embedding array<float>")
    with pytest.raises(StoreError):
        store.save(rows)
    store.save(rows.limit(1))
    p = tmp_path / "i" / "manifest.json"
    (tmp_path / "i" / ".manifest.json.crc").unlink(missing_ok=True)
    p.write_text(p.read_text().replace('"2.0.0"', '"0.9"'))
    with pytest.raises(StoreError):
        store.manifest()


def make(spark, known):
    texts = spark.createDataFrame(sorted(known.items()), "file_path string, content string")

    def f(paths):
        return embedding.embedded(texts.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi"), EMBED)

    return f


def test_stream_applies_events_once(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    start = spark.createDataFrame([("a", "old"), ("b", "bye"), ("keep", "kept")], "file_path string, content string")
    store.save(embedding.embedded(start, EMBED))
    ev = spark.createDataFrame([(0, "Modified", "a", None), (1, "Created", "n", None), (2, "Deleted", "b", None), (3, "Created", "lost", None), (4, "Renamed", "m", "n")], "seq long, kind string, path string, from_path string").withColumn("ts", F.timestamp_seconds(F.col("seq")))
    ev.select("seq", "ts", "kind", "path", "from_path").write.parquet(str(tmp_path / "events"))
    seen = []
    build = make(spark, {"a": "new", "m": "moved"})
    W.watch(W.source(spark, str(tmp_path / "events")), store, build, str(tmp_path / "cp"), seen=seen).awaitTermination(120)
    assert {r.file_path: r.content for r in store.load().collect()} == {"a": "new", "keep": "kept", "m": "moved"}
    assert seen[0] == {"added": 1, "updated": 1, "removed": 1, "failed": 1}
    version = store.manifest().version
    W.apply_batch(store, spark.read.parquet(str(tmp_path / "events")), build, 0)
    assert store.manifest().version == version


def test_stream_debounce_equals_batch(spark, tmp_path):
    from lodestone.operators import events as E

    rows = [(i, "Modified" if i % 2 else "Created", f"p{i % 3}", None, i * 0.21 + (i // 7) * 2) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, kind string, path string, from_path string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).select("seq", "ts", "kind", "path", "from_path")
    last = spark.createDataFrame([(99, "Deleted", "zz", None, 1e6)], "seq long, kind string, path string, from_path string, t double").withColumn("ts", F.timestamp_seconds("t")).select("seq", "ts", "kind", "path", "from_path")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    q = W.debounce(W.source(spark, str(tmp_path / "e"), 1)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "o"))
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).where("path <> 'zz'").select("path", "events", "kind", "first_ts").collect()))
    assert got == sorted(map(tuple, E.debounced(df, "500 milliseconds").select("path", "events", "kind", "first_ts").collect()))
    for bad in ((49, 1), (500, 0)):
        with pytest.raises(ValueError):
            W.check_bounds(*bad)


def test_record_stream_round_trip(spark, tmp_path):
    spark.range(20).selectExpr("id as seq", "timestamp_seconds(id) as ts", "'Created' as kind", "cast(id as string) as path", "cast(null as string) as from_path").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        W.to_parquet(W.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_settings():
    s = C.merged({"limit": 7}, {"search": {"limit": 5, "min_similarity": 0.3}}, {"chunking": {"target_tokens": 200}, "embedding": {"model": "x"}})
    assert (s.limit, s.min_similarity, s.chunk.target, s.model) == (7, 0.3, 200, "x")
    assert C.Settings().validate().limit == 10
    for bad in (C.Settings(limit=0), C.Settings(min_similarity=2), C.merged({"chunking": {"overlap_tokens": 300}})):
        with pytest.raises(C.ConfigError):
            bad.validate()
    assert C.effective_model(None, "", "a", "b") == "a" and C.effective_model() == C.DEFAULT_MODEL
    assert C.model(C.DEFAULT_MODEL).dimensions == 384
    with pytest.raises(C.ConfigError):
        C.check_instruction("minilm", "do")
    assert [C.Retry(4, 0.1).delay(a) for a in range(4)] == [0, 0.1, 0.2, 0.4] and C.Retry(4, 0.1, cap_s=0.25).delay(9) == 0.25
    tries = []
    with pytest.raises(OSError):
        C.RETRIES["network"].run(lambda: tries.append(1) or (_ for _ in ()).throw(OSError("x")), sleep=lambda s: None)
    assert len(tries) == 3


def results(spark):
    return spark.createDataFrame([("/r/src/a.rs", 3, 8, 0.5, "l1\n l2\nl3\nl4", 0), ("/r/Make", 1, 1, 0.25, "[PLACEHOLDER_CONTENT_FROM:/r/Make:1]", 1)], "file_path string, start_line int, end_line int, similarity double, content string, rank bigint")


def test_outputs(spark):
    first = json.loads(output.json_lines(results(spark)).first().value)
    assert list(first) == ["file", "line_start", "line_end", "score", "content", "rank"] and first["score"] == 0.5
    assert output.json_lines(results(spark).limit(0)).count() == 0
    assert output.text_lines(results(spark)).first().value.split("\n") == ["1. /r/src/a.rs:3 (similarity: 50.0%)", "   3│ l1", "   4│ l2", "   5│ l3", "    │ ..."]
    rows = {r.file_path: r for r in output.tool_rows(results(spark), "/r/").collect()}
    assert rows["src/a.rs"].file_type == "rs" and rows["Make"].file_type == "unknown"


def test_service(spark, tree, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    pipeline.build(spark, str(tree), store)
    s = service.Service(store, str(tree), bucket=service.Bucket(6000, 1000))
    send = lambda method, number=1, **params: s.answer(json.dumps({"jsonrpc": "2.0", "id": number, "method": method, "params": params}))
    assert send("tools/list")["error"]["code"] == service.NOT_READY
    assert send("initialize", "u-1")["id"] == "u-1" and send("tools/list")["result"]["tools"][0]["name"] == "semantic_search"
    good = send("tools/call", name="semantic_search", arguments={"query": "words", "limit": 2, "filetype": ".md", "threshold": 0})
    assert "result" in good, good
    good = good["result"]
    assert good["total_results"] == 1 and good["results"][0]["file_path"] == "doc/a b+c.md"
    for args in ({}, {"query": 3}, {"query": " "}, {"query": "x", "limit": 0}, {"query": "x", "limit": 101}, {"query": "x", "threshold": 2}, {"query": "x", "filetype": "rs"}, {"query": "../x"}, {"query": "x", "context_lines": 11}, {"query": "x", "filter": "[a"}, {"query": "y" * 201}):
        assert send("tools/call", name="semantic_search", arguments=args)["error"]["code"] == service.BAD_PARAMS, args
    assert send("tools/call", name="none")["error"]["code"] == service.NO_TOOL and send("none")["error"]["code"] == service.NO_METHOD
    assert s.answer("{")["error"]["code"] == service.PARSE and s.answer("[]")["error"]["code"] == service.INVALID
    assert s.answer(json.dumps({"jsonrpc": "2.0", "method": "tools/list"})) is None
    sink = io.StringIO()
    s.serve(io.StringIO('\n{"jsonrpc":"2.0","id":5,"method":"tools/list"}\n'), sink)
    assert json.loads(sink.getvalue())["id"] == 5
    clock = [0.0]
    b = service.Bucket(60, 2, lambda: clock[0])
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    clock[0] = 1.0
    assert b.take() and not b.take()
    assert service.main(["models"]) == 0
    assert service.benchmark(spark, ["mock"], 5, 2, form="csv").startswith("backend,texts_per_s,ms\nmock,")
    assert json.loads(service.benchmark(spark, ["mock", "placeholder"], 3, 1, form="json"))[1]["backend"] == "placeholder"


def test_command_line_reads_settings(spark, tree, tmp_path, capsys):
    (tree / ".lodestone.yml").write_text("indexing:\n  max_file_size: 1kb\nsearch:\n  limit: 1\n  min_similarity: 1.0\n")
    (tree / "long.md").write_text("words " * 400)
    run = lambda *a: (service.main(list(a)), capsys.readouterr().out)[1]
    assert "long.md" not in run("list", str(tree)) and "long.md" in run("list", str(tree), "--max-filesize", "1mb")
    run("index", str(tree))
    store = IndexStore(spark, str(tree / ".lodestone"))
    assert not [p for p in run("list", str(tree)).splitlines() if "/.lodestone/" in p]
    assert len(run("search", str(tree), "words", "--json").splitlines()) == 1
    assert len(run("search", str(tree), "words", "--json", "--limit", "3").splitlines()) == 3
    before = store.manifest().files
    (tree / "new.md").write_text("something new")
    run("index", str(tree), "--update")
    assert store.manifest().files == before + 1 and not store.load().where("file_path like '%/.lodestone/%'").count()
    (tree / "new.md").unlink()
    service.keep_up(spark, str(tree), store, C.Settings(max_file_bytes=1024), 0, rounds=1)
    assert store.manifest().files == before
    version = store.manifest().version
    service.keep_up(spark, str(tree), store, C.Settings(max_file_bytes=1024), 0, rounds=1)
    assert store.manifest().version == version
    for bad in (["search", str(tree), "words", "--threshold", "2"], ["search", str(tree), "words", "--limit", "0"], ["serve", str(tree), "--config", str(tree / "none.json")], ["list", str(tree), "--max-filesize", "many"]):
        with pytest.raises((C.ConfigError, FileNotFoundError, ValueError)):
            service.main(bad)
