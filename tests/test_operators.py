"""Chunking, search, codecs, diffs, events and statistics."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import segment
from lodestone.functions import vector as V
from lodestone.operators import chunking, codec, diff, embedding, events, search, statistics
from lodestone.operators.chunking import ChunkConfig, chunks


def windows(n, c):
    """The defining loop."""
    if n <= c.target:
        return [(0, n)]
    out, start = [], 0
    while True:
        end = min(start + min(c.target, c.most), n)
        if start == 0 or not (n - start < c.least and c.target >= c.least):
            out.append((start, end))
        if end == n:
            return out
        start = end - c.overlap if end >= c.overlap else end


@pytest.mark.parametrize("config", [ChunkConfig(8, 2, 10, 3), ChunkConfig(5, 0, 5, 1), ChunkConfig(6, 3, 6, 6), ChunkConfig(12, 4, 7, 0)])
def test_windows_equal_the_loop(spark, config):
    rows = spark.createDataFrame([(f"f{n}", " ".join(f"w{i}" for i in range(n))) for n in range(45)], "path string, text string")
    got = {}
    for r in chunks(rows, config).orderBy("file_path", "chunk_index").collect():
        words = r.content.split()
        got.setdefault(r.file_path, []).append((int(words[0][1:]), int(words[-1][1:]) + 1))
        assert r.id == f"{r.file_path}:{r.chunk_index}" and r.token_count == len(words)
    for n in range(1, 45):
        assert got[f"f{n}"] == windows(n, config), n
    assert "f0" not in got


def test_chunk_places_and_edges(spark):
    text = "eins zwei\ndrei vier,\nfünf sechs sieben\nacht neun zehn"
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "...\n!!"), ("a2", "kurz")], "path string, text string")
    got = {r.id: r for r in chunks(rows, ChunkConfig(4, 1, 4, 0)).collect()}
    assert set(got) == {"a:0", "a:1", "a:2", "a2:0", "d:0"}
    assert got["a:1"].content == "vier fünf sechs sieben" and text[got["a:1"].start_char : got["a:1"].end_char] == "vier,\nfünf sechs sieben"
    assert (got["a:1"].start_line, got["a:1"].end_line) == (2, 3)
    assert (got["a2:0"].content, got["a2:0"].start_line, got["a2:0"].total_chunks) == ("kurz", 1, 1)
    assert got["d:0"].content == "...\n!!" and got["d:0"].token_count == 0
    with pytest.raises(ValueError):
        ChunkConfig(10, 10).validate()


def vectors(spark, n=60, dims=6, seed=1):
    r = random.Random(seed)
    return [(i, [r.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]


def test_search_against_brute_force(spark):
    rows = vectors(spark) + [(60, [0.0] * 6), (61, [1.0]), (62, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    q = rows[3][1]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a: dot(a, q) / (dot(a, a) * dot(q, q)) ** 0.5 if a and len(a) == 6 and dot(a, a) else 0.0
    expected = sorted(((-round(cos(v), 6), i) for i, v in rows))[:7]
    got = search.search(df, q, search.SearchRequest(limit=7), ties=["id"]).orderBy("rank").collect()
    assert [r.id for r in got] == [i for _, i in expected] and [r.rank for r in got] == list(range(7))
    assert all(a.similarity >= b.similarity for a, b in zip(got, got[1:]))
    assert search.search(df, q, search.SearchRequest(100).with_threshold(0.5), ties=["id"]).count() == sum(cos(v) >= 0.5 for _, v in rows)
    for query, limit in (([], 5), ([float("nan")] * 6, 5), (q, 0)):
        assert search.search(df, query, search.SearchRequest(limit)).count() == 0
    many = search.search_many(df.where("id < 60"), df.where("id in (3, 5)").select(F.col("id").alias("q"), F.col("embedding").alias("v")), query_id="q", query_vector="v", limit=2, ties=["id"])
    assert {r.q: r.id for r in many.where("rank = 0").collect()} == {3: 3, 5: 5} and many.count() == 4


def test_search_plan_has_no_shuffle_of_rows(spark):
    df = spark.createDataFrame(vectors(spark), "id int, embedding array<float>")
    top = search.search(df, [1.0] * 6, search.SearchRequest(3), ties=["id"])
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_requests():
    assert search.SearchRequest().with_threshold(-0.5).threshold == 0 and search.SearchRequest().with_threshold(1.5).threshold == 1
    for bad in (search.SearchRequest(0), search.SearchRequest(threshold=2), search.SearchRequest(filetype="r s"), search.SearchRequest(glob="[x")):
        with pytest.raises(ValueError):
            bad.validate()
    for bad in ("", "  ", "x" * 1001):
        with pytest.raises(ValueError):
            search.validate_query(bad)


def test_rehydrate_and_filters(spark):
    files = spark.createDataFrame([("a.rs", "hello world"), ("b.py", "bye")], "file_path string, text string")
    hits = spark.createDataFrame([("a.rs", 6, 11, "x", 0), ("gone.rs", 0, 2, "kept", 1), ("b.py", 0, 99, "y", 2)], "file_path string, start_char int, end_char int, content string, rank int")
    assert {r.file_path: r.content for r in search.rehydrated(hits, files).collect()} == {"a.rs": "world", "gone.rs": "kept", "b.py": "bye"}
    assert [r["rank"] for r in search.filter_results(hits, path="file_path", glob="*.rs", ext="RS").orderBy("rank").collect()] == [0, 1]


def test_embedders(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(embedding.mock_embedding(F.lit("ab"), 3)) == pytest.approx([0.1 + ((195 + i) % 100) / 1000 for i in range(3)])
    assert one(embedding.mock_embedding(F.lit(""), 3)) == [0, 0, 0]
    assert one(embedding.placeholder_embedding(F.lit("é" * 3), 2)) == pytest.approx([0.106] * 2)
    assert one(embedding.placeholder_embedding(F.lit("x" * 1025), 2)) is None
    assert one(embedding.embed_single(F.lit(""), embedding.placeholder_embedding, 4)) == [0] * 4
    assert one(embedding.embed_with_options(F.lit("abcdef"), lambda t: t, 3, "go", "Qwen/Qwen3-Embedding-0.6B")) == "Instruct: go\nQuery: abc"
    assert [one(embedding.embed_with_options(F.lit("aé漢🙂"), lambda t: t, n, "go", "MiniLM")) for n in (1, 2, 3, 5, 6, 9, 10)] == ["a", "a", "aé", "aé", "aé漢", "aé漢", "aé漢🙂"]
    assert [one(embedding.placeholder_error(F.lit(t))) for t in ("", "x", "x" * 1025)] == ["the text is empty", None, "the text has 1025 bytes, more than 1024"]
    with pytest.raises(KeyError):
        embedding.EMBEDDERS.get("none")
    df = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "content string")
    model = embedding.model_udf(lambda: lambda texts: [[float(len(t or ""))] for t in texts])
    assert sorted(r.embedding[0] for r in embedding.embedded_once(df, model).collect()) == [0, 1, 1, 2]
    assert [embedding.batch_size(a, 32, m) for a, m in ((2000, 16), (50, 8), (500, 4), (500, None))] == [32, 96, 24, 32]


def test_codecs(spark):
    rows = vectors(spark, 40, 16)
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    back = codec.scalar_decoded(codec.scalar_encoded(df)).collect()
    assert max(abs(x - y) for r in back for x, y in zip(r.embedding, r.decoded)) < 2 / 255
    for name, off in (("none", 1e-7), ("scalar", 2 / 255), ("learned", 2 / 255), ("product", 2)):
        coded, about = codec.encoded(df.unionByName(spark.createDataFrame([], df.schema)), name, "id", k=16)
        assert coded.columns == ["id", "codes"] and {r.id: len(r.codes) for r in coded.collect()}[3] == {"none": 64, "product": 2}.get(name, 16)
        held = {r.id: r.embedding for r in codec.decoded(coded, about).collect()}
        assert len(held) == 40 and max(abs(x - y) for i, v in rows for x, y in zip(v, held[i])) < off
    odd = spark.createDataFrame([(0, None), (1, []), (2, [1.5, -2.0])], "id int, embedding array<float>")
    coded, about = codec.encoded(odd, "none", "id")
    assert {r.id: r.embedding for r in codec.decoded(coded, about).collect()} == {0: None, 1: [], 2: [1.5, -2.0]}
    r = codec.value_range(df.limit(0)).first()
    assert (r.low, r.high) == (float("inf"), float("-inf"))
    with pytest.raises(ValueError):
        codec.encoded(df, "zip", "id")


def test_diffs(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("e", None)], "path string, mtime int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("d", 9), ("e", 1)], "path string, mtime int")
    paths = lambda d: sorted(r.path for r in d.collect())
    assert paths(diff.removed(old, new)) == ["a"] and paths(diff.added(old, new)) == ["d"] and paths(diff.changed(old, new)) == ["c", "e"]
    kept = diff.retained(old.withColumnRenamed("path", "file_path"), diff.removed(old, new), diff.changed(old, new))
    assert [r.file_path for r in kept.collect()] == ["b"]
    r = diff.update_result(old, new, 10, 15).first()
    assert (r.added, r.updated, r.removed, r.delta, r.has_changes) == (1, 2, 1, 5, True)


def test_events(spark):
    e = spark.createDataFrame([(0, "Created", "a", None), (1, "Modified", "a", None), (2, "Renamed", "c", "b"), (3, "DirectoryDeleted", "d", None)], "seq int, kind string, path string, from_path string")
    assert {r.action: r.events for r in events.by_kind(e).collect()} == {"modified": 1, "created": 2, "deleted": 2}
    assert {r.path: r.kind for r in events.last_wins(e).collect()} == {"a": "Modified", "c": "Renamed", "d": "DirectoryDeleted"}
    assert [r.batch for r in events.batches(e.withColumn("user_id", F.lit(1)), 2).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_statistics(spark):
    rows = spark.createDataFrame([("a", 2, [1.0, 2.0, 3.0]), ("b", 4, [1.0, 2.0, 3.0])], "file_path string, token_count int, embedding array<float>")
    r = statistics.index_stats(rows).first()
    assert (r.total_chunks, r.total_files, r.total_tokens, r.average_tokens, r.dimensions) == (2, 2, 6, 3.0, 3)
    r = statistics.index_stats(rows.limit(0)).first()
    assert (r.total_chunks, r.total_tokens, r.average_tokens) == (0, 0, 0.0)
    b = spark.createDataFrame([(10, 1, 2, 3, 4, 5, 2)], "processed int, added int, updated int, removed int, chunks_added int, chunks_removed int, failed int")
    assert statistics.incremental_stats(b).first().success_rate == 80
    assert statistics.incremental_stats(b.limit(0)).first().success_rate == 100
    runs = spark.createDataFrame([("m", 40, 25, 2, 100, 70), ("m", 60, 15, 3, 120, 80)], "model string, a int, b int, c int, d int, e int")
    assert list(statistics.benchmark_means(runs, "model", *"abcde").first())[1:] == [50, 20, 2.5, 110, 75]


def test_literal_prefixes_and_columns_reach_the_scan(spark, tmp_path):
    from lodestone.functions import glob as G

    rows = spark.createDataFrame([("src/a.rs", [1.0, 2.0], "text"), ("doc/b.md", [2.0, 1.0], "text")], "file_path string, embedding array<float>, content string")
    rows.write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    plan = search.search(index.select("file_path", "embedding"), [1.0, 1.0], search.SearchRequest(glob="src/*.rs"), path="file_path", ties=["file_path"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(file_path,src/)" in plan and "content" not in plan and "Exchange" not in plan.split("TakeOrderedAndProject")[-1]
    assert index.where(G.matches(F.col("file_path"), "src/*.rs")).count() == 1


def test_shared_queries_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, v array<float>")
    monkeypatch.setattr(search, "MOST_QUERIES", 1)
    with pytest.raises(ValueError):
        search.search_many(df, df.select(F.col("id").alias("q"), F.col("v").alias("w")), query_id="q", query_vector="w", vector="v")


def test_any_number_of_queries(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1]) for i in range(40)], "id int, v array<float>")
    asked = df.select(F.col("id").alias("q"), F.col("v").alias("w"))
    found = lambda f: sorted((r.q, r.id, r.rank) for r in f(df, asked, query_id="q", query_vector="w", vector="v", limit=3, ties=["id"]).collect())
    whole = found(search.search_many)
    monkeypatch.setattr(search, "MOST_QUERIES", 12)
    assert found(search.search_all) == whole and len(whole) == 120


def test_norms_agree(spark):
    df = spark.createDataFrame(vectors(spark), "id int, embedding array<float>").withColumn("norm", V.norm(F.col("embedding")))
    a = search.search(df, [0.3] * 6, search.SearchRequest(5), ties=["id"], norm="norm").select("id", F.round("similarity", 9)).collect()
    assert a == search.search(df.drop("norm"), [0.3] * 6, search.SearchRequest(5), ties=["id"]).select("id", F.round("similarity", 9)).collect()


def test_code_points_are_summed_in_bounded_memory(spark):
    texts = ["", None, "aé漢🙂", "x" * 700_001 + "🙂", "é漢" * 300_000, None, "end"]
    whole = pa.array(texts * 3)
    plain = [sum(map(ord, t or "")) for t in texts]
    for part, want in ((whole, plain * 3), (whole.slice(2, 6), (plain * 3)[2:8]), (whole.cast(pa.large_string()), plain * 3), (pa.array([None], pa.string()), [0]), (pa.array([], pa.string()), [])):
        assert embedding.code_points(part).tolist() == want
    many = pa.array([f"text {i} " * 40 for i in range(60_000)])
    tracemalloc.start()
    embedding.code_points(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many.nbytes > 25e6 and peak < many.nbytes / 2
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in rows.select("i", embedding.code_point_sum(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else n for i, (t, n) in enumerate(zip(texts, plain))}


def test_chunks_hold_little_of_a_batch(spark):
    texts = [f"word{i} " * 400 for i in range(6000)]
    batch = pa.RecordBatch.from_pydict({"file_path": [f"p{i}" for i in range(6000)], "body": texts})
    cut = chunking.cutter(segment.ranges(), ChunkConfig(40, 10, 60, 20), False)
    tracemalloc.start()
    rows, most = 0, 0
    for out in cut(iter([batch])):
        rows, most = rows + out.num_rows, max(most, out.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    c = ChunkConfig(40, 10, 60, 20)
    assert rows == 6000 * len(windows(400, c)) and peak < batch.nbytes and most < 4e6
    chunks(spark.createDataFrame([("a", "one")], "path string, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
