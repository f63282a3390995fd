"""The index as parts merged on read: against a dictionary, after kills and damage, and by the files it writes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.plans import pipeline
from lodestone.plans.config import Settings
from lodestone.operators.chunking import ChunkConfig
from lodestone.sources import files as S
from lodestone.sources.index_store import IndexStore, StoreError

ROWS = "file_path string, chunk_index bigint, content string, embedding array<float>"


def rows(spark, held):
    return spark.createDataFrame([(p, k, f"{p} {v} {k}", [float(v), 1.0]) for p, v in held.items() for k in range(v % 3 + 1)], ROWS)


def times(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string").withColumn("mtime", F.timestamp_seconds(F.lit(7)))


def gone(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def content(store):
    return sorted(r.content for r in store.load().select("content").collect())


def expected(held):
    return sorted(f"{p} {v} {k}" for p, v in held.items() for k in range(v % 3 + 1))


def files_below(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_many_updates_equal_a_dictionary(spark, tmp_path):
    r = random.Random(2)
    store = IndexStore(spark, str(tmp_path / "i"), buckets=4)
    held = {f"p{i}": i for i in range(30)}
    m = store.save(rows(spark, held))
    assert (m.chunks, m.files, len(m.parts)) == (len(expected(held)), 30, 1)
    for step in range(4):
        new = {f"p{r.randrange(45)}": r.randrange(100) for _ in range(r.randrange(1, 6))}
        out = [p for p in r.sample(sorted(held), 3) if p not in new]
        m, counts = store.upsert(rows(spark, new), times(spark, new), gone(spark, out))
        assert counts == {"added": len(set(new) - set(held)), "updated": len(set(new) & set(held)), "removed": len(out), "failed": 0}
        held = {p: v for p, v in (held | new).items() if p not in out}
        assert content(store) == expected(held) and (m.chunks, m.files) == (len(expected(held)), len(held))
        sizes = [p.size for p in m.parts]
        assert all(a >= store.ratio * sum(sizes[i + 1 :]) for i, a in enumerate(sizes[:-1]))
        assert sorted(x.path for x in store.times().collect()) == sorted(held)
    assert store.validate(deep=True) == []
    before = store.manifest()
    assert len(store.optimize().parts) == 1 and content(store) == expected(held)
    assert sorted(x.content for x in store.load(version=before.version).collect()) == expected(held)
    assert sorted(x.content for x in store.load(paths=["p1", "p2", "nowhere"]).collect()) == expected({p: held[p] for p in ("p1", "p2") if p in held})


def test_deleting_everything_and_starting_again(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    store.save(rows(spark, {"a": 1, "b": 2}))
    m, _ = store.upsert(None, times(spark, []), gone(spark, ["a", "b"]))
    assert (m.chunks, m.files) == (0, 0) and store.load().count() == 0 and store.times().count() == 0
    store.upsert(rows(spark, {"a": 4}), times(spark, ["a"]))
    assert content(store) == expected({"a": 4})
    _, counts = store.upsert(rows(spark, {"a": 5, "b": 1}), times(spark, ["b"]), merge=False)
    assert content(store) == expected({"a": 5, "b": 1}) and (counts["added"], counts["updated"]) == (1, 1)


def test_ten_paths_of_ten_thousand_write_few_files(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=16)
    held = {f"src/p{i}.py": 3 for i in range(10_000)}
    store.save(rows(spark, held))
    before = files_below(tmp_path)
    new = {f"src/p{i}.py": 4 for i in range(0, 9_000, 1_000)} | {"src/new.py": 1}
    m, counts = store.upsert(rows(spark, new), times(spark, new), gone(spark, ["src/p5.py"]))
    written = files_below(tmp_path) - before
    assert before <= files_below(tmp_path) and len(written) <= 2 * 11 + 4 and counts == {"added": 1, "updated": 9, "removed": 1, "failed": 0}
    assert sum(os.path.getsize(f) for f in written) < sum(os.path.getsize(f) for f in before) / 4
    held = {p: v for p, v in (held | new).items() if p != "src/p5.py"}
    full = IndexStore(spark, str(tmp_path / "full"))
    full.save(rows(spark, held))
    assert content(store) == content(full) and store.manifest().chunks == full.manifest().chunks
    plan = store.load(paths=["src/p7.py"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan and "PartitionFilters" in plan
    assert len(m.parts) == 2


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=4)
    held = {"a": 1, "b": 2, "c": 3}
    store.save(rows(spark, held))
    whole = store._commit

    def die(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_commit", die)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows(spark, {"a": 9}), times(spark, ["a"]))
    monkeypatch.setattr(store, "_commit", whole)
    assert content(store) == expected(held) and store.validate(deep=True) == []
    assert store.sweep() == [] and len(store.sweep(grace=-5)) == 1
    # after the commit's record, before the pointer
    write = store._write_text
    monkeypatch.setattr(store, "_write_text", lambda name, text: die() if name == "manifest.json" else write(name, text))
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows(spark, {"b": 9}), times(spark, ["b"]))
    monkeypatch.setattr(store, "_write_text", write)
    assert content(store) == expected(held)
    store.upsert(rows(spark, {"b": 5}), times(spark, ["b"]))
    assert content(store) == expected(held | {"b": 5}) and store.validate(deep=True) == []


def test_two_writers(spark, tmp_path, monkeypatch):
    one, two = IndexStore(spark, str(tmp_path / "i")), IndexStore(spark, str(tmp_path / "i"))
    one.save(rows(spark, {"a": 1}))
    write = two._write

    def slow(*a, **k):
        part = write(*a, **k)
        one.upsert(rows(spark, {"b": 1}), times(spark, ["b"]))
        return part

    monkeypatch.setattr(two, "_write", slow)
    with pytest.raises(StoreError, match="another writer"):
        two.upsert(rows(spark, {"c": 1}), times(spark, ["c"]), merge=False)
    assert content(one) == expected({"a": 1, "b": 1})


@pytest.mark.parametrize("lost", [False, True])
def test_recovery_from_a_damaged_file(spark, tmp_path, lost):
    store = IndexStore(spark, str(tmp_path / "i"), buckets=2)
    held = {f"p{i}": i for i in range(40)}
    store.save(rows(spark, held))
    store.upsert(rows(spark, {"p1": 77}), times(spark, ["p1"]), merge=False)
    last = store.manifest()
    victim = next(f for f in sorted(files_below(tmp_path / "i" / "parts" / last.parts[-1].name / "chunks")))
    data = bytearray(open(victim, "rb").read())
    os.unlink(victim)
    if not lost:
        data[len(data) // 2] ^= 0xFF
        open(victim, "wb").write(data)
        crc = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc")
        if os.path.exists(crc):
            os.unlink(crc)
    assert store.damaged(last.parts[0].name) == [] and len(store.damaged(last.parts[-1].name)) == 1
    assert store.validate(deep=True) != []
    m = store.recover()
    assert m.number > last.number and content(store) == expected(held) and store.validate(deep=True) == []
    store.upsert(rows(spark, {"p1": 78}), times(spark, ["p1"]))
    assert content(store) == expected(held | {"p1": 78})


def test_nothing_sound_is_left(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "i"))
    store.save(rows(spark, {"a": 1}))
    with pytest.raises(StoreError, match="no sound version"):
        store.rollback()


def test_bad_files_dont_end_a_build(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "good.py").write_text("print(1)")
    (tree / "late.py").write_text("print(2)")
    (tree / "empty.py").write_text("")
    listed = S.discover

    def and_missing(spark, root, *a, **k):
        return listed(spark, root, *a, **k).unionByName(spark.createDataFrame([(f"{root}/gone.py", 3), (f"{root}", 4)], "path string, size_bytes bigint").withColumns({"last_modified": F.timestamp_seconds(F.lit(1)), "is_git_tracked": F.lit(False)}))

    def embed(text):
        return F.when(~text.contains("2"), F.array(F.lit(1.0), F.lit(2.0)))

    monkeypatch.setattr(S, "discover", and_missing)
    store = IndexStore(spark, str(tmp_path / "i"))
    m = pipeline.build(spark, str(tree), store, Settings(chunk=ChunkConfig(20, 5, 30, 3)), embed=embed)
    bad = {os.path.basename(r.path): r.error for r in store.rejects().collect()}
    assert bad == {"gone.py": "read: No such file or directory", "tree": "read: Is a directory", "late.py": "embed: no vector"}
    assert m.files == 2 and {os.path.basename(r.file_path) for r in store.load().collect()} == {"good.py"}
    assert pipeline.same_settings(m, Settings()).chunk == ChunkConfig(20, 5, 30, 3)
    (tree / "late.py").write_text("print(3)")
    os.utime(tree / "late.py", (1e9, 1e9))
    m = pipeline.update(spark, str(tree), store, embed=embed)
    assert m.files == 3 and "late.py" not in {os.path.basename(r.path) for r in store.rejects().collect()} and len(m.parts) <= 2
