import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestone.llm import queries


@pytest.fixture
def folder(spark, corpus, tmp_path):
    d = str(tmp_path / "sf")
    corpus.drop("toxic").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(corpus.where("doc_id = 7").first().text.split()[:12])), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_copies", "leaks", "mixture"]
    for name, stage in P.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "mixture":
            assert after.columns == docs.columns
        if name == "language":
            assert after.count() == docs.count()
        if name == "near_copies":
            assert after.select("text").distinct().count() == after.count() < docs.count()
            assert after.where("doc_id >= 160").count() == 0
        if name == "leaks":
            assert docs.where("doc_id = 7").count() == 1 and after.where("doc_id = 7").count() == 0 and after.count() == docs.count() - 1
        docs = after
    assert 0 < docs.count() and {"weight", "probability"} < set(docs.columns)


def test_run_is_its_stages(spark, folder):
    a = P.run(spark, folder)
    assert a.count() > 0 and a.select(F.countDistinct("doc_id")).first()[0] == a.count()


def test_stages_on_odd_and_empty_tables(spark, odd, none, folder):
    for name, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0, name
        out = stage(spark, odd, folder)
        assert out.count() <= odd.count() and set(odd.columns) <= set(out.columns), name
    assert {r.doc_id for r in P.language(spark, odd, folder).collect()} <= {4, 5, 6, 8, None}


def test_eleven_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)
