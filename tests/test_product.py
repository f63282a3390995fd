"""Product codes: training against plain loops, codes, and search by lookup tables against decoding and exact search."""

import numpy as np
import pytest

from lodestone.operators import product as P
from lodestone.operators import search


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<float>")


def plain_step(x, book, width):
    out = []
    for s, b in enumerate(book):
        part = x[:, s * width : (s + 1) * width]
        at = [int(np.square(p - np.array(b)).sum(axis=1).argmin()) for p in part]
        out.append([part[[i for i, a in enumerate(at) if a == k]].mean(axis=0).tolist() if k in at else [0.0] * len(b[0]) for k in range(len(b))])
    return out


def test_training_equals_plain_loops(spark):
    x = np.random.default_rng(3).normal(size=(90, 11)).astype(np.float32).astype(float)
    df = table(spark, x)
    book = P.first_codebook(df, "id", width=4, k=8)
    assert [[len(c) for c in b] for b in book] == [[4] * 8, [4] * 8, [3] * 8]
    assert np.allclose(book[1], x[[i * 90 // 8 for i in range(8)], 4:8])
    for _ in range(3):
        again = plain_step(x, book, 4)
        book = P.kmeans_step(df, book, width=4)
        assert all(np.allclose(a, b) for a, b in zip(book, again))
    trained = P.trained(df, "id", width=4, k=8, iterations=3)
    assert all(np.allclose(a, b) for a, b in zip(book, trained))


def test_empty_clusters_ties_and_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "id int, embedding array<float>")
    assert P.kmeans_step(df, [[[0.0, 0.0], [1.0, 1.0], [9.0, 9.0]]], width=2) == [[[0, 0], [1, 1], [0, 0]]]
    assert P.first_codebook(df, "id", width=2) == [[[0, 0], [1, 1]]]
    assert P.first_codebook(df.limit(0), "id") == []
    c = np.array([[1.0, 0], [0, 1.0], [1.0, 0], [0, -1.0]])
    assert P.nearest(np.array([[0.0, 0], [1.0, 0], [0.5, 0.5], [0, -1e9]]), c).tolist() == [0, 0, 0, 3]


def test_codes_and_search(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 384))
    x = centres[r.integers(0, 40, 1500)] + 0.35 * r.normal(size=(1500, 384))
    df = table(spark, x)
    book = P.trained(df, "id", iterations=4)
    coded = P.encoded(df, book)
    assert coded.columns == ["id", "codes"] and {len(v.codes) for v in coded.collect()} == {48}
    asked = df.where("id % 100 = 0").selectExpr("id as q", "embedding as v")
    top = P.search(coded, book, asked, query_id="q", query_vector="v", limit=10, ties=["id"])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("MapInArrow")[1].split("\n")[0]
    got = {(t.q, t["rank"]): (t.id, round(t.similarity, 5)) for t in top.collect()}
    whole = search.search_many(P.decoded(coded, book), asked, query_id="q", query_vector="v", limit=10, ties=["id"])
    same = {(t.q, t["rank"]): (t.id, round(t.similarity, 5)) for t in whole.collect()}
    assert len(got) == 150 and sum(got[k][0] == same[k][0] for k in got) >= 148 and all(abs(got[k][1] - same[k][1]) < 1e-4 for k in got)
    exact = {}
    for t in search.search_many(df, asked, query_id="q", query_vector="v", limit=10, ties=["id"]).collect():
        exact.setdefault(t.q, set()).add(t.id)
    recall = np.mean([len(exact[q] & {i for (p, _), (i, _) in got.items() if p == q}) / 10 for q in exact])
    assert recall >= 0.5
    # the true ten are among the best fifty
    wide = {}
    for t in P.search(coded, book, asked, query_id="q", query_vector="v", limit=50, ties=["id"]).collect():
        wide.setdefault(t.q, set()).add(t.id)
    assert np.mean([len(exact[q] & wide[q]) / 10 for q in exact]) >= 0.9


def test_wrong_shapes(spark):
    df = table(spark, np.ones((4, 8)))
    book = P.first_codebook(df, "id")
    with pytest.raises(Exception, match="isn't of 8 dimensions"):
        P.encoded(table(spark, np.ones((2, 9))), book).collect()
    with pytest.raises(Exception, match="codes aren't of"):
        P.decoded(spark.createDataFrame([(1, bytearray(b"abc"))], "id int, codes binary"), book).collect()
    with pytest.raises(Exception):
        P.decoded(spark.createDataFrame([(1, bytearray(b"\xff"))], "id int, codes binary"), book).collect()
    with pytest.raises(ValueError):
        P.search(P.encoded(df, book), book, spark.createDataFrame([(1, [1.0])], "q int, v array<double>"), query_id="q", query_vector="v")
    null = spark.createDataFrame([(1, bytearray(b"\x00")), (2, bytearray(b"\x01"))], "id int, codes binary")
    assert P.code_lists(null).orderBy("id").collect()[1].codes == [1]


def test_any_number_of_queries_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(300, 20))
    df = table(spark, x)
    book = P.first_codebook(df, "id", k=16)
    coded, asked = P.encoded(df, book), df.where("id % 10 = 0").selectExpr("id as q", "embedding as v")
    options = {"query_id": "q", "query_vector": "v", "limit": 5, "ties": ["id"]}
    got = lambda d: {(t.q, t["rank"]): (t.id, round(t.similarity, 9)) for t in d.collect()}
    whole = got(P.search(coded, book, asked, **options))
    assert len(whole) == 150
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 4)
    assert got(P.search(coded, book, asked, **options)) == whole
    exact = got(search.search_many(df, asked, **options))
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 512)
    assert got(search.search_many(df, asked, **options)) == exact
    monkeypatch.setattr(search, "MOST_QUERIES", 12)
    assert got(P.search_all(coded, book, asked, **options)) == whole
