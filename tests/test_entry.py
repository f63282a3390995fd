"""The driver contract: names, columns and the comparison with SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_contract(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "topk_cosine" in q
    assert e.entry(spark).count() == 10


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist() if hasattr(v, "tolist") else v
        return [plain(x) for x in v] if isinstance(v, list) else plain(v) if isinstance(v, float) else v
    return v


def own():
    from lodestone import queries

    return sorted(queries.SQL)


@pytest.mark.parametrize("name", own())
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from lodestone import queries

    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in order] for r in rel.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == expected
