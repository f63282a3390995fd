"""Registered queries against their SQL on the smallest tables, and op2 and op8's parts against plain restatements."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest

from lodestone.llm import fingerprint as P
from lodestone.llm import near_dedup as N
from lodestone.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_line_dedup", "op8_near_dedup", "op10_decontaminate", "op11_filter_audit"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, rel = Q.QUERIES[name](spark, SF), con.sql(Q.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def plain_exact(text):
    """Eight sums of 64 bits of the paragraphs' digests, one paragraph at a time."""
    sums = [0] * 8
    for line in text.split("\n"):
        if line:
            d = hashlib.blake2b(line.encode()).digest()
            sums = [(s + int.from_bytes(d[8 * i : 8 * i + 8], "little")) % 2**64 for i, s in enumerate(sums)]
    return sums


def test_fingerprints_equal_plain_sums():
    r = random.Random(6)
    words = ["naïve", "Word", "x", "漢字", "end."]
    for _ in range(60):
        lines = [" ".join(r.choice(words) for _ in range(r.randrange(0, 6))) for _ in range(r.randrange(0, 6))]
        text = "\n".join(lines)
        raw = base64.b64decode(P.fingerprint(text))
        assert [int.from_bytes(raw[8 * i : 8 * i + 8], "big") for i in range(8)] == plain_exact(text)
        r.shuffle(lines)
        assert P.fingerprint("\n".join(lines)) == P.fingerprint(text)


def test_likeness_estimates_the_cosine_of_shingle_counts():
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]

    def counts(t):
        out = {}
        for line in t.split("\n"):
            w = line.split()
            for s in zip(w, w[1:]):
                out[s] = out.get(s, 0) + 1
        return out

    off = []
    for _ in range(40):
        a = [r.choice(vocab) for _ in range(400)]
        b = [r.choice(vocab) if r.random() < r.choice([0.05, 0.3, 0.6]) else x for x in a]
        a, b = " ".join(a), " ".join(b)
        x, y = counts(a), counts(b)
        true = sum(v * y.get(k, 0) for k, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        (e1, l1), (e2, l2) = P.decode(P.fingerprint(a)), P.decode(P.fingerprint(b))
        off.append(abs(P.likeness(e1[None], l1[None], e2[None], l2[None])[0] - true))
    assert np.mean(off) < 0.08 and max(off) < 0.3


def test_recall_of_trees_and_sketches_at_the_threshold():
    """Pairs right at 0.8 meet in a leaf, whatever nodes are taken for large, and pass the sketch."""
    r = np.random.default_rng(12)
    kept = tried = 0
    for size in (20, 45, 90, 180, 450, 900):
        both = size * 8 // 10
        for _ in range(150):
            v = r.integers(0, 1 << 62, size, dtype=np.uint64)
            half = (size - both) // 2
            a, b = np.sort(v[: both + half]), np.sort(np.concatenate([v[:both], v[both + half :]]))
            least = np.concatenate([N.minwise(x, np.array([0, len(x)])) for x in (a, b)])
            found = N.marks(least)
            everything = np.full(1024, np.uint64(0xFFFFFFFFFFFFFFFF))
            *_, (row, node) = N._paths(found, [everything] * (N.LEVELS - 1))
            meets = len(np.intersect1d(node[row == 0], node[row == 1])) > 0
            sketch = np.ascontiguousarray(found[:, 4 * N.TREES + N.TOKENS :]).view(np.uint64)
            passes = any(True for _ in N._compared(np.zeros(2, np.int64), np.array([len(a), len(b)]), sketch))
            tried += 1
            kept += meets and passes
    assert kept / tried >= 0.99
