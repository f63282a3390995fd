"""Spelling groups against a comparison of every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, ratio=10):
    out = {}
    for w in n:
        m = [x for x in n if near(w, x)]
        best = min(m, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best is not None and n[best] >= ratio * n[w] else None, n[w], len(m))
    roots = {}
    for w in out:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        roots[w] = r
    return {w: (f, roots[w], k, c, n[f] if f else None) for w, (f, k, c) in out.items()}


def counted(rows, wear=True):
    n = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = "".join(UPPER.get(c, c) for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if wear and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def group(spark, n, **k):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint"), **k).collect()}


def test_query_parts_equal_pairwise_comparison(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcÉéßŒ") for _ in range(r.randrange(6, 10))) for _ in range(40)]

    def edited(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abcé") + w[i:], w[:i] + r.choice("abc") + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], w.upper()])

    rows = []
    for i in range(60):
        words = [r.choice(base[: r.choice([5, 40])]) for _ in range(60)]
        rows.append((i, "".join((edited(w) if r.random() < 0.3 else w) + r.choice([" ", "-", "1", "\n", "×"]) for w in words)))
    rows += [(None, " ".join(base)), (None, None), (7, ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*x, "h", 1) for x in rows], "doc_id bigint, text string, h string, n int")
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in S.grouped(S.counted(S.worn(S.runs(docs)))).collect()}
    assert got == plain(counted(rows)) and len(got) > 60
    assert S.grouped(S.counted(S.worn(S.runs(docs.limit(0))))).count() == 0


def test_anagrams_of_each_other_and_chains(spark):
    r = random.Random(6)
    n = {"".join(r.sample("aabbccdd", 8)): r.choice([2, 2, 5, 20, 300]) for _ in range(400)}
    n |= {"aaaaaaa": 2, "aaaaaaaa": 30, "aaaaaaaaa": 400, "aaaaaaaab": 400, "baaaaaaa": 2, "zzzzzzz": 9}
    got = group(spark, n)
    assert got == plain(n) and got["aaaaaaa"][:2] == ("aaaaaaaa", "aaaaaaaaa")
    assert group(spark, n, ratio=2) == plain(n, 2)


def test_very_long_words(spark):
    long = "ab" * 1500
    n = {long: 500, long[:-1]: 3, long[:700] + "c" + long[701:]: 2, long[:700] + "x" + long[700:]: 50}
    assert group(spark, n) == plain(n)


@pytest.mark.parametrize("a, b", [("ab", "ba"), ("abc", "cab")])
def test_keys_ignore_order(spark, a, b):
    keys = S._keyed(spark.createDataFrame([(a, 1), (b, 1), (a + "d", 1)], "word string, n bigint")).collect()
    assert keys[0].key == keys[1].key == keys[2].key - keys[2]["values"][-1]
