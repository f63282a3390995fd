"""Base statistics against plain loops; outliers against dense estimates and planted rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefghi") for _ in range(r.randrange(2, k)))
    clean = lambda: "\n".join(" ".join(word(9) for _ in range(r.randrange(15, 40))) for _ in range(r.randrange(3, 9)))
    out = []
    for i in range(700):
        t, kind = clean(), "clean"
        if i % 10 == 3:
            kind = r.choice(["symbols", "lines", "repeats", "long"])
            if kind == "symbols":
                t = re.sub(r"(\w+)", lambda m: m[1] + r.choice(["##", "&&", "|"]), t)
            elif kind == "lines":
                lines = t.split("\n")
                t = "\n".join(r.choice(lines[:2]) for _ in range(40)) + "\n" + "\n".join(clean() for _ in range(4))
            elif kind == "repeats":
                t = " ".join([" ".join(t.split()[:10])] * 40)
            else:
                t = " ".join(word(9) * 4 for _ in range(100))
        out.append((i, t, r.choice(["en", "fr"]), r.choice(["a", "b"]), kind))
    return out


def test_counts_equal_plain_loops():
    r = random.Random(2)
    for t, *_ in [x[1:] for x in texts()[:60]] + [("",), (" \t\n\x0b",), ("a\n a\na\n\n\n",), ("x y # |  ",)]:
        assert Q.counts(t)[:5] == plain(t)
    for _ in range(200):
        t = "".join(r.choice(["a ", "b ", "c\n", "a a b ", "# "]) for _ in range(r.randrange(0, 60)))
        assert Q.counts(t)[:5] == plain(t)


def dense(x):
    """The estimate by sorting all distances, from medians."""
    floors = np.square(np.array(Q.FLOORS) * Q.UNIT)
    c = np.median(x, axis=0)
    s = np.diag(np.maximum((1.4826 * np.median(np.abs(x - c), axis=0)) ** 2, floors))
    d = lambda: np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)
    for _ in range(30):
        near = x[np.argsort(d(), kind="stable")[: int(np.ceil(Q.SHARE * len(x)))]]
        c, s = near.mean(axis=0), Q._consistent(Q.SHARE) * np.cov(near.T, bias=True) + np.diag(floors)
    near = x[d() <= Q.WITHIN]
    c, s = near.mean(axis=0), Q._consistent(0.975) * np.cov(near.T, bias=True) + np.diag(floors)
    return d()


def test_outliers_are_those_planted_and_those_of_a_dense_estimate(spark):
    rows = texts()
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id bigint, text string, lang string, source string, kind string, unit int")
    got = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain(t)
        assert got[i].base_failed == (got[i].n_words < 20 or 100 * got[i].n_repeat_words > 30 * got[i].n_words)
        assert not (got[i].base_failed and got[i].kept)
    assert all(got[i].kept == (kind == "clean") for i, *_, kind in rows)
    points = {r.id: r for r in Q.statistics(docs).collect()}
    for lang in ("en", "fr"):
        for source in ("a", "b"):
            ids = [i for i, _, x, y, _ in rows if (x, y) == (lang, source) and not got[i].base_failed]
            d = dense(np.array([[points[i][f"x{k}"] for k in range(4)] for i in ids], float))
            assert [got[i].kept for i in ids] == (d <= Q.CUT).tolist()
            inner = d < 12
            assert np.allclose(np.array([got[i].distance for i in ids])[inner], d[inner], rtol=0.5, atol=0.3)


def test_small_groups_are_pooled(spark):
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 23}", k) for i, t, _, _, k in texts()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kind string")
    got = {r.doc_id: r.kept for r in Q.judged(docs).collect()}
    assert all(got[i] == (k == "clean") for i, *_, k in rows)
    few = Q.judged(docs.where("doc_id < 40")).collect()
    assert all(r.kept == (not r.base_failed) for r in few)


def test_odd_rows(spark, odd, none):
    got = Q.judged(odd).collect()
    assert len(got) == odd.count() and {r.doc_id: r.kept for r in got}[1] is False
    assert Q.judged(none).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.75, 0.975])
def test_scaled_covariance_is_that_of_normal_data(share):
    x = np.random.default_rng(1).standard_normal((200_000, 4))
    near = x[np.argsort((x**2).sum(axis=1))[: int(share * len(x))]]
    assert np.allclose(Q._consistent(share) * near.var(axis=0), 1, atol=0.03)
