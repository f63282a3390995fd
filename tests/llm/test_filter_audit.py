"""The audit against one that applies each order's filters one after another."""

import random
import re
from itertools import permutations

import numpy as np

from lodestone.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHOWN = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    """For each (id, text, part): its part and the set of letters it fails."""
    out = []
    for i, text, part in rows:
        t = text or ""
        w = WORD.findall(t)
        f = set()
        if len(w) < 200:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            f.add("E")
        out.append((i, part or "", f))
    return out


def plain(rows, labels):
    docs = failing(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(i, f) for i, p, f in docs if p == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                stay, go = [d for d in left if x not in d[1]], [d for d in left if x in d[1]]
                sums[x] += len(go)
                earlier = sum(x in f for _, f in mine) - len(go)
                only = sum(f == {x} for _, f in mine)
                out[part, "".join(order), step] = [len(stay), len(go), earlier, only, sum(i in good for i, _ in go), sum(i in toxic for i, _ in go)]
                left = stay
        for k in [k for k in out if k[0] == part]:
            out[k].append(sums[k[1][k[2] - 1]])
    return out


def test_equals_filters_one_after_another(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    pool = ["", "AB", "x" * 40, " \t\n "]
    for _ in range(25):
        w = [word() for _ in range(r.choice([20, 199, 200, 201, 260]))]
        if r.random() < 0.4:
            w = [r.choice(w[: r.choice([3, 120])]) for _ in w]
        if r.random() < 0.4:
            w = [x.upper() if r.random() < 0.05 else x for x in w]
        if r.random() < 0.3:
            w.append(r.choice("#$%&*|@"))
        pool.append(r.choice([" ", "\n", "  "]).join(w))
    rows = [(i, r.choice([*pool, None]), r.choice(["en", "fr", "", None])) for i in range(150)] + [(None, pool[5], "en"), (None, "no id", "xx"), (3, pool[5], "en"), (3, pool[5], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 200, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, 1, "m") for x in rows], "doc_id bigint, text string, lang string, mask int, first string")
    got = A.audited(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    expected = plain(rows, labels)
    assert {(x.part, x.filter_order, x.step): [x[c] for c in SHOWN] for x in got} == expected and len(got) == len(expected)


def test_empty_tables_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000 + "b", "en"), (2, "Z" * 400_000, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {(x.filter_order, x.step): x for x in A.audited(docs, labels).collect()}
    assert len(got) == 600 and got["ABCDE", 1].kept == 1 and got["BACDE", 1].removed == 1 and got["CABDE", 1].removed == 1
    assert A.audited(docs.limit(0), labels).count() == 0


def test_matrices_count_every_document_once():
    m = A.outcomes()
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    counts = np.random.default_rng(3).integers(0, 1 << 40, (4, 3, 32))
    got = A.audit(counts)
    for k in range(120):
        steps = slice(5 * k, 5 * k + 5)
        gone = got["removed"][:, steps].sum(axis=1)
        assert (gone + got["kept"][:, 5 * k + 4] == counts[:, 0].sum(axis=1)).all()
