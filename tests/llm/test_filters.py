"""Decontamination, language identification, toxicity and line deduplication."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate as D
from lodestone.llm import language_id as L
from lodestone.llm import line_dedup as X
from lodestone.llm import toxicity as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, k=10):
    w, hit, ids = WORD.findall(low(text)), set(), set()
    for i, t in items:
        v = WORD.findall(low(t))
        if not v or i is None:
            continue
        n = min(k, len(v))
        for s in range(len(v) - n + 1):
            for a in range(len(w) - n + 1):
                if w[a : a + n] == v[s : s + n]:
                    hit.update(range(a, a + n))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), bool(hit)


@pytest.mark.parametrize("shard", [16 << 20, 1])
def test_contamination_equals_brute_force(spark, shard):
    r = random.Random(4)
    words = ["a", "b", "C", "d9", "é", "漢"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 12, 15]))) for i in range(12)] + [(None, "a b"), (99, None)]
    docs = [(i, text(r.randrange(0, 40)) + (items[r.randrange(12)][1] or "").upper() + text(5)) for i in range(40)] + [(40, None), (41, "")]
    out = D.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), window=10, shard_bytes=shard)
    got = {x.doc_id: x for x in out.collect()}
    for i, t in docs:
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == brute(t, items), (i, t)
        inside = sum(len(WORD.findall(low(t[s.start : s.end]))) for s in got[i].hit_spans) if t else 0
        assert inside == got[i].n_hit


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "no id here"), (2, "")], "item_id int, text string")
    out = D.contamination(odd, items)
    assert out.where("contaminated").select("doc_id").first().doc_id is None and out.where("contaminated").count() == 1
    assert D.decontaminated(odd, items).columns == odd.columns and D.decontaminated(odd, items).count() == odd.count() - 1
    assert D.decontaminated(none, items).count() == 0 and D.decontaminated(odd, items.limit(0)).count() == odd.count()
    assert D.contamination(odd, items.limit(0), spans=False).where("n_items > 0 or n_hit > 0").count() == 0


def ppm(samples, text, order):
    """Code lengths by the definition."""
    out = {}
    for lang, texts in samples.items():
        seen = {}
        for t in texts:
            b = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode())
            for i in range(len(b)):
                for k in range(order + 1):
                    ctx = (b"\0" * k + b[:i])[len(b[:i]) :] if k else b""
                    seen.setdefault((k, ctx), {}).setdefault(b[i], 0)
                    seen[k, ctx][b[i]] += 1
        b, bits = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()), 0.0
        for i in range(len(b)):
            for k in range(order, -1, -1):
                ctx = (b"\0" * k + b[:i])[len(b[:i]) :] if k else b""
                if (k, ctx) not in seen:
                    continue
                c = seen[k, ctx]
                n, d = sum(c.values()), len(c)
                if b[i] in c:
                    bits += math.log2((n + d) / c[b[i]])
                    break
                bits += math.log2((n + d) / d)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_are_exact():
    import numpy as np
    import pyarrow as pa

    from lodestone.llm.textkit import utf8

    samples = {"xx": ["the cat sat", "on the mat"], "yy": ["le chat était", "Été là"], "zz": []}
    m = L.Model({k: v for k, v in samples.items()}, order=3)
    texts = ["the mat", "le chat", "", "Qqq été sat", "\x00\x00t"]
    got = m.bits(*utf8(pa.array(texts)))
    for t, row in zip(texts, got):
        expected = ppm(samples, t, 3)
        assert np.allclose(row, [expected[x] for x in m.languages], atol=1e-3), t


def test_language_on_held_out_texts(spark, corpus):
    model = L.train(corpus.where("doc_id % 5 <> 0"))
    out = L.identify(corpus.where("doc_id % 5 = 0"), model)
    assert out.where("lang = lang_pred").count() == out.count() and out.where("score between 0.5 and 1").count() == out.count()


def test_language_of_odd_rows(spark, odd, none, corpus):
    model = L.train(corpus)
    out = L.identify(odd, model)
    assert set(out.columns) == set(odd.columns) | {"lang_pred", "score"} and out.schema["score"].dataType.simpleString() == "double"
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == got[7] == ("und", 0.0) and got[4][0] in ("en", "fr") and out.count() == odd.count()
    assert L.identify(none, model).count() == 0
    blank = L.train(none)
    assert {r.lang_pred for r in L.identify(odd, blank).collect()} == {"und"}
    assert L.train(odd.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_toxicity_on_held_out_texts(spark, corpus):
    labels = corpus.select("doc_id", "toxic")
    out = T.scored(corpus.drop("toxic"), labels.where("doc_id % 3 <> 1")).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert all((r.score >= 0.7) == bool(r.toxic) for r in out)
    assert all(r.neighbours and 0 <= r.neighbours[0].cosine <= 1.000001 for r in out)


def test_nearest_is_exact():
    r = random.Random(8)
    keys = sorted({" ".join(f"{t}:{r.randrange(1, 4)}" for t in sorted(r.sample(range(30), r.randrange(0, 6)))) for _ in range(300)})
    index = T.Index([(k, r.randrange(3), r.randrange(1, 3)) for k in keys], {t: 1 + t / 10 for t in range(30)}, 0.1)
    vectors = [index.weights(k) for k in index.keys]
    for key in [*r.sample(keys, 20), "", "3:1 29:2", "77:1"]:
        q = index.weights(key)
        exact = sorted((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), e) for e, v in enumerate(vectors))[: T.K]
        who, cosine = index.nearest(key)
        assert who.tolist() == [e for _, e in exact] and cosine.tolist() == pytest.approx([-s for s, _ in exact], abs=1e-9)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 0), (6, 1), (6, 1), (77, 1), (5, None)], "doc_id bigint, toxic int")
    out = T.scored(odd, labels)
    assert out.count() == odd.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert T.scored(odd, labels.limit(0)).where("score <> 0").count() == 0 and T.scored(none, labels).count() == 0


def drops(spark, texts, **k):
    out = X.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **k)
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}


def test_recurring_and_generalised_lines(spark):
    r = random.Random(3)
    own = lambda: " ".join(f"w{''.join(r.choice('abcdefghij') for _ in range(6))}" for _ in range(40))
    users = ["ann", "bob", "cyd", "dee", "eve", "fay", "gus"]
    texts = [f"{own()}\nPage {i} of 90, printed at 10:0{i}\nsession opened for user {users[i]} by the system\n{own()}" for i in range(7)]
    got = drops(spark, texts)
    assert got[0] == (texts[0], 4, 0)
    for i in range(1, 7):
        lines = texts[i].split("\n")
        assert got[i] == ("\n".join([lines[0], lines[3]]), 4, 2)


def test_copies_lose_recurring_lines_and_rare_lines_stay(spark):
    body = "\n".join(f"line {c} of a text that was copied" for c in "abcdef")
    texts = [body] * 8 + ["a line of its own\nanother line of its own"] * 4
    got = drops(spark, texts)
    assert got[0] == (body, 6, 0) and all(got[i] == ("", 6, 6) for i in range(1, 8))
    assert all(got[i] == (texts[i], 2, 0) for i in range(8, 12))


def test_documents_of_shared_lines_lose_them(spark):
    shared = ["this line is found in very many documents", "and that one is found in them as well"]
    texts = ["\n".join([*shared, f"own {c}"]) for c in "abcdefg"] + ["\n".join([shared[1], shared[0]])]
    got = drops(spark, texts)
    assert got[0] == (texts[0], 3, 0) and got[7] == ("", 2, 2)
    assert all(got[i] == (f"own {c}", 3, 2) for i, c in enumerate("abcdefg") if i)


def test_templates_in_a_hot_leaf(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    own = lambda: " ".join(word() for _ in range(40))
    fixed = [[word() for _ in range(6)] for _ in range(6)]
    lines = [f"the system says {' '.join(f)} to {word()}" for f in fixed for _ in range(7)] + [f"the system says {' '.join(word() for _ in range(8))}" for _ in range(90)]
    heads = [own() for _ in lines]
    got = drops(spark, [f"{h}\n{x}\n{own()}" for h, x in zip(heads, lines)])
    assert [got[i][2] for i in range(42)] == [int(i % 7 > 0) for i in range(42)]
    assert all(got[i][2] == 0 for i in range(42, len(lines)))


def test_lines_of_odd_rows(spark, odd, none):
    out = X.deduplicated(odd, min_docs=2)
    assert set(out.columns) == set(odd.columns) | {"n_lines", "n_dropped"} and out.count() == odd.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text is None and got[1].n_lines == 0 and got[2].text == "" and got[3].text == "   \n\t" and (got[4].text, got[8].text) == ("one", "")
    assert out.where("n_dropped > 0").count() == 1
    assert X.deduplicated(none).count() == 0
