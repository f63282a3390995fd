"""Language-model scores, fingerprints, token counts, page text and mixing."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fingerprint as P
from lodestone.llm import html_text as H
from lodestone.llm import lm_score as M
from lodestone.llm import mixing as I
from lodestone.llm import tokens as K


def test_gradients_and_scores_agree():
    net, r = M.Attention(), np.random.default_rng(0)
    symbols, bounds = r.integers(0, M.CLASSES * M.MEMBERS, 150), np.array([0, 70, 71, 71, 150])
    ids, before, place = net.layout(symbols, bounds)
    target = np.full(ids.size, -1)
    target[place] = symbols
    target = target.reshape(-1, M.BLOCK)[:-1]
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    mine, both = np.maximum(ids[:-1], 0), np.concatenate([ids[before], ids[:-1]], axis=1)
    loss, grad = net.step(mine, both, target)
    for k, v in net.p.items():
        i = (int(symbols[3]), 1) if k == "e" else tuple(int(r.integers(0, s)) for s in v.shape)
        keep, e = v[i], 1e-5
        v[i] = keep + e
        up = net.step(mine, both, target)[0]
        v[i] = keep - e
        down = net.step(mine, both, target)[0]
        v[i] = keep
        assert (up - down) / (2 * e) == pytest.approx(grad[k][i], rel=1e-3, abs=1e-7), k
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    assert -net.score(symbols, bounds).mean() == pytest.approx(loss, rel=1e-4)
    # a symbol's score depends on what stands before it in its row only
    changed = symbols.copy()
    changed[100:] = 5
    assert np.allclose(net.score(symbols, bounds)[:100], net.score(changed, bounds)[:100], atol=1e-5)


def test_next_symbol_probabilities_sum_to_one():
    net = M.Attention()
    n = M.CLASSES * M.MEMBERS
    rows = np.concatenate([[7, 8, i] for i in range(n)])
    lp = net.score(rows, np.arange(0, 3 * n + 1, 3))[2::3]
    assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_of_a_corpus(spark, corpus, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 60)
    out = M.scored(corpus, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2)
    rows = {r.doc_id: r.text for r in corpus.collect()}
    tokens = lambda t: [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()), None]
    count = Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    total, kinds, got = sum(count.values()), len(count), out.collect()
    for r in got:
        w = tokens(rows[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), abs=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert len(got) == len(rows) and sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_rare_words_are_mixed_with_their_exact_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 20)
    held = F.col("doc_id") % 7 == 2
    whole = {r.doc_id: r for r in M.scored(corpus, held).collect()}
    monkeypatch.setattr(M, "FREQUENT", 9)
    few = M.scored(corpus.unionAll(corpus.where("doc_id = 2")), held).collect()
    assert len(few) == len(whole) + 1
    for r in few:
        w = whole[r.doc_id]
        assert (r.n_tokens, r.n_known, r.held_out) == (w.n_tokens, w.n_known, w.held_out)
        assert (r.base_score, r.score) == pytest.approx((w.base_score, w.score), rel=1e-5)


def test_every_training_text_is_learned_from(spark, corpus, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 20)
    monkeypatch.setattr(M, "SAMPLE_DOCS", 1)
    rows = [(r.doc_id, r.text) for r in corpus.orderBy("doc_id").collect()]
    filler = rows[0][1] + " same" * 1000
    late = [(i, f"{filler} {'qzj ' * 200}" if i == 9 else t) for i, t in rows]
    early = [(i, filler if i == 9 else t) for i, t in rows]
    nets = [M.fitted(spark.createDataFrame(x, "id bigint, text string"))[0] for x in (early, late)]
    ids = M.pieces(nets[0].symbols.path, [b"qzj"])[0]
    assert (nets[1].symbols.of[ids] > 0).all() and not (nets[0].symbols.of[ids] > 0).all()
    # the network itself moves with texts outside the sample: without one it learns from the pass alone
    monkeypatch.setattr(M, "SAMPLE_DOCS", 0)
    scorer = M.fitted(spark.createDataFrame(rows * 20, "id bigint, text string"))[0]
    symbols, bounds = M.Rows(scorer.symbols)([t for _, t in rows])
    assert scorer.net.score(symbols, bounds).mean() > M.Attention().score(symbols, bounds).mean() + 0.05


def test_scores_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 3)
    out = M.scored(odd, F.col("doc_id") == 5).collect()
    assert len(out) == odd.count() and all(math.isfinite(r.score) and r.score < 0 for r in out)
    by = {r.doc_id: r for r in out}
    assert (by[1].n_tokens, by[2].n_tokens, by[3].n_tokens, by[5].n_tokens) == (1, 1, 1, 60_001) and by[1].n_known == 1
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    alone = M.scored(odd, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in alone)
    assert M.scored(none, F.lit(False)).count() == 0


def test_fingerprints_equal_the_definition(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in P.fingerprints(corpus).collect()}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (P.fingerprint(t), P.fingerprint(edited))
        assert got[d].near_edited > got[d].near_next or t == nxt


def test_ranges_meet_at_their_edges(spark, corpus, monkeypatch):
    whole = {(r.doc_id, r.edited_sha256) for r in P.fingerprints(corpus).collect()}
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    assert {(r.doc_id, r.edited_sha256) for r in P.fingerprints(corpus.repartition(5)).collect()} == whole


def test_fingerprints_are_homomorphic():
    a, b = "first part\nsecond part", "third one here"
    assert P.combine(P.fingerprint(a), P.fingerprint(b)) == P.fingerprint(b + "\n" + a) == P.fingerprint("second part\nthird one here\n\nfirst part")
    assert P.combine(P.fingerprint(a + "\n" + b), P.fingerprint(b), -1) == P.fingerprint(a)
    assert P.fingerprint("x\ny") != P.fingerprint("x y") and P.fingerprint("") == P.fingerprint(None) == P.fingerprint("\n\n")
    x = P.decode(P.fingerprint(a))
    assert P.likeness(x[0][None], x[1][None], x[0][None], x[1][None])[0] == 1


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = P.fingerprints(odd).collect()
    assert len(got) == odd.count() and {r.n_chars for r in got if r.doc_id in (1, 2)} == {0}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got) and P.fingerprints(none).count() == 0
    lone = P.fingerprints(odd.where("doc_id = 6")).first()
    assert lone.near_next == 1


@pytest.mark.parametrize("rule", K.RULES)
def test_attribution_rules(rule):
    ends, sections = np.array([3, 7, 8, 12]), np.array([2, 2, 8, 12])
    expected = {"start": [1, 0, 2, 1], "most": [1, 0, 2, 1], "split": [2 / 3, 0, 1 / 3 + 2, 1]}[rule]
    assert K.attribute(ends, sections, rule).tolist() == pytest.approx(expected)
    assert K.attribute(np.zeros(0, int), np.array([0, 0]), rule).tolist() == [0, 0]


def test_token_counts_of_odd_rows(spark, odd, none):
    enc = K.encoder(K.VOCABULARY)[0]
    for rule in K.RULES:
        out = K.section_tokens(odd, K.head_body_tail(F.col("text")), rule=rule)
        assert out.count() == odd.count()
        for r in out.collect():
            n = len(enc.encode_ordinary(r.text or ""))
            assert r.n_tokens == n and sum(s.n_tokens for s in r.section_tokens) == pytest.approx(n)
            assert "".join((r.text or "")[s.start : s.end] for s in r.section_tokens) == (r.text or "")
    bad = F.expr("array(named_struct('name', 'a', 'end', -4L), named_struct('name', 'b', 'end', cast(null as bigint)), named_struct('name', 'c', 'end', 5L), null, named_struct('name', 'd', 'end', 2L), named_struct('name', 'e', 'end', 999999L))")
    for r in K.section_tokens(odd, bad).collect():
        n = len(r.text or "")
        c = min(5, n)
        assert [(s.name, s.start, s.end) for s in r.section_tokens] == [("a", 0, 0), ("b", 0, 0), ("c", 0, c), (None, c, c), ("d", c, c), ("e", c, n)]
        assert sum(s.n_tokens for s in r.section_tokens) == r.n_tokens
    rest = K.section_tokens(odd.where("doc_id = 6"), F.array(F.struct(F.lit("a").alias("name"), F.lit(3).alias("end")))).first()
    assert [s.name for s in rest.section_tokens] == ["a", "rest"]
    assert K.section_tokens(none, K.head_body_tail(F.col("text"))).count() == 0
    with pytest.raises(ValueError):
        K.section_tokens(odd, F.lit(None), rule="other")


PAGES = {
    "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>It is the\n  text. <b>Bold</b><br>x</p><div class='ads'>Buy it</div><p>End.</p><section id=comments><p>It was a very good article that I have read</p></section></article><footer>c</footer></body>": "T & U It is the text. Bold x End.",
    "<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><h2>Title</h2><p>This is the long text of the page and it is about all that is in the world of the men.</p><p>Short one.</p><p>And this is the other long text of the page that is for those who have the time to read.</p><p>&copy; 2020</p></body>": "Title This is the long text of the page and it is about all that is in the world of the men. Short one. And this is the other long text of the page that is for those who have the time to read. © 2020",
    "<p>Only text": "Only text",
    "<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> -->": "",
    "<article><p>a < b and 5 &lt; 6 &#233;&nbsp;z</p></article>": "a < b and 5 < 6 é z",
    "": "",
    "<article><p hidden>gone</p><p>kept by the rule of the day</p><form><input>Name</form></article>": "kept by the rule of the day",
}


def test_main_text():
    assert {k: H.main_text(k) for k in PAGES} == PAGES
    assert H.main_text(None) == ""
    assert H.main_text("<p a=\"" * 20_000) != None  # noqa: E711


def test_pages_table(spark, none):
    rows = [(i, "u", h, "x") for i, h in enumerate(PAGES)] + [(99, None, None, "x"), (0, "u", list(PAGES)[0], "x")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, n_chars string")
    got = H.extracted(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[99] == "" and H.extracted(pages.limit(0)).count() == 0


def ipf(cells, want, sweeps=200):
    w = np.ones(len(cells))
    m = np.array([c[3] for c in cells])
    for _ in range(sweeps):
        for d in range(3):
            total = Counter()
            for c, x in zip(cells, m * w):
                total[c[d]] += x
            w *= [want[d][c[d]] / total[c[d]] if total[c[d]] else 0 for c in cells]
    return w


def test_raking_equals_plain_ipf(spark, corpus):
    out = I.mixed(corpus).collect()
    mass = Counter()
    for r in out:
        mass[r.source, r.lang, r.mix_topic] += r.n_tokens
    cells = [(*k, m) for k, m in sorted(mass.items())]
    total, want = sum(mass.values()), []
    for d, name in enumerate(("source", "lang", "topic")):
        by = Counter()
        for c in cells:
            by[c[d]] += c[3]
        raw = {k: v ** I.EXPONENTS[name] for k, v in by.items()}
        want.append({k: v / sum(raw.values()) * total for k, v in raw.items()})
    expected = dict(zip([c[:3] for c in cells], ipf(cells, want)))
    for r in out:
        assert r.weight == pytest.approx(expected[r.source, r.lang, r.mix_topic], rel=1e-3)
    assert sum(r.probability * r.n_tokens for r in out) == pytest.approx(I.KEEP * total, rel=1e-6)


def test_given_targets_and_repeats(spark, corpus):
    targets = spark.createDataFrame([("s0", 3.0), ("s1", 1.0)], "value string, share double")
    out = I.mixed(corpus, source_targets=targets, lang_targets={"en": 1.0}, keep=0.2)
    assert out.where("selected and (source not in ('s0', 's1') or lang <> 'en')").count() == 0
    r = out.groupBy("source").agg(F.sum(F.col("weight") * F.col("n_tokens")).alias("m")).where("m > 0").collect()
    m = {x.source: x.m for x in r}
    assert m["s0"] / m["s1"] == pytest.approx(3, rel=1e-4)
    again = {(x.doc_id, x.selected) for x in I.mixed(corpus).select("doc_id", "selected").collect()}
    assert again == {(x.doc_id, x.selected) for x in I.mixed(corpus.repartition(7)).select("doc_id", "selected").collect()}


def test_mixing_odd_rows(spark, odd, none):
    out = I.mixed(odd)
    assert out.count() == odd.count() and out.where("probability is null or probability < 0 or probability > 1").count() == 0
    assert {r.n_tokens for r in out.where("doc_id in (1, 2)").collect()} == {0}
    assert I.mixed(none).count() == 0 and set(odd.columns) < set(out.columns)


def test_sample_meets_its_targets_under_the_bound(spark):
    cells = [(f"s{i}", l, t, 1000.0) for i in range(3) for l in ("x", "y") for t in ("p", "q")]
    cells[1] = ("s0", "x", "q", 150.0)
    cells[4] = ("s1", "x", "p", 300.0)
    df = spark.createDataFrame(cells, "source string, lang string, topic string, mass double")
    total = sum(c[3] for c in cells)
    src = spark.createDataFrame([(f"s{i}", 1.0) for i in range(3)], "value string, share double")
    options = {"source_targets": src, "lang_targets": {"x": 1.0, "y": 1.0}, "topic_targets": {"p": 2.0, "q": 3.0}}
    out = I.bounded(df, 0.7, **options).collect()
    assert all(0 <= x.probability <= 1 for x in out) and any(x.weight * 0.7 > 1.05 for x in out)
    want = [{f"s{i}": 1 / 3 for i in range(3)}, {"x": 0.5, "y": 0.5}, {"p": 0.4, "q": 0.6}]
    for d, name in enumerate(("source", "lang", "topic")):
        for v, share in want[d].items():
            assert sum(x.mass * x.probability for x in out if x[name] == v) == pytest.approx(share * 0.7 * total, rel=1e-3)
    again = spark.createDataFrame(out)
    assert I.shortfalls(again, 0.7, **options).count() == 0
    short = I.shortfalls(again.withColumn("probability", F.lit(0.7)), 0.7, **options)
    assert {r.dimension for r in short.collect()} == {"source", "lang", "topic"}


def test_the_weight_of_the_mixture_is_fitted_to_all_training_words(spark, monkeypatch):
    monkeypatch.setattr(M, "STEPS", 5)
    monkeypatch.setattr(M, "SAMPLE_DOCS", 1)
    monkeypatch.setattr(M, "FREQUENT", 9)
    rows = [(i, f"ab{i % 7} cd ef{i % 11} " * (i % 5 + 1)) for i in range(60)]
    n_words, held = sum(len(t.split()) + 1 for _, t in rows), []
    fit = M.Scorer.fit_share

    def noted(self, ahead, n):
        held.append(n.sum())
        fit(self, ahead, n)

    monkeypatch.setattr(M.Scorer, "fit_share", noted)
    scorer = M.fitted(spark.createDataFrame(rows, "id bigint, text string"))[0]
    assert held == [n_words] and 0.02 <= scorer.share <= 0.98
    # a weight that is known is found again
    r = np.random.default_rng(1)
    from_a = r.random(4000) < 0.3
    ahead = np.where(from_a, 3.0, -3.0)
    one = M.Scorer(scorer.symbols, scorer.net, np.zeros(0, np.uint64), np.zeros(0, np.int64), 1, 1, 1)
    fit(one, ahead, np.ones(4000))
    share = one.share
    assert np.mean(np.exp(ahead) * share / (np.exp(ahead) * share + 1 - share)) == pytest.approx(share, abs=1e-3)


def test_a_training_step_makes_its_softmaxes_once_for_all_classes(monkeypatch):
    net, r, calls, exp = M.Attention(), np.random.default_rng(4), [], np.exp
    blocks = M.Blocks(net, r.integers(0, M.CLASSES * M.MEMBERS, 3000), np.array([0, 7, 1500, 3000]))
    both = np.concatenate([blocks.ids[blocks.before], blocks.ids[:-1]], axis=1)
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    loss, _ = net.step(np.maximum(blocks.ids[:-1], 0), both, blocks.target[: len(blocks)])
    assert len(calls) == 3 and len(net.last) == 3000 and loss == pytest.approx(-net.last.mean(), rel=1e-5)


def test_a_batch_reads_a_block_once_with_the_same_gradients(monkeypatch):
    net, r, seen, real = M.Attention(), np.random.default_rng(5), [], M.Attention.gradient
    blocks = M.Blocks(net, r.integers(0, M.CLASSES * M.MEMBERS, 9000), np.array([0, 7, 4000, 9000]))
    batches, adam = M.picks(len(blocks), r), M.Adam(net)
    assert sorted(np.concatenate(batches).tolist()) == list(range(len(blocks)))
    monkeypatch.setattr(M.Attention, "gradient", lambda self, rows, *x: (seen.append(len(rows)), real(self, rows, *x))[1])
    for pick in (*batches, r.integers(0, len(blocks), 90)):
        loss = adam.update(blocks, pick, 0.0)
        if len(set(pick.tolist())) == len(pick):
            assert seen[-1] <= len(pick) * (1 + 1 / M.RUN) + 5
        both = np.concatenate([blocks.ids[blocks.before[pick]], blocks.ids[pick]], axis=1)
        want, each = net.step(np.maximum(blocks.ids[pick], 0), both, blocks.target[pick])
        assert loss == pytest.approx(want, rel=1e-5)
        before, follows = blocks.before[pick], np.arange(-1, len(pick) - 1)
        apart = np.concatenate(([True], before[1:] != pick[:-1]))
        follows[apart] = np.arange(len(pick), len(pick) + apart.sum())
        _, once = real(net, blocks.ids[np.concatenate((pick, before[apart]))], follows, blocks.target[pick])
        assert all(np.allclose(once[k], each[k], rtol=1e-3, atol=1e-6) for k in each)


def test_steep_logits_stay_in_range():
    net, r = M.Attention(), np.random.default_rng(6)
    blocks = M.Blocks(net, r.integers(0, M.CLASSES * M.MEMBERS, 600), np.array([0, 7, 300, 600]))
    pick, p = np.arange(len(blocks)), {k: v * 40 for k, v in net.p.items()}
    both = np.concatenate([blocks.ids[blocks.before], blocks.ids[:-1]], axis=1)
    found = []
    for kind in (np.float32, np.float64):
        net.p = {k: v.astype(kind) for k, v in p.items()}
        found.append(net.step(np.maximum(blocks.ids[pick], 0), both, blocks.target[pick])[1])
    assert all(np.isfinite(g).all() and np.allclose(g, found[1][k], rtol=0.05, atol=1e-2 * abs(found[1][k]).max()) for k, g in found[0].items())


def test_scores_of_steep_networks_are_those_of_the_softmax():
    net, r = M.Attention(), np.random.default_rng(6)
    symbols, bounds = r.integers(0, M.CLASSES * M.MEMBERS, 600), np.array([0, 7, 300, 600])
    blocks, p = M.Blocks(net, symbols, bounds), net.p
    both = np.concatenate([blocks.ids[blocks.before], blocks.ids[:-1]], axis=1)
    for by in (1, 8, 12):
        net.p = {k: v.astype(np.float64) * by for k, v in p.items()}
        net.step(np.maximum(blocks.ids[:-1], 0), both, blocks.target[: len(blocks)])
        likely = net.last > -60  # the step's own log probabilities have a floor
        net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
        got = net.score(symbols, bounds)
        assert np.isfinite(got).all() and np.allclose(got[likely], net.last[likely], rtol=1e-2, atol=1e-2), by


def test_a_word_is_spelled_and_hashed_once(spark, monkeypatch):
    rows = [(i, f"ab{i % 7} cd ef{i % 11} " * (i % 5 + 1)) for i in range(30)]
    monkeypatch.setattr(M, "STEPS", 2)
    monkeypatch.setattr(M, "FREQUENT", 5)
    scorer, texts = M.fitted(spark.createDataFrame(rows, "id bigint, text string"))[0], [*(t for _, t in rows), "", "new Words"]
    calls, real = [], M.span_hashes
    monkeypatch.setattr(M, "span_hashes", lambda *a: calls.append(1) or real(*a))
    scorer.forget()
    first = scorer.read(texts)
    assert len(calls) == 1
    assert all(np.array_equal(a, b) for a, b in zip(first, scorer.read(texts), strict=True)) and len(calls) == 1
    # a full cache keeps the frequent words, and what is read doesn't depend on it
    monkeypatch.setattr(M, "_CACHE", 3)
    for part in (texts[:7], texts[7:], texts):
        again = scorer.read(part)
    assert all(np.array_equal(a, b) for a, b in zip(first, again, strict=True))
    assert [x.tolist() for x in first[:2]] == [[len(t.split()) for t in texts], [i for i, t in enumerate(texts) for _ in t.split()]]
    assert set(first[7].tolist()) == {int(real(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in {x.lower().encode() for t in texts for x in t.split()}} - set(scorer.frequent.tolist())
