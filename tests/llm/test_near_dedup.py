import random

import pytest

from lodestone.llm import components, near_dedup as N


def brute(rows):
    """component by row: exact Jaccard of 2-word shingles, union-find, least id."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:])))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(seed=5, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [r.choice(vocab) for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(60)] = r.choice(vocab)
        out.append(" ".join(w))
    out += [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 30))) for _ in range(80)]
    return out + out[:30] + ["", "x", "X", " ", None]


@pytest.mark.parametrize("node,block", [(128, 512), (4, 512), (4, 16)])
def test_components_equal_brute_force(spark, monkeypatch, node, block):
    monkeypatch.setattr(N, "NODE", node)
    monkeypatch.setattr(N, "BLOCK", block)
    rows = list(enumerate(family()))
    got = N.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_threshold_is_inclusive(spark):
    a = [f"t{i}" for i in range(10)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:9])), (3, " ".join([*a, "u"])), (4, "p q r s t"), (5, "p q r s")]
    got = {r.doc_id: r.component_id for r in N.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: c for d, _, c in brute(rows)}


def test_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.linked(odd).collect()]
    assert len(got) == odd.count()
    as_dict = {}
    for r in got:
        as_dict.setdefault(r[0], []).append(r[1:])
    assert as_dict[1] == [(0, 1, True)] and as_dict[2] == [(0, 2, True)]
    assert as_dict[4] == [(1, 4, True)] and as_dict[8] == [(1, 4, False)]
    assert as_dict[5] == [(as_dict[5][0][0], 5, True)] * 2
    assert N.linked(none).count() == 0 and N.deduplicated(none).columns == none.columns and N.deduplicated(none).count() == 0


def test_one_row_stays_of_each_component(spark, odd):
    out = N.deduplicated(odd)
    assert out.columns == odd.columns
    ids = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is not None, x or 0))
    assert ids == [None, 1, 2, 3, 4, 5, 6, 7]


def test_pipeline_takes_five_words(spark):
    import corpus_pipeline

    r = random.Random(11)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for changes in (1, 1, 2, 3, 4, 5, 6, 8) * 4:
        base = words(60)
        other = list(base)
        for k in range(changes):
            other[5 + 6 * k] = words(1)[0]
        texts += [" ".join(base), " ".join(other)]
    texts += ["a b c", "a b c", "a b c d", "b c", *(" ".join(words(n)) for n in range(1, 9))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_copies(spark, df, "").collect()}
    assert kept == {min(i for i, g in enumerate(group) if g == x) for x in set(group)}
    assert N.linked(df).where("kept").count() < len(kept)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (201, 202), (202, 201)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 201: 201, 202: 201}
    assert components.components(df.limit(0)).count() == 0


def test_hot_group_of_near_copies(spark):
    r = random.Random(2)
    base = [f"h{i}" for i in range(80)]
    texts = []
    for _ in range(700):
        w = list(base)
        w[r.randrange(80)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = N.linked(df).where("kept")
    assert out.count() == 1


def test_large_family_of_unlike_texts_is_dealt_a_few_times(spark, monkeypatch):
    """Most rows of the family aren't linked with its leader; what is dealt at a time follows the rows, not their square."""
    for name, value in {"NODE": 4, "BLOCK": 16, "WIDE": 32, "WIDE_PASS": 1}.items():
        monkeypatch.setattr(N, name, value, raising=False)
    r = random.Random(9)
    base = [f"c{i}" for i in range(60)]
    texts = []
    for changes in [2] * 120 + [1] * 8:
        w = list(base)
        for at in r.sample(range(60), changes):
            w[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(r.choice("abcdefg") for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(texts))
    dealt, confirmed = [], N._confirmed

    def counted(blocks, width):
        dealt.append(blocks.count())
        return confirmed(blocks, width)

    monkeypatch.setattr(N, "_confirmed", counted)
    got = N.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute(rows))
    assert len(dealt) > 1 and max(dealt) < 6 * len(rows)


def test_rounds_of_components_take_few_tasks(spark):
    """Where partitions stay many, as with skewed tables, a round costs a shuffle for each star and one for its state."""
    edges = [(0, i) for i in range(1, 700)] + [(i, i + 1) for i in range(1000, 1040)]
    r = random.Random(3)
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(3)
    context, many = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        context.setJobGroup("rounds", "")
        got = {x.node: x.component for x in components.components(df).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**{i: 0 for i in range(700)}, **{i: 1000 for i in range(1000, 1041)}}
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("rounds") for s in told.getJobInfo(j).stageIds}
    assert sum(x.numCompletedTasks for s in stages if (x := told.getStageInfo(s))) < 1200
