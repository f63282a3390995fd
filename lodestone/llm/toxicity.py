"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms. Every word (a run of letters, lower-cased) offers itself and its prefixes
of ``PREFIXES`` letters. From the labelled training texts, at most
``TOXIC_TEXTS`` and ``CLEAN_TEXTS`` of either label by a hash of the id (a bound
on the classifier's sample), a term's documents are counted by label, toxic ones no more often than the
term has different words before it there (by linear counting in 64 bits, so that
near copies of a text don't vouch for its rare words). Terms whose toxic share
is surely high (Wilson's lower bound of at least ``PURITY``) are kept, the
``MAX_TERMS`` surest. A word stands for its surest kept term. A text's vector
holds (1 + ln tf) * idf for its terms, with idf from all documents, and one
constant component, so that the cosine also tells one mention from many.

Examples. Training texts with equal vectors are one example with its count of
either label. About ``MAX_EXAMPLES`` with toxic texts and as many without are
indexed, chosen by a hash of the vector (a bound on the classifier's labelled
sample); ``Index.left_out`` tells how many were not.

Search. Postings are cut into blocks of ``BLOCK`` examples with each block's
greatest weight. A query takes blocks in order of the bound these give and
stops where the bound falls under the k-th best cosine, so the ``K`` nearest
are exact. Each votes with the label share of its texts, by 1 / (``NEAR`` +
distance) ** 2, against a prior; the nearest ``EVIDENCE`` are given as evidence,
each with the id of one of its texts, its cosine and its toxic share.

Defined results: a null or empty text has the constant component alone; a very
long one has a vector as any other; an empty table gives an empty result; without
training labels every score is 0. Label rows whose label is null or whose text
is missing teach nothing; a text labelled twice counts once for either label.
Rows are scored one by one; other columns stay.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow, bounded_batches, drop_stored, fresh, plus, read, remainder, sampled, stored

PREFIXES = (4, 5, 6)
PURITY, MAX_TERMS, MAX_EXAMPLES = 0.6, 4096, 4096
TOXIC_TEXTS, CLEAN_TEXTS = 16_384, 32_768
K, BLOCK, NEAR, PRIOR_WEIGHT, EVIDENCE = 15, 64, 0.02, 0.5, 3
CONSTANT = 1.0
_WORD = re.compile(r"[^\W\d_]+")


def offered(word: str) -> list[str]:
    """The terms of a word: itself, and its prefixes marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def choose_terms(labelled: DataFrame) -> dict[str, float]:
    """The kept terms and their sureness; ``labelled``: text, toxic (boolean)."""

    def partial(batches):
        toxic, clean, seen = Counter(), Counter(), {}
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                own = {t for w in set(words) for t in offered(w)}
                (toxic if label else clean).update(own)
                for before, w in zip(["", *words], words, strict=False) if label else ():
                    bit = 1 << (zlib.crc32(before.encode()) & 63)
                    for t in offered(w):
                        seen[t] = seen.get(t, 0) | bit
            if len(toxic) + len(clean) > 200_000:
                yield _counts(toxic, clean, seen)
                toxic, clean, seen = Counter(), Counter(), {}
        yield _counts(toxic, clean, seen)

    counts = labelled.transform(arrow, partial, "term:string,a:bigint,b:bigint,bits:bigint").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.bit_or("bits").alias("bits"))
    free = 64 - F.bit_count("bits")
    varied = F.when(free == 0, F.col("a")).otherwise(F.least(F.col("a").cast("double"), -64 * F.log((F.greatest(free, F.lit(1))) / 64)))
    counts = counts.where("a >= 4").withColumn("v", varied).where("v >= 3")
    n, z = F.col("v") + F.col("b"), 2.0
    p = F.col("v") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    kept = counts.withColumn("low", low).where(F.col("low") >= PURITY).orderBy(F.desc("low"), "term").limit(MAX_TERMS)
    return {r.term: r.low for r in kept.select("term", "low").collect()}


def _counts(toxic: Counter, clean: Counter, seen: dict[str, int]) -> pa.RecordBatch:
    terms = list(toxic.keys() | clean.keys())
    bits = np.array([seen.get(t, 0) for t in terms], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([toxic[t] for t in terms], pa.int64()), pa.array([clean[t] for t in terms], pa.int64()), pa.array(bits)], names=["term", "a", "b", "bits"])


def vector_of(text: str | None, terms: dict[str, tuple[int, float]], heads: frozenset[str], least: int) -> list[tuple[int, int]]:
    """(term id, count) of a text, ascending; ``heads``: the first ``least`` letters of every term."""
    found: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        if w[:least] in heads:
            own = [terms[t] for t in offered(w) if t in terms]
            if own:
                found[max(own, key=lambda x: (x[1], -x[0]))[0]] += n
    return sorted(found.items())


def with_vectors(docs: DataFrame, text_col: str, terms: dict[str, float], name: str) -> DataFrame:
    """``docs`` without the text but with its vector as 'id:count ...' under ``name``."""
    ids = {t: (i, s) for i, (t, s) in enumerate(sorted(terms.items()))}
    least = min((len(t.rstrip("*")) for t in ids), default=1)
    shared = docs.sparkSession.sparkContext.broadcast((ids, frozenset(t[:least] for t in ids), least))
    keep = [c for c in docs.columns if c != text_col]

    def vectors(batches):
        own, heads, k = shared.value
        for b in batches:
            keys = [" ".join(f"{i}:{n}" for i, n in vector_of(t, own, heads, k)) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(keys, pa.string())], names=[*keep, name])

    return docs.transform(arrow, vectors, plus(docs, keep, f"`{name}` string"))


def parse(key: str) -> list[tuple[int, int]]:
    return [tuple(map(int, x.split(":"))) for x in key.split()]


class Index:
    """Blocked postings of the examples' unit vectors, with block maxima; component 0 is the constant."""

    #: Distinct example vectors that the sample left out.
    left_out = 0

    def __init__(self, examples: list[tuple[str, int, int]], idf: dict[int, float], prior: float, texts: dict | None = None):
        """``examples``: vector, toxic and clean texts; ``texts``: the id of one text by vector, for evidence."""
        self.idf, self.prior, self.texts = idf, prior, texts or {}
        examples = sorted(examples)
        self.keys = [k for k, _, _ in examples]
        n = np.array([a + b for _, a, b in examples], np.float64)
        self.share = np.array([a for _, a, _ in examples], np.float64) / np.maximum(n, 1)
        self.blocks = -(-len(examples) // BLOCK)
        postings: dict[int, list[tuple[int, float]]] = {}
        for e, key in enumerate(self.keys):
            for t, w in self.weights(key).items():
                postings.setdefault(t, []).append((e, w))
        self.postings = {}
        for t, rows in postings.items():
            at, w = np.array([e for e, _ in rows]), np.array([x for _, x in rows])
            start = np.searchsorted(at, np.arange(self.blocks + 1) * BLOCK)
            most = np.zeros(self.blocks)
            np.maximum.at(most, at // BLOCK, w)
            self.postings[t] = at, w, start, most

    def weights(self, key: str) -> dict[int, float]:
        """The unit vector of a text; term ids are shifted by one."""
        w = {0: CONSTANT} | {t + 1: (1 + math.log(n)) * self.idf.get(t, 0.0) for t, n in parse(key)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    def nearest(self, key: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (ties: the first), exactly, and the cosines."""
        if not self.blocks:
            return np.zeros(0, int), np.zeros(0)
        query = [(w, self.postings[t]) for t, w in self.weights(key).items() if t in self.postings]
        bound = np.zeros(self.blocks)
        for w, (_, _, _, most) in query:
            bound += w * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if len(best) == k and bound[b] + 1e-12 < -best[-1][0]:
                break
            first = b * BLOCK
            score = np.zeros(min(BLOCK, len(self.keys) - first))
            for w, (at, x, start, _) in query:
                s = slice(start[b], start[b + 1])
                score[at[s] - first] += w * x[s]
            best = sorted([*best, *((-round(v, 12), first + i) for i, v in enumerate(score.tolist()))])[:k]
        return np.array([e for _, e in best]), np.array([-s for s, _ in best])

    def score(self, key: str) -> tuple[float, list[tuple[int, float]]]:
        who, cosine = self.nearest(key)
        if not len(who):
            return 0.0, []
        vote = 1 / (NEAR + np.maximum(0, 1 - cosine)) ** 2
        value = ((vote * self.share[who]).sum() + PRIOR_WEIGHT * self.prior) / (vote.sum() + PRIOR_WEIGHT)
        return float(min(1.0, max(0.0, value))), list(zip(who.tolist(), cosine.tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], DataFrame, Index]:
    """Terms, every document's vector (its columns but the text, and ``vector``), and the index, learned from ``labels``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null and i is not null").distinct()
    taught = sampled(marks.where("toxic > 0"), F.col("i"), TOXIC_TEXTS).unionByName(sampled(marks.where("toxic <= 0"), F.col("i"), CLEAN_TEXTS))
    terms = choose_terms(texts.join(F.broadcast(taught), "i").select("text", (F.col("toxic") > 0).alias("toxic")))
    name, = fresh(docs, "vector")
    vectors = stored(with_vectors(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, terms, name), "vectors")
    n = vectors.count()
    df = vectors.select(F.explode(F.split(F.col(name), " ")).alias("x")).where("x <> ''").groupBy(F.split_part("x", F.lit(":"), F.lit(1)).cast("int").alias("t")).count()
    idf = {r.t: math.log((1 + n) / (1 + r["count"])) + 1 for r in df.collect()}
    taught = vectors.select(F.col(id_col).alias("i"), F.col(name).alias("key")).join(marks, "i").groupBy("key").agg(F.sum((F.col("toxic") > 0).cast("bigint")).alias("a"), F.count("*").alias("n"), F.min("i").alias("i"))
    taught = stored(taught, "examples")
    total = taught.agg(F.sum("a").alias("a"), F.sum("n").alias("n"), F.count_if(F.col("a") > 0).alias("marked"), F.count_if(F.col("a") == 0).alias("clean")).first()
    kept = sampled(taught.where("a > 0"), F.col("key"), MAX_EXAMPLES).unionByName(sampled(taught.where("a = 0"), F.col("key"), MAX_EXAMPLES))
    rows = kept.collect()
    prior = total.a / total.n if total.n else 0.0
    index = Index([(r.key, r.a, r.n - r.a) for r in rows], idf, prior, {r.key: r.i for r in rows})
    index.left_out = (total.marked or 0) + (total.clean or 0) - len(rows)
    drop_stored(taught)
    return terms, vectors, index


def scored(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``docs`` without the text, with score and neighbours (array of id of one text, cosine, toxic share)."""
    name, = fresh(docs, "vector")
    _, vectors, index = fit(docs, labels, **columns)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    keep = [c for c in vectors.columns if c not in (name, "score", "neighbours")]
    id_type = docs.schema[columns.get("id_col", "doc_id")].dataType.simpleString()
    schema = plus(vectors, keep, f"score double, neighbours array<struct<example:{id_type},cosine:double,toxic_share:double>>")
    kind = to_arrow_type(schema["neighbours"].dataType)

    def score(batches):
        own = shared.value
        known: dict[str, tuple] = {}
        for b in batches:
            out, why = [], []
            for key in b.column(name).to_pylist():
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    s, near = own.score(key)
                    known[key] = s, [{"example": own.texts.get(own.keys[e]), "cosine": c, "toxic_share": float(own.share[e])} for e, c in near[:EVIDENCE]]
                out.append(known[key][0])
                why.append(known[key][1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.float64()), pa.array(why, kind)], names=[*keep, "score", "neighbours"])

    return vectors.transform(arrow, score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(F.col("doc_id"), 3) != 1)
    out = scored(docs, labels)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "neighbours")
