"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic; a cell's mass is its
documents' tokens (runs of non-space characters). Cells' weights start at 1 and
are raked in turn so that weighted mass meets the target shares of the sources,
of the languages and of the topics, until no marginal is off by more than
``TOLERANCE``; after ``SWEEPS`` sweeps, or ``STILL`` without getting nearer (targets that
no weights can meet), a warning tells how far off they are.

A document's probability follows from its cell's weight so that the expected tokens
are ``KEEP`` of all. Probabilities end at 1, and that is raked in: from the raked
weights on, every sweep solves each source with its full cells held at 1, and fits
languages and topics to what full cells leave of their targets. So the sample's expected
marginals are the targets wherever the corpus has the tokens; ``shortfalls`` lists the
values where it hasn't, and what those lack is missing from the sample. The draw is a hash of id, text and
seed, so it is repeatable.

Targets default to tempered shares (mass ** exponent, renormalised); explicit
ones are given as a table (value, share) for sources and as dicts for languages
and topics. Shares of values that don't occur are dropped and the rest are
renormalised; values without a share get none and are never sampled. The topic
is any column expression; the default tells tables, symbol noise, shouting,
short texts and prose by cheap character counts.

Defined results: a null source, language or topic is the value ``unknown``; a
null or empty text has 0 tokens; a cell without mass has weight 1 and probability
``KEEP``. A very long text counts whole. Repeated rows draw alike. Extra columns stay.
An empty table gives an empty result.

Scale: sources stay distributed, a row each with at most languages x topics masses,
and are solved where they are; only the language x topic matrix, checked against
``MOST_KINDS``, reaches the driver, once a sweep. There languages and topics are fitted
to it in turn before the sources are solved again. Cells are sent to all
tasks where there are at most ``FEW_CELLS``; more are joined, salted, so that a cell
that holds a third of all rows is dealt to several tasks.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, drop_stored, fresh, local_rows, read, salted_join, stored

SWEEPS, INNER, STILL, TOLERANCE, KEEP, SEED = 50, 100, 4, 1e-6, 0.5, 11
MOST_KINDS, FEW_CELLS = 1 << 16, 100_000
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def _without(text: Column, chars: str) -> Column:
    """``text`` without some characters; replacing what isn't there copies nothing, unlike translate."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def topic_of(text: Column) -> Column:
    """table, symbols, shouting, short or prose."""
    n = F.char_length(text)
    share = lambda chars: (n - F.char_length(_without(text, chars))) / F.greatest(n, F.lit(1))
    return F.when(F.coalesce(n, F.lit(0)) < 200, "short").when(share("|") > 0.01, "table").when(share("#$%&*") > 0.05, "symbols").when(share("!") > 0.03, "shouting").otherwise("prose")


def token_count(text: Column) -> Column:
    """Runs of non-space characters, by counting spaces; only texts with odd white space are split."""
    return _count(F.btrim(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t\x0b\f\r ")))


def _count(b: Column) -> Column:
    odd = b.contains("  ") | b.contains("\t") | b.contains("\x0b") | b.contains("\f") | b.contains("\r")
    plain = F.char_length(b) - F.char_length(F.replace(b, F.lit(" "), F.lit(""))) + 1
    return F.when(b == "", 0).when(odd, F.size(F.split(b, r"[\x09-\x0D\x20]+"))).otherwise(plain)


def _described(docs: DataFrame, source: Column, lang: Column, topic: Column, text_col: str, names: list[str]) -> DataFrame:
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.withColumns(dict(zip(names, (known(source), known(lang), known(topic), F.coalesce(token_count(F.col(text_col)), F.lit(0)).cast("double")), strict=True)))


def _shares(mass: dict[str, float], given: dict[str, float] | None, exponent: float) -> dict[str, float]:
    """Target shares of the values that have mass."""
    raw = {k: (m**exponent if given is None else given.get(k, 0.0)) for k, m in mass.items() if m > 0}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {}


class Raking:
    """Cells laid out by source, with the targets' shares; ``fit`` finds the factors of languages and topics."""

    def __init__(self, cells: DataFrame, source_targets: DataFrame | None, lang_targets: dict[str, float] | None, topic_targets: dict[str, float] | None):
        """``cells``: stored, some with mass."""
        spark = cells.sparkSession
        kinds = cells.where("mass > 0").groupBy("lang", "topic").agg(F.sum("mass").alias("mass")).limit(MOST_KINDS + 1).collect()
        if len(kinds) > MOST_KINDS:
            raise ValueError(f"more than {MOST_KINDS} pairs of language and topic")
        self.cells, self.total = cells, sum(r.mass for r in kinds)
        sources, *shares = _default_targets(cells, source_targets, lang_targets, topic_targets)
        values = [sorted({r[d] for r in kinds}) for d in (0, 1)]
        self.want = [np.array([own.get(v, 0.0) for v in by]) for own, by in zip(shares, values, strict=True)]
        at = [{v: i for i, v in enumerate(by)} for by in values]
        # a kind's factor is that of its language times that of its topic
        self.row, self.column = (np.array([at[d][r[d]] for r in kinds]) for d in (0, 1))
        self.factors = [np.ones(len(x)) for x in self.want]
        self.numbers = F.broadcast(local_rows(spark, [(r.lang, r.topic, i) for i, r in enumerate(kinds)], "lang string, topic string, kind int"))
        base = cells.where("mass > 0").join(self.numbers, ["lang", "topic"]).groupBy("source").agg(F.collect_list("kind").alias("kinds"), F.collect_list("mass").alias("masses"))
        self.base = stored(base.join(sources.select(F.col("value").alias("source"), (F.col("share") * self.total).alias("want")), "source"), "sources")

    def fit(self, share: float | None, sweeps: int, tolerance: float) -> None:
        """Rake to the targets, or to ``share`` of them with no cell over 1; starts where the last call ended."""
        scale = self.total * (1.0 if share is None else share)
        want_l, want_t = (x * scale for x in self.want)
        (b, c), still, least, off = self.factors, 0, float("inf"), float("inf")
        for _ in range(max(1, sweeps)):
            free, full = np.zeros((2, len(b), len(c)))
            for r in _solved(self.base, b[self.row] * c[self.column], share, False).groupBy("kind").agg(F.sum("free").alias("free"), F.sum("full").alias("full")).collect():
                free[self.row[r.kind], self.column[r.kind]], full[self.row[r.kind], self.column[r.kind]] = r.free, r.full
            left_l, left_t = np.maximum(0, want_l - full.sum(axis=1)), np.maximum(0, want_t - full.sum(axis=0))
            off = max(np.abs(b * (free @ c) + full.sum(axis=1) - want_l).max(), np.abs(c * (b @ free) + full.sum(axis=0) - want_t).max()) / scale
            still, least = (still + 1, least) if off > 0.98 * least else (0, off)
            if off <= tolerance or still >= STILL:
                break
            for _ in range(INNER):
                before = b
                b = np.divide(left_l, free @ c, out=b.copy() if share else np.zeros_like(b), where=free @ c > 0)
                c = np.divide(left_t, b @ free, out=c.copy() if share else np.zeros_like(c), where=b @ free > 0)
                if np.allclose(before, b, rtol=1e-9, atol=0):
                    break
        self.factors = [b, c]
        if off > tolerance:
            warnings.warn(f"raking ended with a marginal off by {off:.2g} of all tokens", stacklevel=3)

    def weights(self, share: float | None) -> DataFrame:
        """source, lang, topic, weight."""
        b, c = self.factors
        return _solved(self.base, b[self.row] * c[self.column], share, True).join(self.numbers, "kind").select("source", "lang", "topic", "weight")


def _solved(base: DataFrame, factors: np.ndarray, share: float | None, each: bool) -> DataFrame:
    """source, kind, weight with every source's factor solved for the given ones of the kinds; or, not ``each``, by kind
    the sums of mass times source factor of cells that aren't full, and of the mass of full ones."""

    def solve(batches):
        for x in batches:
            kinds, masses = x.column("kinds"), x.column("masses")
            n = np.diff(kinds.offsets.to_numpy())
            kind, mass = kinds.flatten().to_numpy(), masses.flatten().to_numpy()
            of, f, want = np.repeat(np.arange(len(n)), n), factors[kind], x.column("want").to_numpy()
            reach = np.bincount(of, mass * f, len(n))
            own = np.divide(want, reach, out=np.zeros(len(n)), where=reach > 0)
            weight = own[of] * f
            full = np.zeros(len(f), bool)
            if share is not None:
                own = _bounded_factors(of, f, mass, share * want, share * own)
                weight = np.minimum(1.0, own[of] * f)
                full = weight >= 1
            if each:
                yield pa.RecordBatch.from_arrays([x.column("source").take(pa.array(of)), pa.array(kind, pa.int32()), pa.array(weight)], names=["source", "kind", "weight"])
            else:
                sums = [np.bincount(kind, mass * part, len(factors)) for part in (np.where(full, 0.0, own[of]), full)]
                some = np.flatnonzero(sums[0] + sums[1])
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(v[some]) for v in sums)], names=["kind", "free", "full"])

    return base.transform(arrow, solve, "source string, kind int, weight double" if each else "kind int, free double, full double")


def _bounded_factors(of: np.ndarray, f: np.ndarray, mass: np.ndarray, want: np.ndarray, least: np.ndarray) -> np.ndarray:
    """By source the factor x with sum(mass * min(1, x * f)) = want, by bisection; where all is too little, all is full."""
    top = least.copy()
    some = f > 0
    np.maximum.at(top, of[some], 1 / f[some])
    low, high = least, top
    for _ in range(200):  # factors may be many powers of two apart
        middle = (low + high) / 2
        short = np.bincount(of, mass * np.minimum(1.0, middle[of] * f), len(want)) < want
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    return np.where(want > 0, high, 0.0)


def raked(cells: DataFrame, *, source_targets: DataFrame | None = None, lang_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, mass) with weight. IPF with the sources' factors solved where they are."""
    cells = stored(cells, "cells")
    if cells.where("mass > 0").isEmpty():
        return cells.withColumn("weight", F.lit(1.0))
    raking = Raking(cells, source_targets, lang_targets, topic_targets)
    raking.fit(None, sweeps, tolerance)
    return cells.join(raking.weights(None), ["source", "lang", "topic"], "left").fillna(1.0, ["weight"])


def _default_targets(cells: DataFrame, source_targets: DataFrame | None, lang_targets: dict | None, topic_targets: dict | None) -> tuple[DataFrame, dict, dict]:
    """Shares of sources (value, share), languages and topics that add up to 1 over the values with mass."""
    kinds = cells.where("mass > 0").groupBy("lang", "topic").agg(F.sum("mass").alias("mass")).limit(MOST_KINDS + 1).collect()
    by = [{}, {}]
    for r in kinds:
        for own, v in zip(by, (r.lang, r.topic), strict=True):
            own[v] = own.get(v, 0.0) + r.mass
    langs, topics = (_shares(m, given, EXPONENTS[k]) for m, given, k in ((by[0], lang_targets, "lang"), (by[1], topic_targets, "topic")))
    own = cells.groupBy(F.col("source").alias("value")).agg(F.sum("mass").alias("own")).where("own > 0")
    if source_targets is None:
        raw = own.select("value", F.pow("own", F.lit(EXPONENTS["source"])).alias("raw"))
    else:
        raw = own.join(source_targets.select("value", F.col("share").alias("raw")), "value", "left").select("value", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = raw.agg(F.sum("raw").alias("s")).first().s or 1.0
    return raw.select("value", (F.col("raw") / total).alias("share")), langs, topics


def bounded(cells: DataFrame, keep: float, *, source_targets: DataFrame | None = None, lang_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, mass) with weight (raked, unbounded) and probability (raked with its bound of 1)."""
    cells = stored(cells, "cells")
    if cells.where("mass > 0").isEmpty():
        return cells.withColumns({"weight": F.lit(1.0), "probability": F.lit(float(keep))})
    raking, names = Raking(cells, source_targets, lang_targets, topic_targets), ["source", "lang", "topic"]
    raking.fit(None, sweeps, tolerance)
    plain = stored(raking.weights(None), "weights")
    raking.fit(keep, sweeps, tolerance)
    found = plain.join(raking.weights(keep).withColumnRenamed("weight", "probability"), names)
    out = stored(cells.join(found, names, "left").fillna({"weight": 1.0, "probability": float(keep)}), "cells")
    for x in (cells, raking.base, plain):
        drop_stored(x)
    return out


def shortfalls(cells: DataFrame, keep: float, tolerance: float = 1e-3, **targets) -> DataFrame:
    """dimension, value, target, expected (shares of the sample) where ``bounded`` cells (with probability) miss a target."""
    sources, langs, topics = _default_targets(cells, targets.get("source_targets"), targets.get("lang_targets"), targets.get("topic_targets"))
    goal = keep * (cells.agg(F.sum("mass").alias("m")).first().m or 0.0) or 1.0
    expected = lambda name: cells.groupBy(F.col(name).alias("value")).agg((F.sum(F.col("mass") * F.col("probability")) / goal).alias("expected"))
    spark = cells.sparkSession
    wanted = {"source": sources.withColumnRenamed("share", "target"), **{k: local_rows(spark, list(v.items()), "value string, target double") for k, v in (("lang", langs), ("topic", topics))}}
    parts = [wanted[k].join(expected(k), "value").select(F.lit(k).alias("dimension"), "value", "target", "expected") for k in wanted]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.abs(F.col("target") - F.col("expected")) > tolerance)


def mixed(docs: DataFrame, *, source: Column | None = None, lang: Column | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: int = SEED, **targets) -> DataFrame:
    """``docs`` with mix_topic, n_tokens, weight, probability and selected."""
    source = F.col("source") if source is None else source
    lang = F.col("lang") if lang is None else lang
    topic = topic_of(F.col(text_col)) if topic is None else topic
    kept = [c for c in docs.columns if c not in ("mix_topic", "n_tokens", "weight", "probability", "selected")]
    names = fresh(docs, "mix_source", "mix_lang", "cell_topic", "cell_tokens")
    a, b, c, w, q = fresh(docs, "w_source", "w_lang", "w_topic", "cell_weight", "cell_probability")
    rows = _described(docs.select(*kept), source, lang, topic, text_col, names)
    s, k, t, n = names
    cells = rows.groupBy(F.col(s).alias("source"), F.col(k).alias("lang"), F.col(t).alias("topic")).agg(F.sum(n).alias("mass"))
    cells = stored(bounded(cells, keep, **targets), "cells")
    cell, = fresh(rows, "cell")
    number = lambda *c: F.xxhash64(*c, F.lit(3))
    found = cells.select(number("source", "lang", "topic").alias(cell), F.col("source").alias(a), F.col("lang").alias(b), F.col("topic").alias(c), F.col("weight").alias(w), F.col("probability").alias(q))
    rows = rows.withColumn(cell, number(s, k, t))
    out = rows.join(F.broadcast(found), cell) if cells.count() <= FEW_CELLS else salted_join(rows, found, cell, F.struct(id_col, text_col))
    p = F.least(F.lit(1.0), F.col(q))
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return out.select(*(F.col(x) for x in kept), F.col(t).alias("mix_topic"), F.col(n).cast("bigint").alias("n_tokens"), F.col(w).alias("weight"), p.alias("probability"), (draw < p).alias("selected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
