"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Words are runs of characters that aren't ASCII white space. A document fails the base rules with
fewer than ``LEAST_WORDS`` words or with over ``MOST_REPEATED`` per cent of them in 8-word windows that
occur twice or more in its text. The others are points of four transformed statistics:

* the logarithm of the mean word length;
* the root of the share of ``# * $ % & | < >`` among the words' code points;
* the root of repeated lines over lines, with ``FEW_LINES`` added to these;
* the root of words in repeated windows over words, with ``FEW_WORDS`` added to these
  (one repeated line in a short text says little).

Length by itself is no fault, so it isn't among them. Centre and covariance of the points of each
language and source are the minimum-covariance-determinant estimate at share ``SHARE``: from three
starts (medians and scaled median deviations; mean and covariance of squashed scores; mean and
covariance of all rows) concentration steps take the rows of least distance and their mean and covariance
until no determinant falls; the start of least determinant wins and is reweighted once with the rows within
the 0.975 quantile. Covariances are scaled to be consistent for normal data, and the squared ``FLOORS`` are added
to their diagonals, so that a statistic that hardly varies in a source doesn't make outliers of small
differences. A document is rejected if its squared Mahalanobis distance is over ``CUT``, the 1 - 1e-6
quantile of the chi-squared distribution with four degrees.

Languages and sources with fewer than ``LEAST_ROWS`` rows are pooled by language, and what is then still
smaller is pooled altogether; a pool of fewer rows rejects nothing.

Defined results: a null text has no words and fails the base rules. A null language or source counts as an empty one. Repeated
rows count one by one and get the same verdict, as do equal points: ties fall alike. A null id is a row like others. Texts are read whole, whatever their
length. Further columns, whatever their names, don't matter. An empty table gives an empty result.

Scale: texts are read once; what follows works on four small integers for each document (``UNIT``-th parts). Medians
come from counts by value. A concentration step is one job: distances are counted and summed up by bins of their logarithm with partial aggregation, so
a source that holds a third of all rows is as many rows as it has bins; the subset is the bins that first
reach the share. All sums are of integers, so results don't depend on partitions. Estimates are broadcast up to ``SMALL`` units and joined with salts beyond.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, drop_stored, read, salted_join, stored

LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
FEW_LINES, FEW_WORDS = 4, 100
DIMS, UNIT, FLOORS = 4, 1024, (0.05, 0.02, 0.1, 0.1)
SHARE, WITHIN, CUT = 0.75, 11.143, 33.377
LEAST_ROWS, STEPS, SMALL = 50, 15, 8192
#: Bins of a squared distance: so many for each doubling, between these powers of two.
BINS, LOW, HIGH = 16, -12, 24
#: Longest mean word length that is told apart, by its logarithm.
LONGEST = 16.0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words in windows of ``width`` (a power of two) words that occur twice or more; windows are named by halves, exactly."""
    if len(words) <= width:
        return 0
    known: dict[str, int] = {}
    names = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    span = 1
    while span < width:
        _, names = np.unique(names[:-span] * (names.max() + 1) + names[span:], return_inverse=True)
        span *= 2
    twice = np.flatnonzero(np.bincount(names)[names] > 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(ends)))


def counts(text: str) -> tuple[int, ...]:
    """The values of ``_COUNTS``."""
    words = _WORD.findall(text)
    if not words:
        return 0, 0, 0, 0, 0, 0
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t or "") for t in batch.column("text").to_pylist()]
        values = np.array(found, np.int64).reshape(-1, len(_COUNTS)).T
        keep = {c: batch.column(c) for c in ("id", "lang", "source")}
        yield pa.RecordBatch.from_pydict(keep | dict(zip(_COUNTS, values)))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source, the counts, base_failed and x0 to x3, the point in ``UNIT``-th parts (null if the base rules fail)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    rows = docs.select(F.col(id_col).alias("id"), empty(lang_col)("lang"), empty(source_col)("source"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = arrow(rows, _counted, f"id {kind}, lang string, source string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    points = [
        F.least(F.log(F.col("word_chars") / F.col("n_words")), F.lit(LONGEST)), F.sqrt(F.col("n_symbols") / F.col("word_chars")),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + FEW_LINES)), F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + FEW_WORDS)),
    ]
    return rows.withColumn("base_failed", failed).select("*", *(F.when(~F.col("base_failed"), F.round(UNIT * p)).cast("bigint").alias(f"x{i}") for i, p in enumerate(points)))


def units(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source, unit: which estimate each language and source uses; none where too few rows are left."""
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= least_rows, F.xxhash64(F.lit(2), "lang", "source"))
    rest = sizes.where(F.col("n") < least_rows).groupBy("lang").agg(F.sum("n").alias("left"))
    both = sizes.join(rest.hint("merge"), "lang", "left").withColumn("unit", F.coalesce(own, F.when(F.col("left") >= least_rows, F.xxhash64(F.lit(1), "lang"))))
    both = stored(both.select("lang", "source", "n", "unit"), "groups")
    left = both.where("unit is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("left")).first().left
    pool = F.lit(0 if left >= least_rows else None).cast("bigint")
    return both.select("lang", "source", F.coalesce("unit", pool).alias("unit"))


def _consistent(share: float) -> float:
    """What a normal's covariance within its ``share`` of least distances is multiplied with; four degrees."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - math.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    return share / (1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8))


def _estimate(centre: np.ndarray, cov: np.ndarray, scale: float) -> dict:
    """centre, inverse (upper pairs, those off the diagonal doubled) and log determinant."""
    full = scale * cov + np.diag(np.square(FLOORS)) * UNIT**2
    inverse = np.linalg.inv(full)
    return {"centre": [float(c) for c in centre], "inverse": [float(inverse[i, j] * (2 - (i == j))) for i, j in _PAIRS], "det": float(np.linalg.slogdet(full)[1])}


_ESTIMATE = "unit bigint, start int, fell boolean, centre array<double>, inverse array<double>, det double"
_ARROW = pa.schema([("unit", pa.int64()), ("start", pa.int32()), ("fell", pa.bool_()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64())), ("det", pa.float64())])


def _weighted_median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(n[order]), (n.sum() + 1) // 2)])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counts by value of each unit: medians and deviations."""
    for batch in batches:
        out = {"unit": batch.column("unit").to_pylist(), "centre": [], "spread": []}
        for cells in batch.column("cells").to_pylist():
            at = np.array([(c["dim"], c["x"], c["n"]) for c in cells], np.int64)
            middle, spread = [], []
            for d in range(DIMS):
                x, n = at[at[:, 0] == d, 1], at[at[:, 0] == d, 2]
                m = _weighted_median(x, n)
                middle.append(m)
                spread.append(max(1.4826 * _weighted_median(np.abs(x - m), n), FLOORS[d] * UNIT))
            out["centre"].append(middle)
            out["spread"].append(spread)
        yield pa.RecordBatch.from_pydict(out)


def _moments(row: list[dict]) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(r["n"] for r in row)
    s = np.array([sum(r[f"s{i}"] for r in row) for i in range(DIMS)], float) / max(n, 1)
    cov = np.zeros((DIMS, DIMS))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = sum(r[f"s{i}{j}"] for r in row) / max(n, 1) - s[i] * s[j]
    return n, s, cov


def _next(within: float | None) -> callable:
    """The next estimate of each unit and start from its bins: those that first reach the share, or those within a distance; and whether the determinant fell."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, start, centre, before, cells in zip(*(batch.column(c).to_pylist() for c in ("unit", "start", "centre", "det", "cells"))):
                cells.sort(key=lambda c: c["bin"])
                total, seen, k = sum(c["n"] for c in cells), 0, 0
                if within is None:
                    while seen < SHARE * total:
                        seen += cells[k]["n"]
                        k += 1
                else:
                    k = max(1, sum(c["bin"] <= math.floor(BINS * math.log2(within)) for c in cells))
                n, moved, cov = _moments(cells[:k])
                made = _estimate(np.rint(centre) + moved, cov, _consistent(min(n / total, 0.975)))
                out.append({"unit": unit, "start": start, "fell": made["det"] < before - 1e-6} | made)
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return step


def _plain(squashed: bool) -> callable:
    """The starting estimate from sums over all rows of a unit, of scores or of squashed scores."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, centre, spread, cell in zip(*(batch.column(c).to_pylist() for c in ("unit", "centre", "spread", "cell"))):
                _, mean, cov = _moments([cell])
                scale = np.array(spread) / UNIT if squashed else np.ones(DIMS)
                out.append({"unit": unit, "start": 1 if squashed else 2, "fell": True} | _estimate(np.rint(centre) + mean * scale, cov * np.outer(scale, scale), 1.0))
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return start


def _with(rows: DataFrame, small: DataFrame, n: int, by: Column) -> DataFrame:
    """``rows`` with what ``small`` says of their unit."""
    return rows.join(F.broadcast(small), "unit") if n <= SMALL else salted_join(rows, small, "unit", by)


def _distance(centre: str = "centre", inverse: str = "inverse") -> Column:
    """The squared distance of x0 to x3, in codegen: no arrays are walked."""
    off = [F.col(f"x{i}") - F.get(centre, F.lit(i)) for i in range(DIMS)]
    return sum((F.get(inverse, F.lit(k)) * off[i] * off[j] for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def _sums(values: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(values)), *(F.sum(values[i] * values[j]).alias(f"s{i}{j}") for i, j in _PAIRS)]


def fitted(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """unit, centre, inverse, det; ``rows``: unit, x0 to x3, none null."""
    n = rows.select("unit").distinct().count()
    names = [f"x{i}" for i in range(DIMS)]
    by = F.struct(*names)
    values = rows.select("unit", F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(x).alias("x")) for i, x in enumerate(names)))).alias("v")).select("unit", "v.dim", "v.x")
    cells = values.groupBy("unit", "dim", "x").agg(F.count("*").alias("n")).groupBy("unit").agg(F.collect_list(F.struct("dim", "x", "n")).alias("cells"))
    first = stored(arrow(cells, _first, "unit bigint, centre array<double>, spread array<double>"), "medians")
    joined = _with(rows, first, n, by)
    off = [(F.col(x) - F.round(F.get("centre", F.lit(i)))).cast("bigint") for i, x in enumerate(names)]
    squashed = [F.round(UNIT * F.tanh(o / F.get("spread", F.lit(i)))).cast("bigint") for i, o in enumerate(off)]
    begin = []
    for kind, of in ((True, squashed), (False, off)):
        totals = joined.select("unit", *(o.alias(f"o{i}") for i, o in enumerate(of))).groupBy("unit").agg(*_sums([F.col(f"o{i}") for i in range(DIMS)]))
        cell = first.join(totals.hint("merge"), "unit").select("unit", "centre", "spread", F.struct(*(c for c in totals.columns if c != "unit")).alias("cell"))
        begin.append(arrow(cell, _plain(kind), _ESTIMATE))
    median = first.select("unit", F.lit(0).alias("start"), F.lit(True).alias("fell"), "centre", F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _PAIRS)), lambda p: F.when(p["i"] == p["j"], 1 / F.pow(F.get("spread", p["i"]), 2)).otherwise(0.0)).alias("inverse"), F.lit(float("inf")).alias("det"))
    now = stored(median.unionByName(begin[0]).unionByName(begin[1]), "starts")

    def stepped(now: DataFrame, within: float | None) -> DataFrame:
        each = now.groupBy("unit").agg(F.collect_list(F.struct("start", "centre", "inverse")).alias("e"))
        placed = _with(rows, each, n, by).select("unit", *names, F.explode("e").alias("e")).select("unit", *names, "e.start", "e.centre", "e.inverse")
        d = F.greatest(_distance(), F.lit(2.0**LOW))
        placed = placed.select("unit", "start", F.least(F.floor(BINS * F.log2(d)), F.lit(BINS * HIGH)).cast("int").alias("bin"), *((F.col(x) - F.rint(F.get("centre", F.lit(i)))).cast("bigint").alias(f"o{i}") for i, x in enumerate(names)))
        bins = placed.groupBy("unit", "start", "bin").agg(*_sums([F.col(f"o{i}") for i in range(DIMS)]))
        cells = bins.groupBy("unit", "start").agg(F.collect_list(F.struct("bin", *(c for c in bins.columns if c not in ("unit", "start", "bin")))).alias("cells"))
        return stored(arrow(cells.join(now.select("unit", "start", "centre", "det").hint("merge"), ["unit", "start"]), _next(within), _ESTIMATE), "estimates")

    for _ in range(steps):
        after = stepped(now, None)
        done = after.where("fell").isEmpty()
        drop_stored(now)
        now = after
        if done:
            break
    best = now.groupBy("unit").agg(F.min(F.struct("det", "start", "centre", "inverse")).alias("b")).select("unit", "b.*")
    out = stepped(stored(best.select("unit", "start", "centre", "inverse", "det"), "best"), WITHIN)
    for x in (first, now):
        drop_stored(x)
    return out.drop("start", "fell")


def judged(docs: DataFrame, *, cut: float = CUT, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the squared distance (null where there is none)."""
    bounded_batches(docs.sparkSession)
    rows = stored(statistics(docs, id_col=id_col, **columns), "statistics")
    passed = rows.where("not base_failed")
    groups = units(passed, least_rows)
    n = groups.count()
    key = F.xxhash64("lang", "source")
    named = groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "unit").where("unit is not null")
    place = lambda df: df.join(F.broadcast(named), (df["lang"] == named["l"]) & (df["source"] == named["s"]), "left").drop("l", "s") if n <= SMALL else salted_join(df.withColumn("g", key), named.select(F.xxhash64("l", "s").alias("g"), "unit"), "g", F.struct("id", "x0"), "left").drop("g")
    points = stored(place(passed).where("unit is not null").select("unit", *(f"x{i}" for i in range(DIMS))), "points")
    model = fitted(points)
    best = model.select("unit", "centre", "inverse")
    placed = place(rows)
    told = placed.join(F.broadcast(best), "unit", "left") if n <= SMALL else salted_join(placed, best, "unit", F.struct("id", "x0"), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    out = told.select(F.col("id").alias(id_col), *_COUNTS[:5], "base_failed", distance.alias("distance"))
    drop_stored(points)
    return out.select(id_col, *_COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"))
