"""What each filter of a chain removes, for every order of the filters, from one pass over the texts.

A text's outcome is a mask of the five filters it fails: bit i for the i-th letter.

* A: under ``MIN_WORDS`` words;
* B: distinct words are under ``MIN_DISTINCT`` per cent of its words;
* C: over ``MAX_CAPITALS`` per cent of its code points are A to Z;
* D: it holds one of ``# $ % & * |``;
* E: a row of a smaller id has the same text, whether that one is removed or not.

Masks are counted by part (``lang``): all documents, those labelled good and those
labelled toxic. The three histograms of each part are rows of a matrix with 32 columns, and
its products with four integer matrices of 32 x 600 (an order and a step for each
column) are the documents kept, removed, redundantly failing and failing nothing
else. A filter's Shapley count is its removals summed over all orders.

Defined results: a null text is empty, a null part is the empty string. A null id
has no label, is no smaller than another and has no smaller one. Repeated rows
count one by one; rows of the least id are all first ones. A document is good
(toxic) if any of its label rows says 1; a null label says nothing. Very long texts are judged
whole. Further columns, whatever their names, don't matter. An empty table has no parts and gives
no rows.

Scale: the texts are read once; what is shuffled is an id, a mask and a digest for each document. The least id
of a text is found with partial aggregation, and only texts that repeat are looked
up, by a salted join, so copies of one text are dealt to many tasks. After the
histograms (32 rows at most for a part) work depends on the number of parts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, read, salted_join, stored

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, MASKS = len(FILTERS), 1 << len(FILTERS)
_BLANK = "\t\n\x0b\f\r "
_RESULT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
#: Parts whose products are made at once: 600 rows each.
SLICE = 64


def outcomes() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique: 32 x 600 matrices of 0 and 1; and by_filter: 600 x 5, which sums columns by their filter."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    own = fails[:, at]  # mask x order x step
    before = np.concatenate([np.zeros((MASKS, len(ORDERS), 1), np.int64), np.maximum.accumulate(own, axis=2)[:, :, :-1]], axis=2)
    alone = (own == 1) & (fails.sum(axis=1) == 1)[:, None, None]
    flat = lambda x: np.ascontiguousarray(x.reshape(MASKS, -1), dtype=np.int64)
    return {
        "kept": flat((before == 0) & (own == 0)), "removed": flat((before == 0) & (own == 1)), "redundant": flat((before == 1) & (own == 1)), "unique": flat(alone),
        "by_filter": (at.reshape(-1)[:, None] == np.arange(STEPS)).astype(np.int64),
    }


def audit(parts: np.ndarray) -> dict[str, np.ndarray]:
    """``parts``: part x 3 x 32 counts (all, good, toxic). Each result is part x 600."""
    m = outcomes()
    every, good, toxic = parts[:, 0], parts[:, 1], parts[:, 2]
    removed = every @ m["removed"]
    return {
        "kept": every @ m["kept"], "removed": removed, "redundant": every @ m["redundant"], "unique_fails": every @ m["unique"],
        "good_lost": good @ m["removed"], "toxic_lost": toxic @ m["removed"], "shapley": removed @ m["by_filter"] @ m["by_filter"].T,
    }


def mask(text: Column) -> Column:
    """The bits of A to D; ``text`` isn't null."""
    words = F.filter(F.split(F.btrim(text, F.lit(_BLANK)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * F.char_length(text), text.rlike(r"[#$%&*|]")]
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return (bits[0] + bits[1] + bits[2] + bits[3]).cast("int")


def histograms(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), mask(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = stored(rows, "masks")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = salted_join(rows, first, "digest", F.col("id"), "left").withColumn("mask", F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.select("id", "part", "mask").join(said.hint("merge"), "id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = [o for o in ORDERS for _ in range(STEPS)]
    step = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
    for batch in batches:
        names, cells = batch.column("part").to_pylist(), batch.column("cells").to_pylist()
        for lo in range(0, len(names), SLICE):
            part = names[lo : lo + SLICE]
            counts = np.zeros((len(part), 3, MASKS), np.int64)
            for i, row in enumerate(cells[lo : lo + SLICE]):
                for c in row:
                    counts[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            columns = {"part": np.repeat(np.array(part, object), len(order)), "filter_order": order * len(part), "step": np.tile(step, len(part))}
            yield pa.RecordBatch.from_pydict(columns | {k: v.reshape(-1) for k, v in audit(counts).items()})


def audited(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells = histograms(docs, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return arrow(cells, _products, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > first, FALSE)] AS f
      FROM w LEFT JOIN y ON y.doc_id = w.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS own FROM o, l),
r AS (SELECT part, o, step, own, n, good, toxic, f[own] AS fails, len(list_filter(o[:step - 1], lambda x: f[x])) > 0 AS before, len(list_filter(f, lambda x: x)) = 1 AS alone FROM s, c),
z AS (SELECT part, array_to_string(list_transform(o, lambda x: chr(CAST(64 + x AS INTEGER))), '') AS filter_order, step, own,
      sum(n) FILTER (NOT before AND NOT fails) AS kept, sum(n) FILTER (NOT before AND fails) AS removed, sum(n) FILTER (before AND fails) AS redundant, sum(n) FILTER (fails AND alone) AS unique_fails,
      sum(good) FILTER (NOT before AND fails) AS good_lost, sum(toxic) FILTER (NOT before AND fails) AS toxic_lost FROM r GROUP BY part, o, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM z
"""
