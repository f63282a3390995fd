"""Exact cosine search.

A single query is a literal: rows are filtered, scored and cut by a
TakeOrderedAndProject, without a shuffle of the rows. Many queries are a
matrix, checked against ``MOST_QUERIES``, that batches of vectors are multiplied
with; each task keeps its own k for a query and a ranked window merges them.
``search_all`` takes any number of queries in blocks of that size. Ties are broken by path and
chunk index. Only ids and paths are carried until the limit; text is joined to
the few rows that are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import glob as G
from ..functions import vector as V

LIMIT, MOST_QUERIES, MOST_QUERY_BYTES, DIGITS = 10, 10_000, 1000, 12
MOST_RESULTS = 10_000
#: Similarities and queries that a task handles at once.
SCORED_AT_ONCE, QUERIES_AT_ONCE = 1_000_000, 512



def validate_query(text: str) -> str:
    """The trimmed query; ValueError if it is empty or longer than 1000 bytes."""
    out = text.strip()
    if not out:
        raise ValueError("the query is empty")
    if len(out.encode()) > MOST_QUERY_BYTES:
        raise ValueError(f"the query is longer than {MOST_QUERY_BYTES} bytes")
    return out


@dataclass(frozen=True)
class SearchRequest:
    limit: int = LIMIT
    threshold: float | None = None
    filetype: str | None = None
    glob: str | None = None

    def with_threshold(self, t: float) -> SearchRequest:
        return SearchRequest(self.limit, V.clamp_threshold(t), self.filetype, self.glob)

    def validate(self) -> SearchRequest:
        if self.limit < 1:
            raise ValueError("the limit must be at least 1")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must be from 0 to 1")
        if self.filetype is not None:
            G.normalize_extension(self.filetype)
        if self.glob is not None:
            G.validate_glob(self.glob)
        return self


def ranked(scored: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows of greatest raw similarity with rank from 0; the similarity shown is not negative."""
    top = scored.orderBy(F.desc("similarity"), *map(F.asc, ties)).limit(limit)
    order = Window.orderBy(F.desc("similarity"), *map(F.asc, ties))  # over at most ``limit`` rows
    return top.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).withColumn("similarity", V.clamped_score(F.col("similarity")))


def search(index: DataFrame, query: Sequence[float], request: SearchRequest = SearchRequest(), *, vector: str = "embedding", path: str | None = None, ties: Sequence[str] = (), norm: str | None = None) -> DataFrame:
    """Top rows with similarity and rank; extension and glob are tested before scoring.

    An empty or non-finite query, and a limit of 0, give no rows.
    """
    if not len(query) or request.limit < 1 or not all(math.isfinite(x) for x in query):
        return index.limit(0).withColumns({"similarity": F.lit(0.0), "rank": F.lit(0).cast("bigint")}).drop(vector)
    rows = index
    if path and request.filetype is not None:
        rows = rows.where(G.has_extension(F.col(path), request.filetype))
    if path and request.glob is not None:
        rows = rows.where(G.matches(F.col(path), request.glob))
    score = _by_norms(query, vector, norm) if norm else _scorer({len(query): (np.zeros(1, np.int64), _units([query]))}, vector)
    keep = [c for c in rows.columns if c != vector]
    best = _best_of_tasks(rows, score, [vector], keep, 1, request.limit, request.threshold, ties, DIGITS)
    return ranked(best.drop("query_number"), request.limit, *ties)


def filter_results(results: DataFrame, *, path: str, glob: str | None = None, ext: str | None = None) -> DataFrame:
    """Glob, then extension, after the limit; ranks stay, so they may have gaps."""
    if glob is not None:
        results = results.where(G.matches_validated(F.col(path), glob))
    if ext is not None:
        results = results.where(G.has_extension_any_case(F.col(path), ext))
    return results


def _best(table: pa.Table, query: np.ndarray, score: np.ndarray, ties: Sequence[str], limit: int) -> np.ndarray:
    """Places of each query's ``limit`` best rows, by falling score, then by the tie columns as Spark orders them."""
    order = pc.sort_indices(table, [(t, "ascending") for t in ties], null_placement="at_start").to_numpy() if ties else np.arange(len(query))
    place = np.empty(len(query), np.int64)
    place[order] = np.arange(len(query))
    by = np.lexsort((place, -score, query))
    q = query[by]
    return by[np.arange(len(q)) - np.searchsorted(q, q) < limit]


def _similarities(vectors: pa.Array, matrices: dict[int, tuple[np.ndarray, np.ndarray]], lo: int, hi: int) -> np.ndarray:
    """(rows, queries lo to hi) cosines; 0 for unequal lengths, a zero norm or anything that isn't finite."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), hi - lo))
    for size, (who, unit) in matrices.items():
        some = slice(*np.searchsorted(who, [lo, hi]))
        who, unit = who[some] - lo, unit[some]
        rows = np.flatnonzero(sizes == size)
        if len(rows) and size and len(who):
            own = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)
            with np.errstate(all="ignore"):
                found = own @ unit.T / np.sqrt((own * own).sum(axis=1))[:, None]
            out[np.ix_(rows, who)] = np.where(np.isfinite(found), found, 0.0)
    return out


def asked_queries(queries: DataFrame, query_id: str, query_vector: str) -> list[tuple]:
    """(id, vector) of a table of queries of checked size."""
    asked = queries.select(F.col(query_id), F.col(query_vector)).limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once")
    return [tuple(r) for r in asked]


def _best_of_tasks(index: DataFrame, score: Callable[[pa.RecordBatch, int, int], np.ndarray], scored: list[str], keep: list[str], n_queries: int, limit: int, threshold: float | None, ties: Sequence[str], digits: int) -> DataFrame:
    """``keep``, query_number and similarity: each task's ``limit`` best rows for each query, whatever it has read; ``score`` gives
    (rows, queries lo to hi) of a batch that has ``keep`` and ``scored``, for a block of queries at a time."""
    ties, at_once = list(ties), QUERIES_AT_ONCE

    def nearest(batches):
        blocks = [(lo, min(lo + at_once, n_queries)) for lo in range(0, n_queries, at_once)]
        best_of: list[list[tuple[pa.Table, np.ndarray, np.ndarray]]] = [[] for _ in blocks]

        def pruned(held):
            table, query, score = pa.concat_tables([t for t, _, _ in held]), *(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            best = _best(table, query, score, ties, limit)
            return table.take(pa.array(best)), query[best], score[best]

        for b in batches:
            for (lo, hi), held in zip(blocks, best_of, strict=True):
                step = max(1, SCORED_AT_ONCE // (hi - lo))
                for first in range(0, b.num_rows, step):
                    part = b.slice(first, step)
                    s = np.round(score(part, lo, hi), digits)
                    least = np.partition(s, len(s) - limit, axis=0)[len(s) - limit] if len(s) > limit else np.full(hi - lo, -np.inf)
                    if threshold is not None:
                        least = np.maximum(least, threshold)
                    row, query = np.nonzero(s >= least)
                    held.append((pa.Table.from_batches([part]).select(keep).take(pa.array(row)), lo + query, s[row, query]))
                    held[:] = [pruned(held)]
        for table, query, found in (x for held in best_of for x in held):
            for batch in table.append_column("query_number", pa.array(query.astype(np.int32))).append_column("similarity", pa.array(found)).combine_chunks().to_batches():
                yield batch

    types = StructType([*index.select(keep).schema.fields, *StructType.fromDDL("query_number int, similarity double").fields])
    return index.select(*keep, *(c for c in scored if c not in keep)).mapInArrow(nearest, types)


def best_of_batches(index: DataFrame, score: Callable[[pa.RecordBatch, int, int], np.ndarray], scored: str, asked: list[tuple], id_field: StructField, *, limit: int, threshold: float | None, ties: Sequence[str], digits: int = DIGITS) -> DataFrame:
    """The best rows for each query, where ``score`` gives (rows, queries lo to hi) of a batch; the column ``scored`` is for it alone.

    A task hands on ``limit`` rows for each query, whatever it has read. Similarities are compared at ``digits`` decimals.
    """
    best = _best_of_tasks(index, score, [scored], [c for c in index.columns if c != scored], len(asked), limit, threshold, ties, digits)
    order = Window.partitionBy("query_number").orderBy(F.desc("similarity"), *map(F.asc, ties))
    top = best.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("rank") < limit)
    names = index.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(asked)], StructType([*StructType.fromDDL("query_number int").fields, id_field]))
    return top.join(F.broadcast(names), "query_number").drop("query_number").withColumn("similarity", V.clamped_score(F.col("similarity")))


def _units(vectors: Sequence[Sequence[float]]) -> np.ndarray:
    own = np.array([list(v) for v in vectors], np.float64).reshape(len(vectors), -1)
    with np.errstate(all="ignore"):
        return own / np.sqrt((own * own).sum(axis=1))[:, None]


def _scorer(matrices: dict[int, tuple[np.ndarray, np.ndarray]], vector: str) -> Callable[[pa.RecordBatch, int, int], np.ndarray]:
    return lambda part, lo, hi: _similarities(part.column(vector), matrices, lo, hi)


def _by_norms(query: Sequence[float], vector: str, norm: str) -> Callable[[pa.RecordBatch, int, int], np.ndarray]:
    """Scores of one query by the rows' stored norms: a product with the query and a division."""
    unit = _units([query])[0]

    def score(part: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
        vectors, out = part.column(vector), np.zeros((part.num_rows, 1))
        rows = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False) == len(unit))
        norms = pc.fill_null(part.column(norm), 0.0).to_numpy(zero_copy_only=False)[rows]
        own = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), len(unit))
        with np.errstate(all="ignore"):
            found = own @ unit / norms
        out[rows, 0] = np.where(np.isfinite(found), found, 0.0)
        return out

    return score


def search_many(index: DataFrame, queries: DataFrame, *, query_id: str, query_vector: str, vector: str = "embedding", limit: int = LIMIT, threshold: float | None = None, ties: Sequence[str] = (), digits: int = DIGITS) -> DataFrame:
    """Top rows for each of a bounded table of queries, by products of each batch of vectors with the matrix of queries."""
    asked = asked_queries(queries, query_id, query_vector)
    matrices: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(v or ()) for _, v in asked}:
        who = [i for i, (_, v) in enumerate(asked) if len(v or ()) == size]
        matrices[size] = np.array(who), _units([asked[i][1] or () for i in who])
    shared = index.sparkSession.sparkContext.broadcast(matrices)
    score = lambda part, lo, hi: _similarities(part.column(vector), shared.value, lo, hi)
    return best_of_batches(index, score, vector, asked, queries.schema[query_id], limit=limit, threshold=threshold, ties=ties, digits=digits)


def query_blocks(queries: DataFrame, query_id: str) -> list[DataFrame]:
    """Any number of queries as tables of at most ``MOST_QUERIES``; a query's rows, if its id is repeated, share a block."""
    n, blocks = queries.count(), 1
    sizes = [n]
    while max(sizes) > MOST_QUERIES:
        blocks = max(blocks + 1, -(-11 * n // (10 * MOST_QUERIES)), blocks * 5 // 4)
        sizes = [r["count"] for r in queries.groupBy(F.pmod(F.xxhash64(query_id), F.lit(blocks))).count().collect()]
        if len(sizes) < blocks // 8:
            raise ValueError(f"more than {MOST_QUERIES} queries share an id")
    return [queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [queries]


def search_all(index: DataFrame, queries: DataFrame, *, query_id: str, **options) -> DataFrame:
    """``search_many`` of any number of queries, block by block."""
    return reduce(DataFrame.unionByName, [search_many(index, part, query_id=query_id, **options) for part in query_blocks(queries, query_id)])


def search_text(index: DataFrame, text: str, embed: Callable[[Column], Column], request: SearchRequest = SearchRequest(), **options) -> DataFrame:
    """Validates and embeds one query, then searches."""
    row = index.sparkSession.range(1).select(embed(F.lit(validate_query(text))).cast("array<double>").alias("q")).first()
    return search(index, row.q, request, **options)


def rehydrated(results: DataFrame, files: DataFrame, *, path: str = "file_path", text: str = "text") -> DataFrame:
    """Results with ``content`` cut from the file's text by code points; rows without a file keep theirs.

    Results are sent to the files where there are at most ``MOST_RESULTS``; more are joined by path.
    """
    own = files.select(F.col(path).alias("_p"), F.col(text).alias("_t"))
    cut = F.substring(F.col("_t"), F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    few = results.limit(MOST_RESULTS + 1).count() <= MOST_RESULTS
    joined = own.join(F.broadcast(results) if few else results, F.col("_p") == F.col(path), "right")
    return joined.withColumn("content", F.coalesce(cut, F.col("content")) if "content" in results.columns else cut).drop("_p", "_t")


def chunks_of(index: DataFrame, paths: DataFrame, *, path: str = "file_path") -> DataFrame:
    """The index's chunks of some files (column path)."""
    return index.join(paths.select(F.col(paths.columns[0]).alias(path)).distinct(), path, "left_semi")
