"""Product quantisation by matrix products: training, codes of a byte for each slice, and search on the codes.

A vector is cut into slices of ``width`` components (the last is filled with zeros), and each slice is named by its nearest
centroid, the first on ties. Tasks hold the codebook, of at most dims x 256 numbers, and work on whole Arrow batches; a training step hands
on a count and a sum for each slice and centroid, so what is shuffled doesn't grow with the rows.

A search never decodes: for each query of a block a table holds the products of its slices with all centroids, made in the task, and a row's
product is the sum of one entry for each byte; the same with the centroids' squared lengths gives the row's norm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import checkpointed
from .search import LIMIT, asked_queries, best_of_batches, query_blocks

WIDTH, CODEBOOK, ITERATIONS = 8, 256, 10
#: Vectors whose distances to all centroids are held at once.
AT_ONCE = 4096

Codebook = list[list[list[float]]]


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a list column; a null or a vector of another length is an error."""
    sizes = pc.list_value_length(vectors)
    if len(vectors) and (vectors.null_count or pc.min(sizes).as_py() != dims or pc.max(sizes).as_py() != dims):
        raise ValueError(f"a vector isn't of {dims} dimensions")
    return vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def _sliced(x: np.ndarray, width: int) -> np.ndarray:
    """(slices, rows, width)"""
    slices = -(-x.shape[1] // width)
    out = np.zeros((x.shape[0], slices * width))
    out[:, : x.shape[1]] = x
    return out.reshape(x.shape[0], slices, width).transpose(1, 0, 2)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row of ``x``; where products can't tell two apart, differences do, and then the first wins."""
    out = np.empty(len(x), np.int64)
    length = (centroids * centroids).sum(axis=1)
    for lo in range(0, len(x), AT_ONCE):
        part = x[lo : lo + AT_ONCE]
        d = length - 2 * part @ centroids.T
        best = d.argmin(axis=1)
        least = d[np.arange(len(part)), best]
        unsure = (d <= (least + 1e-9 * (1 + np.abs(least) + (part * part).sum(axis=1)))[:, None]).sum(axis=1) > 1
        for i in np.flatnonzero(unsure):
            best[i] = np.square(part[i] - centroids).sum(axis=1).argmin()
        out[lo : lo + AT_ONCE] = best
    return out


def _books(codebook: Codebook, width: int) -> list[np.ndarray]:
    out = []
    for book in codebook:
        b = np.zeros((len(book), width))
        for i, c in enumerate(book):
            b[i, : len(c)] = c
        out.append(b)
    return out


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """key and its place in order: sorted ranges are fixed first, then counted, then numbered within."""
    from pyspark.sql import Window

    ranges = checkpointed(rows.select(key).repartitionByRange(key).withColumn("p", F.spark_partition_id()))
    sizes = ranges.groupBy("p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    within = F.row_number().over(Window.partitionBy("p").orderBy(key)) - 1
    return ranges.join(F.broadcast(sizes.select("p", before.alias("before"))), "p").select(key, (F.col("before") + within).alias("row"))


def first_codebook(rows: DataFrame, key: str, vector: str = "embedding", width: int = WIDTH, k: int = CODEBOOK) -> Codebook:
    """By slice, the slices of rows floor(i * n / k) in order of key; k is at most the number of rows."""
    n = rows.count()
    k = min(k, n)
    if not k:
        return []
    wanted = [i * n // k for i in range(k)]
    chosen = numbered(rows, key).where(F.col("row").isin(wanted))
    found = {r.row: r.v for r in rows.join(F.broadcast(chosen), key).select("row", F.col(vector).cast("array<double>").alias("v")).collect()}  # k rows
    parts = _sliced(np.array([found[w] for w in wanted]), width)
    dims = len(found[wanted[0]])
    return [[row[: min(width, dims - s * width)].tolist() for row in part] for s, part in enumerate(parts)]


def kmeans_sums(rows: DataFrame, codebook: Codebook, vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """sub_id, cluster, n and sums by component, of one assignment of all rows."""
    books, dims = _books(codebook, width), sum(len(b[0]) for b in codebook)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape) for b in books]
        for batch in batches:
            for s, part in enumerate(_sliced(_matrix(batch.column(0), dims), width)):
                at = nearest(part, books[s])
                n[s] += np.bincount(at, minlength=len(books[s]))
                for j in range(width):
                    total[s][:, j] += np.bincount(at, weights=part[:, j], minlength=len(books[s]))
        for s, b in enumerate(books):
            some = np.flatnonzero(n[s])
            columns = {"sub_id": np.full(len(some), s), "cluster": some, "n": n[s][some]} | {f"x{j}": total[s][some, j] for j in range(width)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "sub_id bigint, cluster bigint, n bigint, " + ", ".join(f"x{j} double" for j in range(width))
    return rows.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(sums, schema).groupBy("sub_id", "cluster").agg(F.sum("n").alias("n"), *(F.sum(f"x{j}").alias(f"x{j}") for j in range(width)))


def kmeans_step(rows: DataFrame, codebook: Codebook, vector: str = "embedding", width: int = WIDTH) -> Codebook:
    """All slices' means in one pass; an empty cluster becomes the zero vector."""
    out = [[[0.0] * len(c) for c in book] for book in codebook]
    for r in kmeans_sums(rows, codebook, vector, width).collect():  # at most dims * codebook numbers
        out[r.sub_id][r.cluster] = [r[f"x{j}"] / r.n for j in range(len(out[r.sub_id][r.cluster]))]
    return out


def trained(rows: DataFrame, key: str, vector: str = "embedding", width: int = WIDTH, k: int = CODEBOOK, iterations: int = ITERATIONS) -> Codebook:
    """The codebook after ``iterations`` steps over all rows, each of which reads the vectors again."""
    return reduce(lambda book, _: kmeans_step(rows, book, vector, width), range(iterations), first_codebook(rows, key, vector, width, k))


def encoded(rows: DataFrame, codebook: Codebook, vector: str = "embedding", width: int = WIDTH, name: str = "codes", *, keep_vector: bool = False) -> DataFrame:
    """``rows`` with a byte for each slice in place of the vector."""
    books, dims = _books(codebook, width), sum(len(b[0]) for b in codebook)
    if any(len(b) > 256 for b in books):
        raise ValueError("a byte names at most 256 centroids")
    keep = [c for c in rows.columns if c != name and (keep_vector or c != vector)]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("_vector"), dims)
            codes = np.stack([nearest(part, books[s]) for s, part in enumerate(_sliced(x, width))], axis=1).astype(np.uint8) if books else np.zeros((len(x), 0), np.uint8)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(books))
            raw = pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), raw], [*keep, name])

    types = StructType([*rows.select(keep).schema.fields, *StructType.fromDDL(f"`{name}` binary").fields])
    return rows.select(*keep, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(named, types)


def code_lists(rows: DataFrame, codes: str = "codes") -> DataFrame:
    """``rows`` with the bytes as a list of numbers."""

    @F.arrow_udf("array<int>")
    def numbers(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        flat = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), np.uint8).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return rows.withColumn(codes, numbers(F.col(codes)))


def _bytes(column: pa.Array, slices: int) -> np.ndarray:
    """(rows, slices) of codes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    if len(flat) != len(column) * slices:
        raise ValueError(f"codes aren't of {slices} bytes")
    return flat.reshape(len(column), slices)


def decoded(rows: DataFrame, codebook: Codebook, codes: str = "codes", name: str = "embedding", width: int = WIDTH) -> DataFrame:
    """Centroids put together in place of the codes; a code outside the codebook is an error."""
    books, dims = _books(codebook, width), sum(len(b[0]) for b in codebook)
    keep = [c for c in rows.columns if c not in (codes, name)]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _bytes(batch.column(codes), len(books))
            x = np.concatenate([b[c[:, s]] for s, b in enumerate(books)], axis=1)[:, :dims].astype(np.float32) if books else np.zeros((len(c), 0), np.float32)
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], [*keep, name])

    types = StructType([*rows.select(keep).schema.fields, *StructType.fromDDL(f"`{name}` array<float>").fields])
    return rows.select(*keep, codes).mapInArrow(put, types)


def search(rows: DataFrame, codebook: Codebook, queries: DataFrame, *, query_id: str, query_vector: str, codes: str = "codes", limit: int = LIMIT, threshold: float | None = None, ties: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Top rows by cosine to each of a bounded table of queries, from the codes alone."""
    asked, books = asked_queries(queries, query_id, query_vector), _books(codebook, width)
    dims = sum(len(b[0]) for b in codebook)
    q = np.array([list(v) for _, v in asked], np.float64).reshape(len(asked), -1) if asked else np.zeros((0, dims))
    if len(asked) and q.shape[1] != dims:
        raise ValueError(f"a query isn't of {dims} dimensions")
    with np.errstate(all="ignore"):
        unit = q / np.sqrt((q * q).sum(axis=1))[:, None]
    lengths = [(b * b).sum(axis=1) for b in books]
    shared = rows.sparkSession.sparkContext.broadcast((unit, books, lengths))
    tables: dict[tuple[int, int], list[np.ndarray]] = {}  # of one block

    def score(part: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
        unit, books, n = shared.value
        if (lo, hi) not in tables:
            tables.clear()
            tables[lo, hi] = [b @ own.T for own, b in zip(_sliced(unit[lo:hi], width), books)]  # (centroids, queries) for each slice
        c = _bytes(part.column(codes), len(books))
        found = np.zeros((len(c), hi - lo))
        with np.errstate(all="ignore"):
            for s, t in enumerate(tables[lo, hi]):
                found += t[c[:, s]]
            found /= np.sqrt(sum(n[s][c[:, s]] for s in range(len(n))))[:, None]
        found[~np.isfinite(found)] = 0.0
        return found

    return best_of_batches(rows, score, codes, asked, queries.schema[query_id], limit=limit, threshold=threshold, ties=ties)


def search_all(rows: DataFrame, codebook: Codebook, queries: DataFrame, *, query_id: str, **options) -> DataFrame:
    """``search`` of any number of queries, block by block."""
    return reduce(DataFrame.unionByName, [search(rows, codebook, part, query_id=query_id, **options) for part in query_blocks(queries, query_id)])
