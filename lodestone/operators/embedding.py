"""Embedders: native deterministic ones, and the seam for models as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DIMENSIONS, CONTEXT = 384, 256
#: Bytes of text that are summed at once.
PIECE = 1 << 18


def code_points(texts: pa.Array) -> np.ndarray:
    """Sums of the texts' code points, by pieces of ``PIECE`` bytes wherever texts end, so memory grows neither with a batch nor with a text."""
    out = np.zeros(len(texts), np.int64)
    if not len(texts) or texts.null_count == len(texts):
        return out
    wide = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, last = int(ends[0]), int(ends[-1])
    while lo < last:
        hi = min(lo + PIECE, last)
        while hi < last and raw[hi] & 0xC0 == 0x80:
            hi += 1
        part = raw[lo:hi]
        units = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(units, dtype=np.int64)))
        first = np.flatnonzero(part & 0xC0 != 0x80)
        a, b = int(np.searchsorted(ends, lo, "right")) - 1, int(np.searchsorted(ends, hi, "left"))
        out[a:b] += np.diff(total[np.searchsorted(first, np.clip(ends[a : b + 1], lo, hi) - lo)])
        lo = hi
    return out


def code_point_sum(text: Column) -> Column:
    """Sum of the text's code points, by Arrow batches."""

    @F.arrow_udf("bigint")
    def sums(texts: pa.Array) -> pa.Array:
        return pa.array(code_points(texts))

    return F.when(text.isNotNull(), sums(text))


def mock_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """0.1 + ((sum of code points + i) mod 100) / 1000 at i; zeros for the empty text."""
    cycle = F.array(*(F.lit(0.1 + (i % 100) * 0.001) for i in range(100 + dimensions)))
    start = F.pmod(code_point_sum(text), F.lit(100)).cast("int")
    return F.when(text == "", F.array_repeat(F.lit(0.0), dimensions)).otherwise(F.slice(cycle, start + 1, F.lit(dimensions)))


def placeholder_embedding(text: Column, dimensions: int = 768, context: int = CONTEXT) -> Column:
    """0.1 + (bytes mod 100) / 1000 throughout; NULL for the empty text and for more than 4 * context bytes."""
    size = F.octet_length(text)
    return F.when((size > 0) & (size <= 4 * context), F.array_repeat(0.1 + F.pmod(size, F.lit(100)) * 0.001, dimensions))


def embed_single(text: Column, embed: Callable[[Column], Column], dimensions: int = DIMENSIONS) -> Column:
    return F.when(text == "", F.array_repeat(F.lit(0.0), dimensions)).otherwise(embed(text))


def embed_with_options(text: Column, embed: Callable[[Column], Column], max_length: int | None = None, instruction: str | None = None, model: str | None = None) -> Column:
    """Cut to ``max_length`` bytes, then instructed, if the model takes instructions, then embedded."""
    cut = T.cut_bytes(text, max_length) if max_length else text
    return embed(T.instructed(F.lit(instruction), cut) if instruction and model and "qwen3" in model.lower() else cut)


def placeholder_error(text: Column, context: int = CONTEXT) -> Column:
    """Why the placeholder has no vector for a text; null where it has one."""
    return F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, "the text is empty").when(F.octet_length(text) > 4 * context, F.concat(F.lit("the text has "), F.octet_length(text).cast("string"), F.lit(f" bytes, more than {4 * context}")))


def model_udf(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """An Arrow UDF around a model that is loaded once in each worker; ``load`` returns a batch function."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.tolist()))

    return embed


class Registry:
    """Embedders by backend name; an unknown name is an error, never a silent default."""

    def __init__(self):
        self._made: dict[str, Callable[[Column], Column]] = {"mock": mock_embedding, "placeholder": placeholder_embedding}

    def register(self, name: str, embed: Callable[[Column], Column]) -> None:
        self._made[name] = embed

    def get(self, name: str) -> Callable[[Column], Column]:
        if name not in self._made:
            raise KeyError(f"no embedder named {name!r}; there are {sorted(self._made)}")
        return self._made[name]


EMBEDDERS = Registry()


def embedded(rows: DataFrame, embed: Callable[[Column], Column], text: str = "content", name: str = "embedding") -> DataFrame:
    """``rows`` with the embedding as ARRAY<FLOAT>."""
    return rows.withColumn(name, embed(F.col(text)).cast("array<float>"))


def embedded_once(rows: DataFrame, embed: Callable[[Column], Column], text: str = "content", name: str = "embedding") -> DataFrame:
    """Each distinct text is embedded once and joined back; worth it where the model costs more than a shuffle.

    Rows are joined by their text's SHA-256, one vector for each: a common text's rows are split by the adaptive skew join.
    """
    keyed = rows.withColumn("_d", F.sha2(F.col(text).cast("binary"), 256))
    distinct = keyed.groupBy(F.col("_d").alias("_k")).agg(F.first(text).alias("_t"))
    vectors = distinct.select("_k", embed(F.col("_t")).cast("array<float>").alias(name))
    return keyed.join(vectors, F.col("_d").eqNullSafe(F.col("_k")), "left").drop("_d", "_k")


def batch_size_of(average_bytes: Column, base: int, memory_gb: float | None = None) -> Column:
    """Records in a batch by mean text length and memory, 1 to 256 (128 where the memory isn't known)."""
    n = F.when(average_bytes > 1000, base // 2).when(average_bytes < 100, base * 2).otherwise(base)
    most, factor = (128, 1.0) if memory_gb is None else (256, 2.0 if memory_gb >= 16 else 1.5 if memory_gb >= 8 else 0.75)
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(n * factor).cast("int")))


def batch_size(average_bytes: float, base: int, memory_gb: float | None = None) -> int:
    """The same for one number; for Arrow's maxRecordsPerBatch."""
    n = base // 2 if average_bytes > 1000 else base * 2 if average_bytes < 100 else base
    if memory_gb is None:
        return max(1, min(128, n))
    factor = 2.0 if memory_gb >= 16 else 1.5 if memory_gb >= 8 else 0.75
    return max(1, min(256, int(n * factor)))
