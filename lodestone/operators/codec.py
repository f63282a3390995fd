"""Vector codecs by name: none, scalar and product quantisation (``operators.product``), and what they save."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from . import product
from .product import CODEBOOK

BITS, OVERHEAD = 8, 128


def value_range(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: least and greatest component (+inf and -inf of nothing)."""
    v = F.col(vector).cast("array<double>")
    return rows.agg(F.coalesce(F.min(F.array_min(v)), F.lit(float("inf"))).alias("low"), F.coalesce(F.max(F.array_max(v)), F.lit(float("-inf"))).alias("high"))


def scalar_encoded(rows: DataFrame, vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """``rows`` with codes, low and high of the whole relation."""
    return rows.join(F.broadcast(value_range(rows, vector))).withColumn("codes", V.quantized(F.col(vector), F.col("low"), F.col("high"), bits))


def scalar_decoded(rows: DataFrame, bits: int = BITS, name: str = "decoded") -> DataFrame:
    return rows.withColumn(name, V.dequantized(F.col("codes"), F.col("low"), F.col("high"), bits))


#: Codecs by name: "learned" is scalar quantisation under another name.
CODECS = {"none": "none", "scalar": "scalar", "learned": "scalar", "product": "product"}


def _binary(sizes: np.ndarray, raw: bytes, nulls: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.if_else(pa.array(nulls), None, pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)]))


def little_endian(vector: Column) -> Column:
    """The identity codec's bytes: 32-bit floats, least significant byte first."""

    @F.arrow_udf("binary")
    def to_bytes(vectors: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        return _binary(4 * sizes, flat.tobytes(), vectors.is_null().to_numpy(zero_copy_only=False))

    return to_bytes(vector.cast("array<float>"))


def _flat(column: pa.Array) -> tuple[np.ndarray, bytes, np.ndarray]:
    """Sizes, bytes one after another, and which are null, of a binary column."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, b"".join(x or b"" for x in column.to_pylist()), column.is_null().to_numpy(zero_copy_only=False)


def _listed(sizes: np.ndarray, values: np.ndarray, nulls: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.if_else(pa.array(nulls), None, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))


def from_little_endian(codes: Column) -> Column:
    @F.arrow_udf("array<float>")
    def to_floats(raw: pa.Array) -> pa.Array:
        sizes, flat, nulls = _flat(raw)
        return _listed(sizes // 4, np.frombuffer(flat, "<f4").astype(np.float32), nulls)

    return to_floats(codes)


def encoded(rows: DataFrame, codec: str, key: str, vector: str = "embedding", k: int = CODEBOOK) -> tuple[DataFrame, dict]:
    """``rows`` with binary codes in place of the vector, and what decoding needs: codec, dims and a range or a codebook."""
    if codec not in CODECS:
        raise ValueError(f"no codec {codec!r}; there are {sorted(CODECS)}")
    dims = rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).first().d
    kind, about = CODECS[codec], {"codec": CODECS[codec], "dims": dims}
    if kind == "none":
        return rows.withColumn("codes", little_endian(F.col(vector))).drop(vector), about
    if kind == "scalar":
        r = value_range(rows, vector).first()
        out = rows.withColumn("codes", _packed(V.quantized(F.col(vector), r.low, r.high)))
        return out.drop(vector), about | {"low": r.low, "high": r.high}
    book = product.trained(rows, key, vector, k=k)
    return product.encoded(rows, book, vector), about | {"codebook": book}


def decoded(rows: DataFrame, about: dict, name: str = "embedding") -> DataFrame:
    """``rows`` with the vector that the codes stand for."""
    if about["codec"] == "none":
        return rows.withColumn(name, from_little_endian(F.col("codes"))).drop("codes")
    if about["codec"] == "product":
        return product.decoded(rows, about["codebook"], name=name)
    return rows.withColumn(name, V.dequantized(_unpacked(F.col("codes")), about["low"], about["high"]).cast("array<float>")).drop("codes")


def _packed(codes: Column) -> Column:
    """A byte for each code."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return _binary(sizes, lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), lists.is_null().to_numpy(zero_copy_only=False))

    return pack(codes.cast("array<int>"))


def _unpacked(codes: Column) -> Column:
    @F.arrow_udf("array<int>")
    def unpack(raw: pa.Array) -> pa.Array:
        sizes, flat, nulls = _flat(raw)
        return _listed(sizes, np.frombuffer(flat, np.uint8).astype(np.int32), nulls)

    return unpack(codes)


def compression(original: Column, compressed: Column) -> Column:
    """Struct of ratio and percentage saved."""
    return F.struct((original / compressed).alias("ratio"), ((1 - compressed / original) * 100).alias("percent"))
