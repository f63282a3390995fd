"""Vector expressions. Vectors are ARRAY<FLOAT>; sums are taken in DOUBLE."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; NULL elements (unequal lengths) give NULL."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_with(v: Column, query: Sequence[float]) -> Column:
    """Product with a literal vector."""
    return dot(v, F.array(*(F.lit(float(x)) for x in query)).cast("array<double>"))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def _guarded(product: Column, norms: Column, same: Column) -> Column:
    ok = same & _finite(product) & _finite(norms) & (norms > 0)
    return F.when(ok, product / F.when(norms > 0, norms)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, a zero norm or anything that isn't finite; not clamped."""
    return _guarded(dot(a, b), norm(a) * norm(b), F.size(a) == F.size(b))


def cosine_with(v: Column, query: Sequence[float], stored_norm: Column | None = None) -> Column:
    """Cosine to a literal vector; its norm is folded, and the row's may come from a stored column."""
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    own = norm(v) if stored_norm is None else stored_norm
    return _guarded(dot_with(v, query), own * F.lit(size), F.size(v) == F.lit(len(query)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    size = norm(v)
    return F.transform(_double(v), lambda x: F.when(size > 0, x / F.when(size > 0, size)).otherwise(x))


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors (ARRAY<ARRAY>) whose mask is 1; an empty mask gives the zero vector."""
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    weighted = F.zip_with(tokens, mask, lambda t, m: F.transform(t.cast("array<double>"), lambda x: x * m))
    zero = F.transform(F.get(tokens, F.lit(0)).cast("array<double>"), lambda x: x * 0.0)
    total = F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def clamped_score(similarity: Column) -> Column:
    return F.greatest(similarity, F.lit(0.0))


def clamp_threshold(t: float) -> float:
    return max(0.0, min(1.0, t))


def nearest(v: Column, centroids: Column) -> Column:
    """Index of the nearest centroid by squared distance, the first on ties."""
    distances = F.transform(centroids, lambda c: squared_l2(v, c))
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def quantized(v: Column, low: Column | float, high: Column | float, bits: int = 8) -> Column:
    """Codes 0 .. 2^bits - 1 of the values in [low, high]; a range of width 0 gives the top code."""
    levels = float(2**bits - 1)
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    scale = (high - low) / F.lit(levels)
    code = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(levels), F.round((x - low) / F.when(scale != 0, scale))))
    return F.transform(_double(v), lambda x: F.when(scale != 0, code(x)).otherwise(levels).cast("int"))


def dequantized(codes: Column, low: Column | float, high: Column | float, bits: int = 8) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.transform(codes, lambda c: low + c * ((high - low) / F.lit(float(2**bits - 1))))
