"""Scores as column expressions: BM25, BM25F, vector metrics, reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
RRF = 60.0
METRICS = ("cosine", "dot", "l2")


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column, boost: float = 1.0) -> Column:
    """One field. 0 for impossible statistics; an average below or at 0 counts as 1, so does a bad boost or a length of 0."""
    avg = F.when(average > 0, average).otherwise(F.lit(1.0))
    size = F.when(length > 0, length.cast("double")).otherwise(F.lit(1.0))
    weight = boost if boost > 0 else 1.0
    score = idf(n, df) * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / avg))
    return F.when((tf > 0) & (df > 0) & (n > 0) & (df <= n), score).otherwise(F.lit(0.0))


def field_weight(tf: Column, length: Column, average: Column, boost: float) -> Column:
    avg = F.when(average > 0, average).otherwise(F.lit(1.0))
    return F.when(tf > 0, boost * tf / (1 - B + B * length / avg)).otherwise(F.lit(0.0))


def bm25f(weighted: Column, n: Column, df: Column) -> Column:
    """A term's score from its weighted frequency over all fields."""
    return idf(n, df) * weighted * (K1 + 1) / (K1 + weighted)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def vector_score(metric: str, q: Column, c: Column) -> Column:
    """dot; cosine (0 if a norm is 0); l2: minus the squared distance. Sums are doubles."""
    if metric == "dot":
        return dot(q, c)
    if metric == "cosine":
        norm = F.sqrt(dot(q, q)) * F.sqrt(dot(c, c))
        return F.when(norm > 0, dot(q, c) / norm).otherwise(F.lit(0.0))
    if metric == "l2":
        gap = F.zip_with(q, c, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.lit(0.0) - F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"no metric {metric!r}; there are {METRICS}")


def valid_vector(v: Column, dimensions: int) -> Column:
    """Whether a vector has this many finite elements."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4028234663852886e38))
    return v.isNotNull() & (F.size(v) == dimensions) & F.coalesce(finite, F.lit(False))
