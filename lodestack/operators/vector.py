"""Vector search of one query: exact top-k and the best passage per document. Batches and approximate search are in ``ann``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scoring import vector_score


def literal(vector: list[float]) -> Column:
    """A query vector as a constant array."""
    return F.array(*[F.lit(float(x)) for x in vector])


def score_vectors(vectors: DataFrame, query: DataFrame, metric: str, vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """vectors plus score against the one-row ``query`` (column q). The filter runs before scoring, so nothing is fetched in excess."""
    v = vectors if where is None else vectors.where(where)
    return v.crossJoin(F.broadcast(query.limit(1))).withColumn("score", F.round(vector_score(metric, F.col("q"), F.col(vector)), 6)).drop("q")  # one row


def nearest(vectors: DataFrame, query: DataFrame, metric: str, k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    return score_vectors(vectors, query, metric, vector, where).select(key, "score").orderBy(F.desc("score"), F.asc(key)).limit(k)


def best_per_document(scored: DataFrame, parent: Column, k: int) -> DataFrame:
    """(document_id, score): the largest passage score of each parent."""
    return scored.groupBy(parent.alias("document_id")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "document_id").limit(k)
