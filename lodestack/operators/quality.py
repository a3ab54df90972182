"""Search quality and service health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS_MS = (5, 10, 25, 50, 100, 200, 500, 1000)


def ranking_quality(hits: DataFrame, judgments: DataFrame, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """Per query: ndcg, recall, mrr at k. hits (query, key, rank from 1), judgments (query, key, relevance).

    A document counts once, at its first rank; later hits keep theirs. Queries without a relevant judgment give no row.
    """
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    w = W.partitionBy(query).orderBy(F.desc("relevance"), key)
    ideal = judgments.withColumn("_r", F.row_number().over(w)).groupBy(query).agg(
        F.sum(F.when(F.col("_r") <= k, gain / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias("idcg"), F.sum((F.col("relevance") > 0).cast("int")).alias("relevant")
    )
    first = hits.where(F.col("rank") <= k).groupBy(query, key).agg(F.min("rank").alias("rank"))
    found = first.join(judgments.where("relevance > 0"), [query, key]).groupBy(query).agg(F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("best"))
    out = ideal.where("relevant > 0").join(found, query, "left")
    return out.select(query, F.round(F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("best"), F.lit(0.0)), 6).alias("mrr"))


def latency_histogram(samples: DataFrame, value: str = "ms", by: str = "op") -> DataFrame:
    """Per operation: cumulative counts at the bucket bounds, +Inf, count."""
    aggs = [F.sum((F.col(value) <= b).cast("long")).alias(f"le_{b}") for b in BUCKETS_MS]
    return samples.groupBy(by).agg(*aggs, F.count(value).alias("le_inf"), F.round(F.sum(value), 3).alias("sum_ms"))


def percentiles(samples: DataFrame, value: str = "ms", by: str = "op", at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles."""
    return samples.groupBy(by).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(p * 100)}") for p in at])


def segment_health(segments: DataFrame, small: int) -> DataFrame:
    return segments.agg(
        F.count("*").alias("segments"), F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"), F.sum((F.col("bytes") < small).cast("long")).alias("small_segments")
    )


def render_metrics(health: DataFrame, latency: DataFrame, prefix: str = "lodestack") -> str:
    """Text exposition of segment_health (one row) and latency_histogram (a row per operation)."""
    lines = [f"{prefix}_{k} {v}" for k, v in health.first().asDict().items()]
    for r in latency.orderBy("op").collect():
        lines += [f'{prefix}_request_ms_bucket{{op="{r.op}",le="{b}"}} {r[f"le_{b}"]}' for b in BUCKETS_MS]
        lines += [f'{prefix}_request_ms_bucket{{op="{r.op}",le="+Inf"}} {r.le_inf}', f'{prefix}_request_ms_count{{op="{r.op}"}} {r.le_inf}', f'{prefix}_request_ms_sum{{op="{r.op}"}} {r.sum_ms}']
    return "\n".join(lines) + "\n"
