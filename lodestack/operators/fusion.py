"""Reciprocal rank fusion, paging and context assembly."""

from __future__ import annotations

import base64
import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.scoring import RRF

COMPACT = (",", ":")


def ranked(hits: DataFrame, key: str = "id") -> DataFrame:
    """hits (key, score) plus rank from 1. Candidate lists are bounded by candidate_k, so one partition ranks them."""
    return hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc(key))))


def rrf(lexical: DataFrame, vector: DataFrame, k: int = 20, w_lex: float = 1.0, w_vec: float = 1.0, c: float = RRF, key: str = "id") -> DataFrame:
    """(key, lexical_score, vector_score, fused_score, position): full outer join of two candidate lists by rank.

    Ties keep lexical order, then vector order. A missing side scores 0.
    """
    if not (math.isfinite(w_lex) and math.isfinite(w_vec)) or min(w_lex, w_vec) < 0 or w_lex + w_vec == 0 or k < 1:
        raise ValueError("weights are finite, not negative and not both 0; k is positive")
    a = ranked(lexical, key).select(key, F.col("score").alias("lexical_score"), F.col("rank").alias("rl"))
    b = ranked(vector, key).select(key, F.col("score").alias("vector_score"), F.col("rank").alias("rv"))
    both = a.join(b, key, "full_outer")
    fused = F.coalesce(w_lex / (c + F.col("rl")), F.lit(0.0)) + F.coalesce(w_vec / (c + F.col("rv")), F.lit(0.0))
    both = both.withColumn("fused_score", F.round(fused, 9)).withColumn("tie", F.coalesce(F.col("rl"), F.lit(1 << 30) + F.col("rv")))
    both = both.withColumn("position", F.row_number().over(W.orderBy(F.desc("fused_score"), "tie"))).where(F.col("position") <= k)
    return both.select(key, F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "fused_score", "position")


def page(hits: DataFrame, offset: int, limit: int, order: list[Column]) -> DataFrame:
    """One page plus a look-ahead row's answer: ``has_more``."""
    if not 0 <= offset <= 10000 or not 1 <= limit <= 100:
        raise ValueError("offset is 0 to 10000, limit 1 to 100")
    rows = hits.orderBy(*order).offset(offset).limit(limit + 1)
    return rows.withColumn("_n", F.row_number().over(W.orderBy(*order))).withColumn("has_more", F.max("_n").over(W.partitionBy(F.lit(0))) > limit).where(F.col("_n") <= limit).withColumn("position", F.col("_n") + offset).drop("_n")


def request_digest(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, separators=COMPACT, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def encode_cursor(generation: int, digest: str, offset: int) -> str:
    seal = hashlib.sha256(generation.to_bytes(8, "big") + bytes.fromhex(digest) + offset.to_bytes(4, "big")).hexdigest()
    return f"v1.{generation}.{offset}.{seal}"


def decode_cursor(cursor: str, generation: int, digest: str) -> int:
    """The offset; ValueError if the cursor belongs to another generation or request."""
    parts = cursor.split(".")
    if len(parts) != 4 or not parts[2].isdigit() or cursor != encode_cursor(generation, digest, int(parts[2])):
        raise ValueError("the cursor doesn't fit this request")
    return int(parts[2])


def context_fold(hits: DataFrame, max_passages: int = 10, per_document: int = 3, max_bytes: int = 16384) -> DataFrame:
    """One row (context, used_bytes, citations) from ranked hits (rank, passage_id, document_id, text, and any others).

    Walks at most a page of hits in rank order; a passage that is chosen already, whose document is full or that doesn't fit is passed over
    without counting. A citation is a hit's columns with its byte range (start, end) in the context. Hits are bounded by the request's limit, so
    collecting them into one row is safe.
    """
    kept = [c for c in hits.columns if c not in ("rank", "passage_id", "document_id")]
    hit = F.struct("rank", F.col("passage_id").cast("string").alias("passage_id"), F.col("document_id").cast("string").alias("document_id"), *kept)
    item = "struct<i:int,passage_id:string,document_id:string,start:int,end:int>"
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("i"), F.lit("").alias("context"), F.expr(f"cast(array() as array<{item}>)").alias("cites"))

    def step(a: Column, h: Column) -> Column:
        gap = F.when(F.size(a["cites"]) > 0, 2).otherwise(0)
        size = F.octet_length(h["text"])
        fresh = ~F.exists(a["cites"], lambda c: c["passage_id"] == h["passage_id"])
        same = F.size(F.filter(a["cites"], lambda c: c["document_id"] == h["document_id"]))
        fits = (F.size(a["cites"]) < max_passages) & fresh & (same < per_document) & (size + gap <= max_bytes - a["used"])
        cite = F.struct(a["i"].alias("i"), h["passage_id"].alias("passage_id"), h["document_id"].alias("document_id"), (a["used"] + gap).alias("start"), (a["used"] + gap + size).alias("end"))
        return F.struct(
            F.when(fits, a["used"] + gap + size).otherwise(a["used"]).alias("used"),
            (a["i"] + 1).alias("i"),
            F.when(fits, F.concat(a["context"], F.when(gap > 0, "\n\n").otherwise(""), h["text"])).otherwise(a["context"]).alias("context"),
            F.when(fits, F.concat(a["cites"], F.array(cite))).otherwise(a["cites"]).alias("cites"),
        )

    folded = hits.agg(F.array_sort(F.collect_list(hit)).alias("h")).select("h", F.aggregate("h", start, step).alias("f"))
    others = [c for c in kept if c not in ("start", "end")]
    cites = F.transform("f.cites", lambda c: F.struct(c["passage_id"].alias("passage_id"), c["document_id"].alias("document_id"), c["start"].alias("start"), c["end"].alias("end"), *[F.get("h", c["i"])[o].alias(o) for o in others]))
    return folded.select(F.col("f.context").alias("context"), F.col("f.used").alias("used_bytes"), cites.alias("citations"))


def rag_prompt(hits: Column, question: str) -> Column:
    """[n] title, URL and text of every source, then the question."""
    lines = F.transform(hits, lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["title"], F.lit("\nURL: "), h["url"], F.lit("\n"), h["text"]))
    return F.concat(F.array_join(lines, "\n\n"), F.lit(f"\n\nQuestion: {question}"))


def citations_in(answer: Column) -> Column:
    """Distinct cited numbers in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.try_cast(x, "int") if hasattr(F, "try_cast") else x.try_cast("int")))


def citations_valid(answer: Column, sources: Column) -> Column:
    """At least one citation, all of them among 1..sources."""
    cited = citations_in(answer)
    return (F.size(cited) > 0) & F.forall(cited, lambda x: F.coalesce((x >= 1) & (x <= sources), F.lit(False)))


def rag_status(n_sources: Column, answer: Column) -> Column:
    return F.when(n_sources == 0, "no_context").when(answer.isNull(), "unconfigured").when(answer == "", "failed").when(~citations_valid(answer, n_sources), "invalid_citations").otherwise("answered")


def opaque(text: str) -> str:
    """A cursor in URL-safe form."""
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
