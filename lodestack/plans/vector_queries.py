"""Queries: vectors, fusion, passages, retrieval, quality."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.scoring import valid_vector
from lodestack.functions.text import CHUNK_FIELDS, query_tokens, sentence_passages
from lodestack.operators import ann, fusion, lexical, quality, vector
from lodestack.plans.lexical_queries import Q, _PASSAGE_SQL
from lodestack.plans.tables import PASS, bm25f_sql, corpus, passages, query, read, stored_index
from lodestack.sources.ingest import attach_embeddings, embedding_problems, segment_violations

_QV = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_DOT = "list_reduce(list_transform(list_zip(q, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE), lambda a, x: a + x, 0e0)"
_SELF = "list_reduce(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE), lambda a, x: a + x, 0e0)"
_SCORE = {
    "dot": _DOT,
    "cosine": f"CASE WHEN sqrt({_SELF.format('q')}) * sqrt({_SELF.format('embedding')}) > 0 THEN {_DOT} / (sqrt({_SELF.format('q')}) * sqrt({_SELF.format('embedding')})) ELSE 0e0 END",
    "l2": "0e0 - list_reduce(list_transform(list_zip(q, embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)), lambda a, x: a + x, 0e0)",
}


def query_vector(s, d):
    return read(s, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


def _vectors(s, d):
    return read(s, d, "embeddings").withColumn("document_id", F.col("vec_id") % 100)


for _m in ("dot", "cosine", "l2"):
    query(f"vector_{_m}", f"WITH {_QV} SELECT vec_id, round({_SCORE[_m]}, 6) AS score FROM embeddings, q")(lambda s, d, m=_m: vector.score_vectors(_vectors(s, d), query_vector(s, d), m).select("vec_id", "score"))
    query(f"vector_topk_{_m}", f"WITH {_QV} SELECT vec_id, round({_SCORE[_m]}, 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20")(lambda s, d, m=_m: vector.nearest(_vectors(s, d), query_vector(s, d), m, 20))


@query("vector_max_per_document", f"WITH {_QV} SELECT vec_id % 100 AS document_id, max(round({_SCORE['cosine']}, 6)) AS score FROM embeddings, q GROUP BY 1 ORDER BY score DESC, document_id LIMIT 20")
def vector_max_per_document(s, d):
    return vector.best_per_document(vector.score_vectors(_vectors(s, d), query_vector(s, d), "cosine"), F.col("document_id"), 20)


@query("vector_filtered_topk", f"WITH {_QV} SELECT vec_id, round({_SCORE['cosine']}, 6) AS score FROM embeddings, q WHERE label % 2 = 1 ORDER BY score DESC, vec_id LIMIT 20")
def vector_filtered_topk(s, d):
    return vector.nearest(_vectors(s, d), query_vector(s, d), "cosine", 20, where=F.col("label") % 2 == 1)


@query("vector_validate", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AS valid FROM embeddings")
def vector_validate(s, d):
    return read(s, d, "embeddings").select("vec_id", valid_vector(F.col("embedding"), 64).alias("valid"))


@query("vector_passage_alignment", f"WITH {PASS} SELECT ps.passage_id, vec_id FROM ps JOIN embeddings ON passage_id = (vec_id // 2) || ':' || (vec_id % 2)")
def vector_passage_alignment(s, d):
    e = read(s, d, "embeddings").withColumn("id", F.concat_ws(":", F.expr("vec_id div 2"), F.col("vec_id") % 2))
    return attach_embeddings(passages(s, d).select("passage_id"), e.withColumn("embedding", F.col("vec_id")), "passage_id").select("passage_id", F.col("embedding").alias("vec_id"))


@query("embedding_join", "SELECT d.doc_id, len(e.embedding) AS dims FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def embedding_join(s, d):
    return attach_embeddings(read(s, d, "documents").select("doc_id"), read(s, d, "embeddings"), "doc_id", "vec_id").select("doc_id", F.size("embedding").cast("long").alias("dims"))


@query("embedding_missing_ids", "SELECT doc_id AS key, 'missing_id' AS problem FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_missing_ids(s, d):
    return embedding_problems(read(s, d, "documents"), read(s, d, "embeddings"), 64, "doc_id", "vec_id")


def _asked(s, d):
    """Every vector whose id is divisible by 50, as a query."""
    return read(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query("ann_lsh_topk")
def ann_lsh_topk(s, d):
    """The ten approximate neighbours of every query, by the inverted file with production parameters."""
    v = read(s, d, "embeddings")
    return ann.ann_search(ann.fit(v, "cosine"), v, _asked(s, d), 10).select("q", "vec_id", "score", "rank")


_NEAR = (
    "WITH n AS (SELECT a.vec_id AS q, b.vec_id, round(" + _SCORE["cosine"].replace("list_zip(q, embedding)", "list_zip(a.embedding, b.embedding)").replace(_SELF.format("q"), _SELF.format("a.embedding")).replace(_SELF.format("embedding"), _SELF.format("b.embedding"))
    + ", 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS BIGINT) AS rank FROM n QUALIFY rank <= 10"
)


@query("vector_topk_many", _NEAR)
def vector_topk_many(s, d):
    """The ten exact neighbours of every query, in blocks."""
    return ann.exact_search(read(s, d, "embeddings"), _asked(s, d), "cosine", 10).select("q", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("ann_recall")
def ann_recall(s, d):
    exact, found = vector_topk_many(s, d).select("q", "vec_id"), ann_lsh_topk(s, d).select("q", "vec_id", F.lit(1).alias("hit"))
    return exact.join(found, ["q", "vec_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


# -- fusion


def _lists(s, d, where=None):
    c = corpus(s, d)
    allowed = (lambda rows: rows) if where is None else (lambda rows: rows.join(c.where(where).select("doc_id"), "doc_id", "left_semi"))
    lex = lexical.top(stored_index(s, d).score(Q, where=allowed), 100, "doc_id").select("doc_id", "score")
    e = read(s, d, "embeddings").withColumn("doc_id", F.col("vec_id") % 100)
    if where is not None:
        e = e.join(c.where(where).select("doc_id"), "doc_id", "left_semi")
    vec = vector.best_per_document(vector.score_vectors(e, query_vector(s, d), "cosine"), F.col("doc_id"), 100).select(F.col("document_id").alias("doc_id"), "score")
    return lex, vec


def _rrf_sql(wl: str, wv: str, where: str = "true") -> str:
    cond = "true" if where == "true" else f"vec_id % 100 IN (SELECT doc_id FROM md0 WHERE {where})"
    return (
        f"WITH {bm25f_sql(Q, where=where)}, {_QV}, l AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM hits ORDER BY r LIMIT 100), "
        f"v0 AS (SELECT vec_id % 100 AS doc_id, max(round({_SCORE['cosine']}, 6)) AS score FROM embeddings, q WHERE {cond} GROUP BY 1), v AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM v0 ORDER BY r LIMIT 100), "
        f"f AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(l.score, 0e0) AS lexical_score, coalesce(v.score, 0e0) AS vector_score, round(coalesce({wl} / (60e0 + l.r), 0e0) + coalesce({wv} / (60e0 + v.r), 0e0), 9) AS fused_score, coalesce(l.r, 1073741824 + v.r) AS tie FROM l FULL JOIN v ON l.doc_id = v.doc_id) "
        "SELECT doc_id, lexical_score, vector_score, fused_score, CAST(row_number() OVER (ORDER BY fused_score DESC, tie) AS BIGINT) AS position FROM f QUALIFY position <= 20"
    )


def _fused(lists, **weights):
    return fusion.rrf(*lists, k=20, key="doc_id", **weights).withColumn("position", F.col("position").cast("long"))


@query("hybrid_rrf", _rrf_sql("1e0", "1e0"))
def hybrid_rrf(s, d):
    return _fused(_lists(s, d))


@query("hybrid_rrf_weighted", _rrf_sql("0.7e0", "1.9e0"))
def hybrid_rrf_weighted(s, d):
    return _fused(_lists(s, d), w_lex=0.7, w_vec=1.9)


@query("search_hybrid_filtered", _rrf_sql("1e0", "1e0", "lang = 'en'"))
def search_hybrid_filtered(s, d):
    return _fused(_lists(s, d, F.col("lang") == "en"))


# -- passages and retrieval


@query("chunk_fixed_windows", f"WITH {PASS} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char, sha256(text) AS digest FROM ps")
def chunk_fixed_windows(s, d):
    return passages(s, d).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("ordinal", "start_char", "end_char")], F.sha2("text", 256).alias("digest"))


@query("chunk_overlap_check", f"WITH {PASS}, o AS (SELECT doc_id, lag(end_char) OVER (PARTITION BY doc_id ORDER BY ordinal) - start_char AS shared FROM ps) SELECT shared = 50 AS full_overlap, CAST(count(*) AS BIGINT) AS n FROM o WHERE shared IS NOT NULL GROUP BY 1")
def chunk_overlap_check(s, d):
    p = passages(s, d).withColumn("shared", F.lag("end_char").over(W.partitionBy("doc_id").orderBy("ordinal")) - F.col("start_char"))
    return p.where("shared is not null").groupBy((F.col("shared") == 50).alias("full_overlap")).agg(F.count("*").alias("n"))


@query("passage_ordinal_contiguity", f"WITH {PASS}, o AS (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 = ordinal AS ok FROM ps) SELECT ok, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY ok")
def passage_ordinal_contiguity(s, d):
    p = passages(s, d).withColumn("ok", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")) - 1 == F.col("ordinal"))
    return p.groupBy("ok").agg(F.count("*").alias("n"))


@query("passage_parent_join", f"WITH {PASS} SELECT lang, CAST(count(*) AS BIGINT) AS passages FROM ps JOIN documents USING (doc_id) GROUP BY lang")
def passage_parent_join(s, d):
    return passages(s, d).select("doc_id").join(corpus(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("passages"))


@query("passages_of_document", f"WITH {PASS} SELECT passage_id, CAST(ordinal AS BIGINT) AS ordinal, text FROM ps WHERE doc_id = 5 ORDER BY ordinal")
def passages_of_document(s, d):
    return passages(s, d).where("doc_id = 5").select("passage_id", F.col("ordinal").cast("long").alias("ordinal"), "text").orderBy("ordinal")


@query("passage_lookup", f"WITH {PASS} SELECT passage_id, doc_id, text FROM ps WHERE passage_id = '7:1'")
def passage_lookup(s, d):
    return passages(s, d).where("passage_id = '7:1'").select("passage_id", "doc_id", "text")


def _ranked_passages(s, d, k=60):
    hits = lexical.top(stored_index(s, d, "passages").score(query_tokens("stupid the")), k, "passage_id").select("passage_id", "score")
    rows = passages(s, d).join(F.broadcast(hits), "passage_id")  # k rows
    return rows.select("passage_id", F.col("doc_id").alias("document_id"), "score", "text", F.row_number().over(W.orderBy(F.desc("score"), "passage_id")).alias("rank"))


_RANKED = _PASSAGE_SQL + ", h AS (SELECT passage_id, any_value(doc_id) AS document_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * w * 2.2e0 / (1.2e0 + w)), 6) AS score FROM w GROUP BY passage_id ORDER BY score DESC, passage_id LIMIT 60), r AS (SELECT h.*, text, row_number() OVER (ORDER BY score DESC, passage_id) AS rank FROM h JOIN ps USING (passage_id)) "


@query("retrieve_doc_cap", _RANKED + "SELECT passage_id, document_id, CAST(rank AS BIGINT) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY rank) <= 2")
def retrieve_doc_cap(s, d):
    r = _ranked_passages(s, d).withColumn("n", F.row_number().over(W.partitionBy("document_id").orderBy("rank")))
    return r.where("n <= 2").select("passage_id", "document_id", F.col("rank").cast("long").alias("rank"))


@query("context_prefix_bytes", _RANKED + "SELECT passage_id, CAST(sum(octet_length(encode(text))) OVER (ORDER BY rank) AS BIGINT) AS bytes FROM r")
def context_prefix_bytes(s, d):
    r = _ranked_passages(s, d)
    return r.select("passage_id", F.sum(F.octet_length("text")).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("bytes"))


_FOLD = (
    ", hs AS (SELECT list({'p': passage_id, 'd': CAST(document_id AS VARCHAR), 't': text, 'b': octet_length(encode(text))} ORDER BY rank) AS h FROM r), "
    "fo AS (SELECT list_reduce(h, lambda a, x: CASE WHEN len(a.ps) < 10 AND NOT list_contains(a.ps, x.p) AND len(list_filter(a.ds, lambda y: y = x.d)) < 2 AND x.b + (CASE WHEN len(a.ps) > 0 THEN 2 ELSE 0 END) <= 3000 - a.used "
    "THEN {'used': a.used + x.b + (CASE WHEN len(a.ps) > 0 THEN 2 ELSE 0 END), 'c': a.c || (CASE WHEN len(a.ps) > 0 THEN chr(10) || chr(10) ELSE '' END) || x.t, 'ps': list_append(a.ps, x.p), 'ds': list_append(a.ds, x.d)} ELSE a END, {'used': 0::BIGINT, 'c': '', 'ps': []::VARCHAR[], 'ds': []::VARCHAR[]}) AS f FROM hs) "
    "SELECT f.c AS context, CAST(f.used AS BIGINT) AS used_bytes, array_to_string(f.ps, ',') AS citations FROM fo"
)


@query("retrieve_context", _RANKED + _FOLD)
def retrieve_context(s, d):
    f = fusion.context_fold(_ranked_passages(s, d), 10, 2, 3000)
    return f.select("context", F.col("used_bytes").cast("long").alias("used_bytes"), F.array_join(F.transform("citations", lambda c: c["passage_id"]), ",").alias("citations"))


@query("search_response_json")
def search_response_json(s, d):
    hits = _fused(_lists(s, d)).withColumnRenamed("doc_id", "id")
    return hits.agg(F.to_json(F.struct(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("position", "id", "lexical_score", "vector_score", "fused_score"))).alias("hits"))).alias("response"))


def _sentences(s, d, *fields):
    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return docs.select(F.col("id").alias("document_id"), F.inline(sentence_passages(600, 80, fields)("id", "text")))


@query("chunk_sentence")
def chunk_sentence(s, d):
    return _sentences(s, d, "ordinal", "start_char", "end_char")


@query("passage_id_fnv")
def passage_id_fnv(s, d):
    return _sentences(s, d, "ordinal", "passage_id").select("passage_id", "document_id", "ordinal")


@query("prepare_passages")
def prepare_passages(s, d):
    return _sentences(s, d, *CHUNK_FIELDS).select(F.to_json(F.struct(F.lit("passage").alias("operation"), "document_id", "passage_id", "ordinal", "start_char", "end_char", "text")).alias("value"))


@query("segment_contract_violations", f"WITH {PASS} SELECT 'orphan_passage' AS rule, passage_id AS key FROM ps WHERE doc_id % 10 = 0")
def segment_contract_violations(s, d):
    p = passages(s, d).withColumnRenamed("doc_id", "document_id")
    return segment_violations(corpus(s, d).where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id")), p)


# -- quality


_JUDGED = (
    "j AS (SELECT source AS query_id, doc_id, quality * 2 + toxic AS relevance FROM documents JOIN labels USING (doc_id)), "
    "h AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), "
    "i AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (2e0 ** relevance - 1) / log2(r + 1) ELSE 0e0 END) AS idcg, count(*) FILTER (relevance > 0) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS r FROM j) GROUP BY query_id), "
    "f AS (SELECT query_id, sum((2e0 ** relevance - 1) / log2(rank + 1)) AS dcg, count(*) AS found, min(rank) AS best FROM h JOIN j USING (query_id, doc_id) WHERE rank <= 10 AND relevance > 0 GROUP BY query_id)"
)


@query("ndcg_recall_mrr", f"WITH {_JUDGED} SELECT query_id, round(coalesce(dcg / idcg, 0e0), 6) AS ndcg, round(coalesce(found::DOUBLE / relevant, 0e0), 6) AS recall, round(coalesce(1e0 / best, 0e0), 6) AS mrr FROM i LEFT JOIN f USING (query_id) WHERE relevant > 0")
def ndcg_recall_mrr(s, d):
    docs = read(s, d, "documents")
    j = docs.join(read(s, d, "labels"), "doc_id").select(F.col("source").alias("query_id"), "doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("relevance"))
    h = docs.select(F.col("source").alias("query_id"), "doc_id", F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return quality.ranking_quality(h, j, 10)


_MS = "SELECT event_type AS op, value * 10 AS ms FROM events"


def _samples(s, d):
    return read(s, d, "events").select(F.col("event_type").alias("op"), (F.col("value") * 10).alias("ms"))


@query("latency_histogram", "SELECT op, " + ", ".join(f"CAST(count(*) FILTER (ms <= {b}) AS BIGINT) AS le_{b}" for b in quality.BUCKETS_MS) + f", CAST(count(ms) AS BIGINT) AS le_inf, round(sum(ms), 3) AS sum_ms FROM ({_MS}) GROUP BY op")
def latency_histogram(s, d):
    return quality.latency_histogram(_samples(s, d))


@query("latency_percentiles", f"SELECT op, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99 FROM ({_MS}) GROUP BY op")
def latency_percentiles(s, d):
    return quality.percentiles(_samples(s, d))
