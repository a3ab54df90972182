"""Queries: text, lexical search, filters, paging, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as TX
from lodestack.functions.filters import compile_filter, entries, metadata_map
from lodestack.functions.scoring import bm25
from lodestack.operators import fusion, lexical
from lodestack.plans.tables import DOCS, FIELDS, META, OCC, PASS, POST, STATS, TK, WORDS, bm25f_sql, corpus, query, read, stored_index, with_metadata

AREA = ["title", "body"]
Q = ["the", "and", "token"]


@query("normalize_lower", "SELECT doc_id, lower(text) AS norm FROM documents")
def normalize_lower(s, d):
    return corpus(s, d).select("doc_id", F.lower("body").alias("norm"))


@query("normalize_nfkc")
def normalize_nfkc(s, d):
    return corpus(s, d).select("doc_id", TX.normalize_nfkc("body").alias("norm"))


@query("tokenize_counts", f"WITH {TK} SELECT doc_id, CAST(len(tb) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tb)) AS BIGINT) AS n_distinct FROM tk")
def tokenize_counts(s, d):
    t = corpus(s, d).select("doc_id", TX.tokens(F.col("body")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("corpus_stats", f"WITH {TK}, {STATS} SELECT CAST(n AS BIGINT) AS n, CAST(tokens_title AS BIGINT) AS tokens_title, CAST(tokens_body AS BIGINT) AS tokens_body FROM st")
def corpus_stats(s, d):
    return lexical.corpus_stats(corpus(s, d), AREA)


@query("term_document_frequency", f"WITH {POST} SELECT term, CAST(count(*) AS BIGINT) AS df FROM post GROUP BY term")
def term_document_frequency(s, d):
    return lexical.document_frequency(stored_index(s, d).postings())


@query("query_plan_terms", "SELECT term, CAST(qpos AS BIGINT) AS qpos FROM (VALUES ('quick', 0), ('quick', 1), ('brown', 2)) t(term, qpos)")
def query_plan_terms(s, d):
    return s.createDataFrame([(t, i) for i, t in enumerate(TX.query_tokens("QUICK quick brown"))], "term string, qpos long")


@query("postings_build", f"WITH {POST} SELECT term, doc_id, CAST(tf_title AS BIGINT) AS tf_title, CAST(len_title AS BIGINT) AS len_title, CAST(tf_body AS BIGINT) AS tf_body, CAST(len_body AS BIGINT) AS len_body FROM post")
def postings_build(s, d):
    return lexical.object_postings(corpus(s, d), AREA, "doc_id", positions=False)


@query("postings_invariants", f"WITH {POST} SELECT CAST(count(*) AS BIGINT) AS violations FROM post WHERE tf_title + tf_body < 1 OR tf_title > len_title OR tf_body > len_body")
def postings_invariants(s, d):
    return lexical.posting_violations(postings_build(s, d), AREA).agg(F.count("*").alias("violations"))


@query("posting_blocks", f"WITH {POST}, b AS (SELECT term, CAST(floor((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) / 128) AS BIGINT) AS block, tf_body, len_body FROM post) SELECT term, block, CAST(count(*) AS BIGINT) AS size, CAST(max(tf_body) AS BIGINT) AS max_tf, CAST(min(len_body) AS BIGINT) AS min_len FROM b GROUP BY term, block")
def posting_blocks(s, d):
    return lexical.posting_blocks(postings_build(s, d), "body", "doc_id")


@query("bm25_single_field", f"WITH {POST}, {STATS}, p AS (SELECT * FROM post WHERE term = 'the' AND tf_body > 0) SELECT doc_id, round(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf_body * 2.2e0 / (tf_body + 1.2e0 * (0.25e0 + 0.75e0 * len_body / (tokens_body::DOUBLE / n))), 6) AS score FROM p, st, (SELECT count(*) AS df FROM p) x")
def bm25_single_field(s, d):
    index = stored_index(s, d)
    p = index.postings(["the"]).where("tf_body > 0")
    p = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("df"))))  # one row
    n = float(index.stats["n"])
    return p.select("doc_id", F.round(bm25(F.col("tf_body").cast("double"), F.col("df").cast("double"), F.lit(n), F.col("len_body"), F.lit(index.stats["tokens_body"] / n if n else 0.0)), 6).alias("score"))


def _top(hits, k=10):
    return lexical.top(hits.withColumn("matched", F.col("matched").cast("long")), k, "doc_id")


@query("bm25f_or", f"WITH {bm25f_sql(Q)} SELECT doc_id, score, CAST(matched AS BIGINT) AS matched FROM hits ORDER BY score DESC, doc_id LIMIT 10")
def bm25f_or(s, d):
    return _top(stored_index(s, d).score(Q))


@query("bm25f_and", f"WITH {bm25f_sql(Q, minimum=3)} SELECT doc_id, score, CAST(matched AS BIGINT) AS matched FROM hits ORDER BY score DESC, doc_id LIMIT 10")
def bm25f_and(s, d):
    return _top(stored_index(s, d).score(Q, "and"))


@query("or_minus_and", f"WITH {bm25f_sql(Q)} SELECT doc_id FROM hits EXCEPT SELECT doc_id FROM hits WHERE matched = 3")
def or_minus_and(s, d):
    index = stored_index(s, d)
    return index.score(Q).select("doc_id").subtract(index.score(Q, "and").select("doc_id"))


@query("phrase_match", f"WITH {OCC}, q AS (SELECT * FROM (VALUES ('of', 0), ('the', 1)) t(term, qpos)) SELECT DISTINCT doc_id FROM (SELECT doc_id, field, pos - qpos AS st, count(DISTINCT qpos) AS k FROM occ JOIN q USING (term) GROUP BY ALL) WHERE k = 2")
def phrase_match(s, d):
    return stored_index(s, d).phrase(["of", "the"])


@query("topk_tiebreak", f"WITH {bm25f_sql(['license', 'licensed', 'version'])} SELECT doc_id, score FROM hits ORDER BY score DESC, doc_id LIMIT 25")
def topk_tiebreak(s, d):
    return lexical.top(stored_index(s, d).score(["license", "licensed", "version"]), 25, "doc_id").select("doc_id", "score")


@query("bm25f_filtered", f"WITH {bm25f_sql(Q, where=chr(108) + 'ang = ' + chr(39) + 'en' + chr(39) + ' AND n_chars >= 500')} SELECT doc_id, score, CAST(matched AS BIGINT) AS matched FROM hits ORDER BY score DESC, doc_id LIMIT 10")
def bm25f_filtered(s, d):
    allowed = corpus(s, d).where((F.col("lang") == "en") & (F.col("n_chars") >= 500)).select("doc_id")
    return _top(stored_index(s, d).score(Q, where=lambda rows: rows.join(allowed, "doc_id", "left_semi")))


_BATCH = (
    f"WITH {POST}, {STATS}, qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term), "
    "w AS (SELECT query_id, doc_id, df, n, (CASE WHEN tf_title > 0 THEN 2e0 * tf_title / (0.25e0 + 0.75e0 * len_title / (tokens_title::DOUBLE / n)) ELSE 0e0 END + CASE WHEN tf_body > 0 THEN 1e0 * tf_body / (0.25e0 + 0.75e0 * len_body / (tokens_body::DOUBLE / n)) ELSE 0e0 END) AS w FROM post JOIN qt USING (term) JOIN dfs USING (term), st) "
    "SELECT query_id, doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * w * 2.2e0 / (1.2e0 + w)), 6) AS score FROM w GROUP BY query_id, doc_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"
)


@query("batch_bm25f", _BATCH)
def batch_bm25f(s, d):
    """Every benchmark passage, whole, as a query."""
    q = read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return stored_index(s, d).score_many(q, 10).select("query_id", "doc_id", "score")


_PASSAGE_SQL = (
    f"WITH {PASS}, tk AS (SELECT passage_id, doc_id, regexp_extract_all(lower(text), '{WORDS}') AS t FROM ps), st AS (SELECT count(*) AS n, sum(len(t))::DOUBLE / count(*) AS avg FROM tk), "
    "p AS (SELECT passage_id, doc_id, term, count(*) AS tf, max(l) AS l FROM (SELECT passage_id, doc_id, unnest(t) AS term, len(t) AS l FROM tk) WHERE term IN ('stupid', 'the') GROUP BY ALL), "
    "dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term), w AS (SELECT *, tf / (0.25e0 + 0.75e0 * l / avg) AS w FROM p JOIN dfs USING (term), st) "
)


@query("scope_passages_lexical", _PASSAGE_SQL + "SELECT passage_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * w * 2.2e0 / (1.2e0 + w)), 6) AS score FROM w GROUP BY passage_id ORDER BY score DESC, passage_id LIMIT 20")
def scope_passages_lexical(s, d):
    return lexical.top(stored_index(s, d, "passages").score(["stupid", "the"]), 20, "passage_id").select("passage_id", "score")


@query("search_results_projection", f"WITH {bm25f_sql(Q)}, t AS (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT 10) SELECT t.doc_id, score, title, left(body, 180) AS snippet FROM t JOIN docs USING (doc_id)")
def search_results_projection(s, d):
    hits = _top(stored_index(s, d).score(Q)).select("doc_id", "score")
    rows = corpus(s, d).join(F.broadcast(hits), "doc_id")  # ten rows
    return rows.select("doc_id", "score", "title", TX.snippet_window(F.col("body"), []).alias("snippet"))


@query("search_page_2", f"WITH {bm25f_sql(Q)} SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS position, (SELECT count(*) FROM hits) > 20 AS has_more FROM hits ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10")
def search_page_2(s, d):
    p = fusion.page(stored_index(s, d).score(Q), 10, 10, [F.desc("score"), F.asc("doc_id")])
    return p.select("doc_id", "score", F.col("position").cast("long").alias("position"), "has_more")


_WINDOW = "greatest(0, least(greatest(0, (CASE WHEN instr(body, 'stupid') > 0 THEN instr(body, 'stupid') - 1 WHEN instr(body, 'the') > 0 THEN instr(body, 'the') - 1 ELSE 0 END) - 30), length(body) - 60))"


@query("snippet_window", f"WITH {DOCS} SELECT doc_id, substring(body, CAST({_WINDOW} AS BIGINT) + 1, 60) AS snippet FROM docs")
def snippet_window(s, d):
    return corpus(s, d).select("doc_id", TX.snippet_window(F.col("body"), ["stupid", "the"], 60).alias("snippet"))


@query("snippet_highlight", f"WITH {DOCS} SELECT doc_id, regexp_replace(substring(body, CAST({_WINDOW} AS BIGINT) + 1, 60), '(stupid|the)', '<mark>\\1</mark>', 'g') AS snippet FROM docs")
def snippet_highlight(s, d):
    return corpus(s, d).select("doc_id", TX.highlight(TX.snippet_window(F.col("body"), ["stupid", "the"], 60), ["stupid", "the"]).alias("snippet"))


# -- metadata and filters


@query("metadata_entries", f"WITH {META} SELECT doc_id, 'lang' AS field, 'string' AS type, lang AS value FROM md UNION ALL SELECT doc_id, 'source', 'string', source FROM md UNION ALL SELECT doc_id, 'n_chars', 'number', CAST(n_chars AS VARCHAR) FROM md UNION ALL SELECT doc_id, 'quality', 'number', CAST(quality AS VARCHAR) FROM md WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', 'number', CAST(toxic AS VARCHAR) FROM md WHERE toxic IS NOT NULL")
def metadata_entries(s, d):
    t = with_metadata(s, d).select("doc_id", F.explode(F.map_entries(metadata_map(F.col("metadata"), FIELDS))).alias("m"))
    t = t.select("doc_id", F.col("m.key").alias("field"), F.explode("m.value").alias("e"))
    return t.select("doc_id", "field", F.col("e.type").alias("type"), F.col("e.str").alias("value"))


@query("json_path_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_path_get(s, d):
    e = read(s, d, "events")
    return e.select("event_id", F.get(entries(F.col("props"), "k"), F.lit(0))["num"].alias("k"))


def _filtered(s, d, node):
    t = with_metadata(s, d).withColumn("meta", metadata_map(F.col("metadata"), FIELDS))
    return t.where(compile_filter(node, FIELDS)).select("doc_id")


def _filter_query(name, node, sql):
    query(name, f"WITH {META} SELECT doc_id FROM md WHERE {sql}")(lambda s, d: _filtered(s, d, node))


_filter_query("filter_eq", {"eq": {"field": "lang", "value": "fr"}}, "lang = 'fr'")
_filter_query("filter_in", {"in": {"field": "source", "values": ["src1", "src5", 7]}}, "source IN ('src1', 'src5')")
_filter_query("filter_range", {"range": {"field": "n_chars", "gte": 500, "lt": 2000}}, "n_chars >= 500 AND n_chars < 2000")
_filter_query("filter_exists", {"exists": {"field": "quality"}}, "quality IS NOT NULL")
_filter_query("filter_not", {"not": {"eq": {"field": "quality", "value": 1}}}, "NOT coalesce(quality = 1, false)")
_filter_query("filter_and_or", {"and": [{"or": [{"eq": {"field": "lang", "value": "de"}}, {"eq": {"field": "toxic", "value": 1}}]}, {"not": {"range": dict(field="n_chars", gt=3000)}}]}, "(lang = 'de' OR coalesce(toxic = 1, false)) AND NOT (n_chars > 3000)")
