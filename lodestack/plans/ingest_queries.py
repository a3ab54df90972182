"""Queries: change records, versions, maintenance, sources, RAG text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions import text as TX
from lodestack.operators import fusion, quality, versions
from lodestack.plans.tables import DOCS, LAST, LOG, corpus, log, query, read
from lodestack.sources import extract as EX
from lodestack.sources import ingest

# -- records: every tenth line is broken in a known way


def _lines(s, d):
    e, k = read(s, d, "events"), F.col("event_id") % 10
    head = F.format_string('{"id":"%s","operation":"upsert","title":"%s"', F.col("user_id"), F.col("event_type"))
    tail = F.concat(F.lit(',"body":"b '), F.col("event_id").cast("string"), F.lit('","metadata":'), F.col("props"), F.lit("}"))
    value = (
        F.when(k == 3, F.concat(head, F.lit(',"extra":1'), tail))
        .when(k == 5, F.format_string('{"operation":"delete","id":"%s","body":"x"}', F.col("user_id")))
        .when(k == 7, F.concat(head, F.lit(',"body":"cut')))
        .when(k == 8, F.format_string('{"operation":"delete","id":"%s"}', F.col("user_id")))
        .when(k == 9, F.concat(head, F.lit("}")))
        .otherwise(F.concat(head, tail))
    )
    return e.select("event_id", value.alias("value"))


_PARSED = (
    "SELECT event_id, CASE WHEN k = 7 THEN NULL WHEN k IN (5, 8) THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN k = 7 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id, "
    "CASE WHEN k IN (5, 7, 8) THEN '' ELSE event_type END AS title, CASE k WHEN 3 THEN 'unknown_key' WHEN 5 THEN 'delete_with_fields' WHEN 7 THEN 'invalid_json' WHEN 9 THEN 'missing_body' END AS error FROM (SELECT *, event_id % 10 AS k FROM events)"
)


@query("ingest_ndjson_parse", _PARSED)
def ingest_ndjson_parse(s, d):
    return ingest.parse_ops(_lines(s, d)).select("event_id", "op", "id", "title", "error")


@query("convert_success_failure", f"SELECT error IS NULL AS ok, error, CAST(count(*) AS BIGINT) AS n FROM ({_PARSED}) GROUP BY ALL")
def convert_success_failure(s, d):
    return ingest.parse_ops(_lines(s, d)).groupBy(F.col("error").isNull().alias("ok"), "error").agg(F.count("*").alias("n"))


@query("ingest_summary", f"SELECT CAST(count(*) AS BIGINT) AS accepted, CAST(count(*) FILTER (op = 'upsert') AS BIGINT) AS upserts, CAST(count(*) FILTER (op = 'delete') AS BIGINT) AS deletes FROM ({_PARSED}) WHERE error IS NULL")
def ingest_summary(s, d):
    ok = ingest.parse_ops(_lines(s, d)).where("error is null")
    return ok.agg(F.count("*").alias("accepted"), F.sum((F.col("op") == "upsert").cast("long")).alias("upserts"), F.sum((F.col("op") == "delete").cast("long")).alias("deletes"))


@query("build_upsert_only", f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({_PARSED}) WHERE error IS NULL AND op = 'upsert'")
def build_upsert_only(s, d):
    parsed = ingest.parse_ops(_lines(s, d))
    return ingest.upserts_only(parsed.where("error is null and op = 'upsert'")).agg(F.count("*").alias("n"))


@query(
    "ingest_batch_explode",
    f"SELECT event_id // 50 AS batch, CAST(row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS BIGINT) AS pos, id, error FROM ({_PARSED}) WHERE error IS DISTINCT FROM 'invalid_json' "
    "UNION ALL SELECT DISTINCT -1 - event_id // 50, -1, CAST(NULL AS VARCHAR), 'invalid_json' FROM events WHERE event_id % 10 = 7",
)
def ingest_batch_explode(s, d):
    """All lines in batches of up to 50; the cut lines have batches of their own, which are refused whole."""
    batch = F.expr("event_id div 50")
    ops = _lines(s, d).withColumn("batch", F.when(F.col("event_id") % 10 == 7, -1 - batch).otherwise(batch)).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("o"))  # 50 at most
    whole = ops.select("batch", F.concat(F.lit('{"operations":['), F.array_join(F.transform("o", lambda x: x["value"]), ","), F.lit("]}")).alias("value"))
    return ingest.parse_ops(ingest.parse_batch(whole)).select("batch", F.col("pos").cast("long").alias("pos"), "id", "error")


@query("ingest_tsv_parse", "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'delete' ELSE 'upsert' END AS op, CAST(doc_id AS VARCHAR) AS id, sha256(replace(text, chr(9), ' ')) AS body_hash, CASE WHEN doc_id % 7 = 2 THEN 'body_length' WHEN doc_id % 7 = 3 THEN 'invalid_operation' END AS error FROM documents")
def ingest_tsv_parse(s, d):
    body = F.regexp_replace("text", "\t", " ")
    kind = F.when(F.col("doc_id") % 7 == 3, "PUT").when(F.col("doc_id") % 5 == 1, "DELETE").otherwise("ADD")
    size = F.octet_length(body) + F.when(F.col("doc_id") % 7 == 2, 1).otherwise(0)
    lines = read(s, d, "documents").select("doc_id", F.concat_ws("\t", "doc_id", kind, F.lit("t"), size, body).alias("value"))
    t = ingest.parse_tsv(lines)
    op = F.when((F.col("doc_id") % 7 == 3) & (F.col("doc_id") % 5 == 1), F.lit("delete")).otherwise(F.col("op"))
    return t.select("doc_id", op.alias("op"), "id", F.sha2("body", 256).alias("body_hash"), "error")


@query("canonical_json", "SELECT event_id, '{\"a\":{\"b\":' || CAST(json(props) AS VARCHAR) || ',\"y\":2},\"z\":1}' AS json FROM events")
def canonical_json(s, d):
    return read(s, d, "events").select("event_id", ingest.canonical_json(F.concat(F.lit('{"z": 1, "a": {"y": 2, "b": '), F.col("props"), F.lit("}}"))).alias("json"))


@query("json_dup_keys", "SELECT event_id, event_id % 3 = 0 AS rejected FROM events")
def json_dup_keys(s, d):
    twice = F.when(F.col("event_id") % 3 == 0, F.lit('{"a": {"k": 1, "k": 2}}')).otherwise(F.col("props"))
    return read(s, d, "events").select("event_id", F.try_parse_json(twice).isNull().alias("rejected"))


@query("document_contract", f"WITH {DOCS} SELECT doc_id, CASE WHEN octet_length(encode(title)) > 255 THEN 'title_length' WHEN doc_id % 11 = 3 THEN 'timestamp' END AS error FROM docs")
def document_contract(s, d):
    t = corpus(s, d).withColumn("id", F.col("doc_id").cast("string")).withColumn("url", F.lit("")).withColumn("updated_at_unix_ms", F.when(F.col("doc_id") % 11 == 3, -1).otherwise(F.col("n_chars")))
    return t.select("doc_id", ingest.document_errors(t).alias("error"))


@query("doc_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def doc_sha256(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# -- versions


_KEYS = {"order": ("generation", "seq")}


@query("visible_documents", f"WITH {LAST} SELECT id, seq, generation FROM la WHERE op = 'upsert'")
def visible_documents(s, d):
    return versions.visible(log(s, d), **_KEYS).select("id", "seq", "generation")


@query("deleted_documents", f"WITH {LAST} SELECT id, seq FROM la WHERE op = 'delete'")
def deleted_documents(s, d):
    return versions.deleted(log(s, d), **_KEYS).select("id", "seq")


@query("as_of_generation", f"WITH {LOG} SELECT id, seq FROM (SELECT * FROM lg WHERE generation <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY generation DESC, seq DESC) = 1) WHERE op = 'upsert'")
def as_of_generation(s, d):
    return versions.as_of(log(s, d), 5, **_KEYS).select("id", "seq")


@query("apply_upserts_deletes", f"WITH {LAST} SELECT id, value FROM la WHERE op = 'upsert'")
def apply_upserts_deletes(s, d):
    old, new = log(s, d).where("segment < 5"), log(s, d).where("segment >= 5")
    return versions.visible(versions.latest(old, **_KEYS).unionByName(new), **_KEYS).select("id", "value")


@query("segments_union", f"WITH {LOG} SELECT segment, CAST(count(*) AS BIGINT) AS n FROM lg GROUP BY segment")
def segments_union(s, d):
    base, delta = log(s, d).where("segment < 6"), log(s, d).where("segment >= 6")
    return base.unionByName(delta).groupBy("segment").agg(F.count("*").alias("n"))


@query("compact_live_rows", f"WITH {LOG} SELECT id, op, seq FROM lg WHERE segment BETWEEN 1 AND 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY generation DESC, seq DESC) = 1")
def compact_live_rows(s, d):
    return versions.compact(log(s, d), 1, 3, 1 << 30, **_KEYS).select("id", "op", "seq")


@query("batch_duplicate_ids", f"WITH {LOG} SELECT generation, id, CAST(count(*) AS BIGINT) AS copies FROM lg GROUP BY ALL HAVING count(*) > 1")
def batch_duplicate_ids(s, d):
    return ingest.duplicate_ids(log(s, d), "id", ("generation",)).select("generation", "id", "copies")


def _segments(s, d):
    """One segment per customer of orders, as large as its orders' prices."""
    o = read(s, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("ordinal")).agg(F.count("*").alias("documents"), F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).cast("long").alias("bytes"))


_SEG = "sg AS (SELECT o_custkey AS ordinal, CAST(count(*) AS BIGINT) AS documents, CAST(floor(sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey)"
_SMALL = 2_000_000


@query("segment_health", f"WITH {_SEG} SELECT CAST(count(*) AS BIGINT) AS segments, CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, min(bytes) AS min_bytes, max(bytes) AS max_bytes, CAST(count(*) FILTER (bytes < {_SMALL}) AS BIGINT) AS small_segments FROM sg")
def segment_health(s, d):
    return quality.segment_health(_segments(s, d), _SMALL)


@query("small_segment_run", f"WITH {_SEG}, n AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM sg), r AS (SELECT *, n - row_number() OVER (ORDER BY ordinal) AS g FROM n WHERE bytes < {_SMALL}) SELECT min(ordinal) AS run_start, CAST(count(*) AS BIGINT) AS length, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY g")
def small_segment_run(s, d):
    return versions.small_runs(_segments(s, d), _SMALL)


_TIER = "CAST(floor(ln(greatest(bytes, 15625)::DOUBLE / 15625e0) / ln(4e0) + 1e-9) AS BIGINT)"


@query("compaction_candidates", f"WITH {_SEG}, t AS (SELECT *, {_TIER} AS tier, row_number() OVER (ORDER BY ordinal) AS n FROM sg), g AS (SELECT *, n - row_number() OVER (PARTITION BY tier ORDER BY ordinal) AS g FROM t), p AS (SELECT *, (row_number() OVER (PARTITION BY tier, g ORDER BY ordinal) - 1) // 8 AS part FROM g) SELECT min(ordinal) AS run_start, CAST(count(*) AS BIGINT) AS length, CAST(sum(bytes) AS BIGINT) AS bytes, tier FROM p GROUP BY tier, g, part HAVING count(*) >= 2")
def compaction_candidates(s, d):
    return versions.compaction_candidates(_segments(s, d), 1_000_000, 2, 8)


@query("base_delta_plan", f"WITH {LOG}, a AS (SELECT segment AS segment_id, CAST(count(*) AS BIGINT) AS fingerprint FROM lg GROUP BY 1), c AS (SELECT * FROM a WHERE segment_id >= 2), b AS (SELECT segment_id, fingerprint + CASE WHEN segment_id = 4 THEN 1 ELSE 0 END AS fingerprint FROM a WHERE segment_id < 7) SELECT c.*, CASE WHEN b.segment_id IS NULL THEN 'delta' ELSE 'base' END AS state FROM c LEFT JOIN b USING (segment_id, fingerprint) UNION ALL SELECT *, 'missing' FROM b WHERE (segment_id, fingerprint) NOT IN (SELECT (segment_id, fingerprint) FROM c)")
def base_delta_plan(s, d):
    a = log(s, d).groupBy(F.col("segment").alias("segment_id")).agg(F.count("*").alias("fingerprint"))
    base = a.where("segment_id < 7").withColumn("fingerprint", F.col("fingerprint") + F.when(F.col("segment_id") == 4, 1).otherwise(0))
    return versions.base_delta(a.where("segment_id >= 2"), base)


_PLAN = (
    f"WITH RECURSIVE {_SEG}, s AS (SELECT row_number() OVER (ORDER BY ordinal) - 1 AS i, bytes FROM sg), "
    "g AS (SELECT i, i AS start, bytes AS used FROM s WHERE i = 0 UNION ALL SELECT s.i, CASE WHEN used + bytes > 8000000 THEN s.i ELSE start END, CASE WHEN used + bytes > 8000000 THEN bytes ELSE used + bytes END FROM g JOIN s ON s.i = g.i + 1), "
    "p AS (SELECT start, max(i) + 1 AS stop, max(used) AS bytes, row_number() OVER (ORDER BY start DESC) AS r FROM g GROUP BY start), "
    "m AS (SELECT count(*) > 1 AND max(CASE WHEN r = 1 THEN bytes END) < 4000000 AND sum(CASE WHEN r <= 2 THEN bytes END) <= 12000000 AS tail FROM p) "
    "SELECT start, CASE WHEN tail AND r = 2 THEN (SELECT max(stop) FROM p) ELSE stop END AS \"end\" FROM p, m WHERE NOT (tail AND r = 1)"
)


@query("segment_plan_greedy", _PLAN)
def segment_plan_greedy(s, d):
    rows = _segments(s, d).orderBy("ordinal").select("bytes").collect()  # a manifest's sizes
    cuts = versions.plan_segments([r["bytes"] for r in rows], 8_000_000, 16_000_000, 4_000_000, 12_000_000)
    return s.createDataFrame(cuts or [(0, 0)], "start long, end long")


@query("microbatch_groups")
def microbatch_groups(s, d):
    """All requests of the log, ten events each, grouped within triggers of a hundred requests."""
    r = log(s, d).groupBy(F.expr("seq div 1000").alias("trigger"), F.expr("seq div 10").alias("request")).agg(F.collect_list("id").alias("ids"))
    return versions.microbatches(r, 200)


@query("stream_ingest", f"SELECT id, title, 'b ' || event_id AS body FROM (SELECT * FROM ({_PARSED}) WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1) WHERE op = 'upsert'")
def stream_ingest(s, d):
    """The whole change log as a stream of files, two a trigger, into an index; its visible documents. Broken lines go to a table of failures."""
    from lodestack.plans.config import IndexConfig
    from lodestack.plans.index import Index
    from lodestack.storage import new_folder
    from lodestack.streaming.ingest import stream_ingest as start

    base, lines = new_folder(s, "stream"), _lines(s, d)
    last = lines.agg(F.max("event_id")).first()[0]
    for k in range(4):  # files in the order of the log
        part = lines.where((F.col("event_id") * 4).between(k * (last + 1), (k + 1) * (last + 1) - 1)) if last is not None else lines
        part.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").select("value").write.mode("append").text(f"{base}/in")
    index = Index.create(s, f"{base}/index", IndexConfig())
    stream = s.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{base}/in")
    start(stream, index, f"{base}/checkpoint", failures=f"{base}/failures").awaitTermination()
    return index.documents().select("id", "title", "body")


# -- sources


@query("wiki_dedupe_first", "SELECT CAST(user_id AS VARCHAR) AS id, 'http://w/' || event_id AS url, event_type AS title, 'text ' || event_id AS body FROM (SELECT * FROM events WHERE event_id % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)")
def wiki_dedupe_first(s, d):
    n = F.col("event_id")
    pages = read(s, d, "events").select(
        F.col("user_id").cast("string").alias("id"), F.concat(F.lit("http://w/"), n.cast("string")).alias("url"), F.concat(F.lit(" "), F.col("event_type")).alias("title"),
        F.when(n % 4 == 1, "  ").otherwise(F.concat(F.lit("text "), n.cast("string"), F.lit(" "))).alias("text"), n.alias("n"),
    )
    return EX.wiki_documents(pages)


@query("stable_document_id", "SELECT page_id, 'lf:v1:web:' || sha256('web' || chr(0) || url) || ':p' || lpad(CAST(page_id % 3 AS VARCHAR), 10, '0') AS id FROM pages")
def stable_document_id(s, d):
    return read(s, d, "pages").select("page_id", TX.stable_document_id("web", F.col("url"), F.col("page_id") % 3).alias("id"))


@query("newline_normalize", "SELECT doc_id, sha256(text) AS digest FROM documents")
def newline_normalize(s, d):
    mixed = F.regexp_replace("text", "\n", "\r\n")
    return read(s, d, "documents").select("doc_id", F.sha2(EX.newline_normalize(mixed), 256).alias("digest"))


@query("shard_manifest", "SELECT doc_id % 8 AS shard, CAST(count(*) AS BIGINT) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, min(left(sha256(text), 15)) AS first_hash, max(left(sha256(text), 15)) AS last_hash FROM documents GROUP BY 1")
def shard_manifest(s, d):
    return EX.shard_manifest(read(s, d, "documents"), F.col("doc_id") % 8, F.col("text"))


@query("html_to_text")
def html_to_text(s, d):
    return read(s, d, "pages").select("page_id", EX.html_to_text("html").alias("text"))


@query("json_pretty_extract")
def json_pretty_extract(s, d):
    e = read(s, d, "events")
    return EX.extract(e.select(F.concat(F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.col("props").alias("content")))


@query("extract_dispatch")
def extract_dispatch(s, d):
    p = read(s, d, "pages")
    suffix = F.element_at(F.array(F.lit(".html"), F.lit(".txt"), F.lit(".xml"), F.lit(".bin")), (F.col("page_id") % 4 + 1).cast("int"))
    return EX.extract(p.select(F.concat(F.col("page_id").cast("string"), suffix).alias("path"), F.col("html").alias("content")))


@query("source_glob_filter", "SELECT page_id, url AS path FROM pages WHERE (url GLOB '*.html' OR url GLOB '*/fr/*') AND NOT url GLOB '*blog*'")
def source_glob_filter(s, d):
    return EX.select_paths(read(s, d, "pages").select("page_id", F.col("url").alias("path")), ["*.html", "*/fr/*"], ["*blog*"]).select("page_id", "path")


@query("source_snapshot_hash")
def source_snapshot_hash(s, d):
    return EX.snapshot_hash(read(s, d, "pages").select(F.col("url").alias("path"), F.sha2("html", 256).alias("digest"), F.col("page_id").alias("mtime")))


@query("utf8_valid", "SELECT doc_id, len(list_filter(range(0, 100), lambda n: octet_length(encode(left(text, n))) = least(99, octet_length(encode(text))))) > 0 AS valid FROM documents")
def utf8_valid(s, d):
    """Whether a text's first 99 bytes end with a whole character."""
    return read(s, d, "documents").select("doc_id", TX.valid_utf8(F.substring(F.encode("text", "UTF-8"), 1, 99)).alias("valid"))


@query("truncate_utf8", "SELECT doc_id, left(text, list_max(list_filter(range(0, 100), lambda n: octet_length(encode(left(text, n))) <= 99))) AS head FROM documents")
def truncate_utf8(s, d):
    return read(s, d, "documents").select("doc_id", TX.truncate_utf8(99)("text").alias("head"))


@query("split_body")
def split_body(s, d):
    return read(s, d, "documents").select("doc_id", F.posexplode(TX.split_body(1000)("text")).alias("part", "text"))


# -- prompts and answers


@query("embedding_prompt", f"WITH {DOCS} SELECT doc_id, 'title: ' || coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE title END), ''), 'none') || ' | text: ' || body AS prompt FROM docs")
def embedding_prompt(s, d):
    title = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("title"))
    return corpus(s, d).select("doc_id", EX.embedding_prompt(title, F.col("body")).alias("prompt"))


_TURNS = "c AS (SELECT conv_id, turn, coalesce(text, '') || ' [' || (turn % 4) || '] and [' || (conv_id % 3) || ']' AS answer, conv_id % 4 AS sources FROM conversations WHERE role = 'assistant')"
_CITED = "c2 AS (SELECT *, list_distinct([try_cast(x AS INTEGER) for x in regexp_extract_all(answer, '\\[(\\d+)\\]', 1)]) AS cited FROM c)"
_VALID = "len(cited) > 0 AND len(list_filter(cited, lambda x: x BETWEEN 1 AND sources)) = len(cited)"


def _answers(s, d):
    a = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), (F.col("turn") % 4).cast("string"), F.lit("] and ["), (F.col("conv_id") % 3).cast("string"), F.lit("]"))
    return read(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", a.alias("answer"), (F.col("conv_id") % 4).alias("sources"))


@query("citation_validate", f"WITH {_TURNS}, {_CITED} SELECT conv_id, turn, CAST(len(cited) AS BIGINT) AS n, {_VALID} AS valid FROM c2")
def citation_validate(s, d):
    return _answers(s, d).select("conv_id", "turn", F.size(fusion.citations_in(F.col("answer"))).cast("long").alias("n"), fusion.citations_valid(F.col("answer"), F.col("sources")).alias("valid"))


@query("rag_status", f"WITH {_TURNS}, {_CITED} SELECT conv_id, turn, CASE WHEN sources = 0 THEN 'no_context' WHEN turn % 5 = 4 THEN 'unconfigured' WHEN NOT ({_VALID}) THEN 'invalid_citations' ELSE 'answered' END AS status FROM c2")
def rag_status(s, d):
    a = _answers(s, d).withColumn("answer", F.when(F.col("turn") % 5 != 4, F.col("answer")))
    return a.select("conv_id", "turn", fusion.rag_status(F.col("sources"), F.col("answer")).alias("status"))


#: The prompt of each source's first three documents, whole.
@query("rag_prompt", f"WITH {DOCS}, t AS (SELECT source, list('[' || n || '] ' || title || chr(10) || 'URL: u/' || doc_id || chr(10) || body ORDER BY n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM docs) WHERE n <= 3 GROUP BY source) SELECT source, array_to_string(x, chr(10) || chr(10)) || chr(10) || chr(10) || 'Question: why?' AS prompt FROM t")
def rag_prompt(s, d):
    c = corpus(s, d).withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n <= 3")
    hit = F.struct("n", "title", F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"), F.col("body").alias("text"))
    return c.groupBy("source").agg(F.array_sort(F.collect_list(hit)).alias("h")).select("source", fusion.rag_prompt(F.col("h"), "why?").alias("prompt"))
