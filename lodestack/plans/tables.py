"""The driver's tables in the roles of a retrieval corpus, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import lexical
from lodestack.storage import Files, new_folder, ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its counterpart."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """table over all cores if it has fewer row groups than there are cores, since a row group is read by one task; tables of more are read as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if row_groups(table, cores) < cores else table


def row_groups(table: DataFrame, most: int) -> int:
    """Row groups of a Parquet table's files, from their footers, as far as ``most``."""
    spark, n = table.sparkSession, 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in table.inputFiles()[:most]:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            n += reader.getRowGroups().size()
        finally:
            reader.close()
        if n >= most:
            break
    return n


_INDEXES: dict[tuple[str, str, str], tuple[str, lexical.LexicalIndex]] = {}


def stored_index(spark: SparkSession, d: str, scope: str = "documents") -> lexical.LexicalIndex:
    """The lexical index of documents (title and body) or of their passages: built on first use, stored in the shared folder, and used by all queries."""
    key = (spark.sparkContext.applicationId, d, scope)
    if key not in _INDEXES or not Files(spark).exists(f"{_INDEXES[key][0]}/index.json"):
        folder = new_folder(spark, f"lexical-{scope}")
        unique = lexical.unique_keys(corpus(spark, d), ["doc_id"])  # so passages' ids are unique as well
        if scope == "documents":
            built = lexical.build_index(corpus(spark, d), ["title", "body"], folder, "doc_id", unique=unique)
        else:
            built = lexical.build_index(passages(spark, d).select("passage_id", F.col("text").alias("passage")), ["passage"], folder, "passage_id", unique=unique)
        _INDEXES[key] = folder, built
    return _INDEXES[key][1]


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, title (first line), body, lang, source, n_chars."""
    t = read(spark, d, "documents")
    return t.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), "lang", "source", "n_chars")


def with_metadata(spark: SparkSession, d: str) -> DataFrame:
    """corpus plus a JSON object: lang, source, n_chars and, for labelled documents, quality and toxic."""
    lab = read(spark, d, "labels")
    t = corpus(spark, d).join(lab, "doc_id", "left")
    return t.withColumn("metadata", F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic")))


FIELDS = ["lang", "n_chars", "quality", "source", "toxic"]


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as a change log: id, op, seq, generation, segment, value, event_type."""
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("seq"),
        F.expr("event_id div 100").alias("generation"), F.expr("event_id div 1000").alias("segment"), "value", "event_type",
    )


def passages(spark: SparkSession, d: str) -> DataFrame:
    """Fixed windows of 400 code points, 50 shared with the one before: doc_id, ordinal, start_char, end_char, text, passage_id."""
    from lodestack.functions.text import window_passages

    t = read(spark, d, "documents").select("doc_id", F.inline(window_passages(F.col("text"))))
    return t.withColumn("passage_id", F.concat_ws(":", "doc_id", "ordinal"))


# -- the same in SQL

WORDS = r"[\p{L}\p{M}\p{N}]+"
DOCS = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, lang, source, n_chars FROM documents)"
META = f"{DOCS}, md AS (SELECT docs.*, quality, toxic FROM docs LEFT JOIN labels USING (doc_id))"
TK = f"{DOCS}, tk AS (SELECT doc_id, regexp_extract_all(lower(title), '{WORDS}') AS tt, regexp_extract_all(lower(body), '{WORDS}') AS tb FROM docs)"
OCC = (
    f"{TK}, occ AS (SELECT doc_id, 'title' AS field, unnest(tt) AS term, generate_subscripts(tt, 1) - 1 AS pos, len(tt) AS field_len FROM tk "
    "UNION ALL SELECT doc_id, 'body', unnest(tb), generate_subscripts(tb, 1) - 1, len(tb) FROM tk)"
)
POST = (
    f"{OCC}, post AS (SELECT term, doc_id, count(*) FILTER (field = 'title') AS tf_title, coalesce(max(field_len) FILTER (field = 'title'), 0) AS len_title, "
    "count(*) FILTER (field = 'body') AS tf_body, coalesce(max(field_len) FILTER (field = 'body'), 0) AS len_body FROM occ GROUP BY term, doc_id)"
)
STATS = "st AS (SELECT count(*) AS n, sum(len(tt)) AS tokens_title, sum(len(tb)) AS tokens_body FROM tk)"


def bm25f_sql(terms: list[str], where: str = "true", minimum: int = 1, name: str = "hits") -> str:
    """CTEs up to ``hits``(doc_id, score, matched) for these terms; statistics over all documents."""
    quoted = ", ".join(f"'{t}'" for t in terms)
    w = "(CASE WHEN tf_title > 0 THEN 2e0 * tf_title / (0.25e0 + 0.75e0 * len_title / (CASE WHEN tokens_title > 0 THEN tokens_title::DOUBLE / n ELSE 1e0 END)) ELSE 0e0 END + CASE WHEN tf_body > 0 THEN 1e0 * tf_body / (0.25e0 + 0.75e0 * len_body / (CASE WHEN tokens_body > 0 THEN tokens_body::DOUBLE / n ELSE 1e0 END)) ELSE 0e0 END)"
    return (
        f"{POST}, {STATS}, qp AS (SELECT * FROM post WHERE term IN ({quoted})), dfs AS (SELECT term, count(*) AS df FROM qp GROUP BY term), "
        f"sc AS (SELECT doc_id, {w} AS w, df, n FROM qp JOIN dfs USING (term), st WHERE doc_id IN (SELECT doc_id FROM md0 WHERE {where})), "
        f"{name} AS (SELECT doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * w * 2.2e0 / (1.2e0 + w)), 6) AS score, count(*) AS matched FROM sc GROUP BY doc_id HAVING count(*) >= {minimum})"
    ).replace("docs AS (", "md0 AS (SELECT documents.doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id), docs AS (", 1)


PASS = (
    "ps AS (SELECT doc_id, o AS ordinal, o * 350 AS start_char, least(o * 350 + 400, length(text)) AS end_char, substring(text, o * 350 + 1, 400) AS text, doc_id || ':' || o AS passage_id "
    "FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 400) / 350e0)) AS BIGINT) + 1)) AS o FROM documents))"
)
LOG = "lg AS (SELECT user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS seq, event_id // 100 AS generation, event_id // 1000 AS segment, value, event_type FROM events)"
LAST = f"{LOG}, la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY id ORDER BY generation DESC, seq DESC) = 1)"
