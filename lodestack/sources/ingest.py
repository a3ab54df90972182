"""Change records: strict NDJSON, JSON batches, TSV; contracts; precomputed embeddings.

Bad records become rows with an ``error``; nothing is raised per record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPSERT_KEYS = "operation id url title body metadata updated_at_unix_ms vectors".split()
MAX_ID, MAX_TITLE, MAX_URL, MAX_BODY = 255, 255, 8 << 10, 1 << 20
MAX_BATCH = 10_000


def canonical_json(text: Column) -> Column:
    """Keys sorted at every depth, no white space; null if the text isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def parse_ops(lines: DataFrame, column: str = "value") -> DataFrame:
    """op, id, url, title, body, metadata, updated_at_unix_ms, vectors, error for every NDJSON line; other columns are kept.

    Strict: exactly the known keys with their types, a deletion only has operation and id, no NUL, sizes within limits, vectors of one length.
    """
    v = F.try_parse_json(F.col(column))
    d = lines.withColumn("_v", v).withColumn("_keys", F.json_object_keys(F.to_json(F.col("_v"))))
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.variant_get("_v", f"$.{name}", "variant"))
    d = d.select(
        *lines.columns,
        "_v",
        "_keys",
        text("operation").alias("op"),
        text("id").alias("id"),
        F.coalesce(text("url"), F.lit("")).alias("url"),
        F.coalesce(text("title"), F.lit("")).alias("title"),
        text("body").alias("body"),
        F.coalesce(F.to_json(F.variant_get("_v", "$.metadata", "variant")), F.lit("{}")).alias("metadata"),
        F.coalesce(F.try_variant_get("_v", "$.updated_at_unix_ms", "bigint"), F.lit(0)).alias("updated_at_unix_ms"),
        F.try_variant_get("_v", "$.vectors", "array<array<float>>").alias("vectors"),
    )
    has = lambda name: F.array_contains("_keys", name)
    typed = lambda name, want: ~has(name) | (kind(name) == want)
    strings = typed("id", "STRING") & typed("url", "STRING") & typed("title", "STRING") & typed("body", "STRING")
    long = lambda c, n: F.octet_length(c) > n
    ragged = F.coalesce((F.size(F.array_distinct(F.transform("vectors", lambda x: F.size(x)))) > 1) | F.exists("vectors", lambda x: F.size(x) == 0), F.lit(False))
    nul = F.contains(F.concat_ws("", *UPSERT_KEYS[1:5]), F.lit("\0"))
    error = (
        F.when(F.col("_v").isNull() | F.col("_keys").isNull(), "invalid_json")
        .when(~F.coalesce(F.col("op").isin("upsert", "delete"), F.lit(False)), "invalid_operation")
        .when(~F.coalesce(strings, F.lit(False)) | F.coalesce(F.col("id"), F.lit("")).eqNullSafe(""), "invalid_field")
        .when((F.col("op") == "delete") & (F.size("_keys") != 2), "delete_with_fields")
        .when(F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in UPSERT_KEYS]))) > 0, "unknown_key")
        .when((F.col("op") == "upsert") & ~has("body"), "missing_body")
        .when(has("metadata") & ~kind("metadata").startswith("OBJECT"), "invalid_metadata")
        .when(has("updated_at_unix_ms") & ((kind("updated_at_unix_ms") != "BIGINT") | (F.col("updated_at_unix_ms") < 0)), "invalid_timestamp")
        .when(has("vectors") & (F.col("vectors").isNull() | ragged), "invalid_vectors")
        .when(nul, "nul_byte")
        .when(long("id", MAX_ID) | long("title", MAX_TITLE) | long("url", MAX_URL) | F.coalesce(long("body", MAX_BODY), F.lit(False)) | long("metadata", MAX_BODY), "out_of_range")
    )
    return d.withColumn("error", error).drop("_v", "_keys")


def parse_batch(batches: DataFrame, column: str = "value") -> DataFrame:
    """One row (batch columns, pos, value) per operation of {"operations": [...]}; a batch of another shape or size is one row with pos -1 and no
    value, which parse_ops() finds invalid."""
    v = F.try_parse_json(F.col(column))
    ops = F.try_variant_get(v, "$.operations", "array<variant>")
    ok = (F.size(F.json_object_keys(F.to_json(v))) == 1) & F.size(ops).between(1, MAX_BATCH)
    others = [c for c in batches.columns if c != column]
    told = batches.select(*others, F.when(F.coalesce(ok, F.lit(False)), ops).alias("_ops"))
    return told.select(*others, F.posexplode_outer("_ops").alias("pos", "_o")).select(*others, F.coalesce("pos", F.lit(-1)).alias("pos"), F.to_json("_o").alias(column))


def split_lines(buffers: DataFrame, column: str = "value") -> DataFrame:
    """One row (buffer columns, line from 1, value, error) per line of a buffer of NDJSON: a carriage return before the line feed is left out, an empty line is an
    error, and so is all of a buffer of more than ``MAX_BATCH`` lines, as one row with line 0."""
    others = [c for c in buffers.columns if c != column]
    lines = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\r\n", "\n"), "\n$", ""), "\n", -1)
    many = F.size("_l") > MAX_BATCH
    d = buffers.select(*others, lines.alias("_l")).select(*others, many.alias("_many"), F.posexplode(F.when(many, F.array(F.lit(""))).otherwise(F.col("_l"))).alias("_p", column))
    error = F.when(F.col("_many"), "too_many_lines").when(F.col(column) == "", "empty_line")
    return d.select(*others, F.when(F.col("_many"), 0).otherwise(F.col("_p") + 1).alias("line"), column, error.alias("error"))


def parse_tsv(lines: DataFrame, column: str = "value") -> DataFrame:
    """op, id, url, title, body, error from ID, ADD or DELETE, TITLE, BODY_BYTES, BODY; the id is the url too."""
    p = F.split(F.col(column), "\t", 5)
    d = lines.select(*[c for c in lines.columns if c != column], F.get(p, F.lit(1)).alias("_k"), F.get(p, F.lit(0)).alias("id"), F.get(p, F.lit(2)).alias("title"), F.get(p, F.lit(3)).try_cast("int").alias("_n"), F.get(p, F.lit(4)).alias("body"), F.size(p).alias("_c"))
    error = F.when(F.col("_c") != 5, "invalid_columns").when(~F.col("_k").isin("ADD", "DELETE"), "invalid_operation").when(F.col("_n").isNull() | (F.octet_length("body") != F.col("_n")), "body_length")
    d = d.withColumn("error", error).withColumn("op", F.when(F.col("_k") == "DELETE", "delete").otherwise("upsert")).withColumn("url", F.col("id"))
    return d.drop("_k", "_n", "_c")


def upserts_only(ops: DataFrame) -> DataFrame:
    """Fails the job if a build holds anything but valid upserts."""
    return ops.where(F.assert_true((F.col("op") == "upsert") & F.col("error").isNull(), F.lit("a build takes valid upserts only")).isNull())


def document_errors(docs: DataFrame) -> Column:
    """Null, or the first broken rule of a document (id, url, title, body, updated_at_unix_ms)."""
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "empty_id")
        .when(F.octet_length("id") > MAX_ID, "id_length")
        .when(F.octet_length("title") > MAX_TITLE, "title_length")
        .when(F.octet_length("url") > MAX_URL, "url_length")
        .when(F.col("body").isNull() | (F.octet_length("body") > MAX_BODY), "body_length")
        .when(F.contains("body", F.lit("\0")), "nul_byte")
        .when(F.col("updated_at_unix_ms") < 0, "timestamp")
    )


def duplicate_ids(rows: DataFrame, key: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by, key).agg(F.count("*").alias("copies")).where("copies > 1")


def segment_violations(docs: DataFrame, passages: DataFrame, key: str = "id", parent: str = "document_id", passage: str = "passage_id") -> DataFrame:
    """(rule, key): repeated documents, repeated passages, passages without their document."""
    a = duplicate_ids(docs, key).select(F.lit("duplicate_document").alias("rule"), F.col(key).cast("string").alias("key"))
    b = duplicate_ids(passages, passage).select(F.lit("duplicate_passage").alias("rule"), F.col(passage).cast("string").alias("key"))
    c = passages.join(docs.select(F.col(key).alias(parent)), parent, "left_anti").select(F.lit("orphan_passage").alias("rule"), F.col(passage).cast("string").alias("key"))
    return a.unionByName(b).unionByName(c)


def attach_embeddings(passages: DataFrame, embeddings: DataFrame, key: str = "passage_id", id_: str = "id", vector: str = "embedding") -> DataFrame:
    return passages.join(embeddings.select(F.col(id_).alias(key), F.col(vector)), key)


def embedding_problems(passages: DataFrame, embeddings: DataFrame, dimensions: int, key: str = "passage_id", id_: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, problem): missing_id, duplicate_id, dimension_mismatch."""
    missing = passages.select(F.col(key).alias("key")).join(embeddings.select(F.col(id_).alias("key")), "key", "left_anti").withColumn("problem", F.lit("missing_id"))
    double = duplicate_ids(embeddings, id_).select(F.col(id_).alias("key"), F.lit("duplicate_id").alias("problem"))
    size = embeddings.where(F.size(vector) != dimensions).select(F.col(id_).alias("key"), F.lit("dimension_mismatch").alias("problem"))
    return missing.unionByName(double).unionByName(size)


class EmbeddingError(RuntimeError):
    """A provider's answer that can't be retried."""


def embed_texts(texts: list[str], transport: Callable[[list[str]], tuple[int, list[dict]]], batch: int = 1024, retries: int = 3, sleep: Callable[[float], None] = lambda s: None, delay: float = 0.5) -> Iterator[list[float]]:
    """Vectors in the order of texts from a provider that answers (status, [{index, embedding}]); transient statuses are retried with growing delays."""
    for at in range(0, len(texts), batch):
        part = texts[at : at + batch]
        for attempt in range(retries + 1):
            status, answer = transport(part)
            if status == 200:
                break
            if attempt == retries or not (status in (0, 408, 429) or status >= 500):
                raise EmbeddingError(f"status {status}")
            sleep(delay * 2**attempt)
        by = {a["index"]: a["embedding"] for a in answer}
        if sorted(by) != list(range(len(part))):
            raise EmbeddingError("the answer doesn't match the inputs")
        yield from (by[i] for i in range(len(part)))


def embed(passages: DataFrame, transport: Callable, batch: int = 1024, **options) -> DataFrame:
    """passages (passage_id, text) plus embedding, batch by batch on the executors."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(embedding=list(embed_texts(pdf["text"].tolist(), transport, batch, **options)))

    return passages.select("passage_id", "text").mapInPandas(run, "passage_id string, text string, embedding array<double>")


def embed_resumable(passages: DataFrame, folder: str, settings: str, transport: Callable, shards: int = 16, **options) -> DataFrame:
    """embed(), one written table per shard: shards that an earlier run finished are kept, and other settings or other passages are a ValueError.

    A shard counts as finished once its write has committed, so a run that was cut off repeats that shard only.
    """
    spark = passages.sparkSession
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda path: fs.exists(jvm.org.apache.hadoop.fs.Path(path))
    told = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("passage_id", "text").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    settings = f"{settings} of {told['n']} passages {told['h']}"
    if there(f"{folder}/settings"):
        if spark.read.text(f"{folder}/settings").first()[0] != settings:
            raise ValueError("the folder holds embeddings made with other settings or of other passages")
    else:
        spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(f"{folder}/settings")
    for k in range(shards):
        if not there(f"{folder}/shard={k}/_SUCCESS"):
            part = passages.where(F.pmod(F.xxhash64("passage_id"), F.lit(shards)) == k)
            embed(part, transport, **options).write.mode("overwrite").parquet(f"{folder}/shard={k}")
    return spark.read.parquet(*[f"{folder}/shard={k}" for k in range(shards)])


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key in this order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
