"""Text extraction by file kind, path selection, wiki dumps and sharded output."""

from __future__ import annotations

import codecs
import fnmatch
import hashlib
import json
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK = frozenset("p div section article header footer ul ol table tr br blockquote pre nav main title".split())
_OPENS = {**dict.fromkeys(_BLOCK, "\n"), "li": "\n- ", **{f"h{n}": "\n" + n * "#" + " " for n in range(1, 7)}}
_SKIP = frozenset("script style noscript".split())


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag in _OPENS:
            self.out.append(_OPENS[tag])

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _OPENS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """Readable text of a page: headings and list items marked, scripts and styles left out, one line per block."""
    p = _Html()
    p.feed(html)
    p.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(p.out).split("\n")]
    return "\n".join(x for x in lines if x and x != "-" and not re.fullmatch("#+", x))


def json_text(text: str) -> str:
    return json.dumps(json.loads(text), ensure_ascii=False, indent=2, sort_keys=True)


def jsonl_text(text: str) -> str:
    return "\n".join(json_text(line) for line in text.splitlines() if line.strip())


def xml_text(text: str) -> str:
    if "<!DOCTYPE" in text.upper():
        raise ValueError("document types are refused")
    return "\n".join(t for t in (x.strip() for x in ET.fromstring(text).itertext()) if t)


def plain_text(raw: bytes) -> str:
    """Decoded text with line feeds; ValueError for binary content."""
    for codec, *marks in (("utf-8-sig", codecs.BOM_UTF8), ("utf-16", codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        if raw.startswith(tuple(marks)):
            return re.sub("\r\n?", "\n", raw.decode(codec))
    if b"\0" in raw[:8192]:
        raise ValueError("binary content")
    return re.sub("\r\n?", "\n", raw.decode())


#: suffix -> text of its content; callers may register more.
EXTRACTORS: dict[str, Callable[[str], str]] = {".json": json_text, ".jsonl": jsonl_text, ".ndjson": jsonl_text, ".html": html_text, ".htm": html_text, ".xml": xml_text, ".txt": str, ".md": str}


def extract_one(path: str, raw: bytes, extractors: dict[str, Callable[[str], str]] | None = None) -> tuple[str | None, str | None]:
    """(text, error) of one file."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ".txt"
    found = {**EXTRACTORS, **(extractors or {})}.get(suffix)
    if found is None:
        return None, f"unsupported {suffix}"
    try:
        return found(plain_text(raw)), None
    except (ValueError, ET.ParseError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]


def extract(files: DataFrame, path: str = "path", content: str = "content", extractors: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """path, text, error for every file (content: binary or string)."""

    def run(frames):
        for pdf in frames:
            rows = [extract_one(p, c.encode() if isinstance(c, str) else bytes(c), extractors) for p, c in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "text": [r[0] for r in rows], "error": [r[1] for r in rows]})

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, text string, error string")


def html_to_text(html: Column | str) -> Column:
    """html_text() as an Arrow-batched column."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else html_text(h))

    return F.pandas_udf(run, "string")(html)


def directory(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files below a folder with relative NFC paths, selected by globs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return select_paths(files.withColumn("path", F.regexp_replace("path", "^[a-z]+:/+", "/")), include, exclude)


def select_paths(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, path: str = "path") -> DataFrame:
    """Files whose NFC path fits any included glob (all, if none are named) and no excluded one."""

    wanted, unwanted = ("|".join(map(fnmatch.translate, g or [])) for g in (include, exclude))

    def fits(paths: pd.Series) -> pd.Series:
        p = paths.fillna("").str.normalize("NFC")
        inside = p.str.match(wanted) if wanted else pd.Series(True, index=p.index)
        return inside & ~p.str.match(unwanted) if unwanted else inside

    return files.where(F.pandas_udf(fits, "boolean")(F.col(path)))


def select_groups(files: DataFrame, groups: list[list[str]], path: str = "path") -> DataFrame:
    """Files whose path fits, for every group, one of its regular expressions."""
    for patterns in groups:
        files = files.where(reduce(lambda a, b: a | b, [F.col(path).rlike(p) for p in patterns]))
    return files


def snapshot_hash(files: DataFrame) -> DataFrame:
    """One digest over (path, digest, mtime) of all files, without collecting them: digests of hash buckets, then of these."""
    line = F.concat_ws("\0", "path", "digest", F.col("mtime").cast("string"))
    buckets = files.groupBy(F.pmod(F.xxhash64("path"), F.lit(4096)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("snapshot"), F.sum("n").alias("files"))


def wiki_documents(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, url, title, body (and the columns ``keep``) of wiki pages: blank texts skipped, the first of each id kept, only http(s) urls."""
    p = pages.where(F.trim("text") != "").withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("n"))).where("_n = 1")
    url = F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise("")
    return p.select("id", url.alias("url"), F.trim("title").alias("title"), F.trim("text").alias("body"), *keep)


def newline_normalize(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def shard_manifest(rows: DataFrame, shard: Column, text: Column) -> DataFrame:
    """Per shard: documents, bytes, a digest that doesn't depend on row order, failures left out."""
    return rows.select(shard.alias("shard"), F.octet_length(text).cast("long").alias("b"), F.substring(F.sha2(text, 256), 1, 15).alias("h")).groupBy("shard").agg(
        F.count("*").alias("documents"), F.sum("b").alias("bytes"), F.min("h").alias("first_hash"), F.max("h").alias("last_hash")
    )


def write_shards(rows: DataFrame, folder: str, per_file: int = 10_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Write rows as NDJSON shards of at most ``per_file`` lines and ``max_bytes`` bytes (or one line, if that is longer); returns the stored manifest
    (path, documents, bytes, sha256), which alone says what belongs to the folder. Every task streams its rows, a line at a time."""
    from urllib.parse import urlsplit

    from lodestack.storage import materialize

    target = folder if urlsplit(folder).scheme else f"file://{folder}"

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        sink, done = None, []

        def close():
            sink.close()
            done.append((path, count, size, digest.hexdigest()))

        for b in batches:
            for line in b.column("line").to_pylist():
                raw = line.encode() + b"\n"
                if sink is not None and (count == per_file or size + len(raw) > max_bytes):
                    close()
                    sink = None
                if sink is None:
                    path = f"{base}/{uuid.uuid4().hex}.ndjson"
                    sink, count, size, digest = fs.open_output_stream(path, compression=None), 0, 0, hashlib.sha256()
                sink.write(raw)
                digest.update(raw)
                count, size = count + 1, size + len(raw)
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "documents", "bytes", "sha256"])

    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line"))
    return materialize(lines.mapInArrow(save, "path string, documents long, bytes long, sha256 string"), "shards")


def wiki_dump(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Documents of extracted wiki dumps: lines of {id, revid, url, title, text}, plain, .gz or .bz2. The first of each id in the order of files and lines
    stays; with ``limit``, only the first so many documents."""
    pages = spark.read.schema("id string, revid long, url string, title string, text string").json(paths)
    pages = pages.withColumn("n", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))).where("id is not null and text is not null")
    if limit is None:
        return wiki_documents(pages)
    return wiki_documents(pages, keep=("n",)).orderBy("n").limit(limit).drop("n")


def convert(files: DataFrame, folder: str, collection: str, part_bytes: int = 1 << 20, per_file: int = 10_000, extractors: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """Turn files (path, content) into document shards and a failure shard; returns the manifest (kind, documents, bytes).

    Long texts become several documents with stable ids. A file that can't be read fails alone.
    """
    from lodestack.functions.text import split_body, stable_document_id
    from lodestack.storage import materialize

    done = materialize(extract(files, extractors=extractors), "extracted")
    parts = done.where("error is null").select("path", F.posexplode(split_body(part_bytes)("text")).alias("part", "body"))
    docs = parts.select(F.lit("upsert").alias("operation"), stable_document_id(collection, F.col("path"), F.col("part")).alias("id"), F.col("path").alias("url"), "body")
    write_shards(docs, f"{folder}/documents", per_file)
    write_shards(done.where("error is not null").select("path", "error"), f"{folder}/failures", per_file)
    good = docs.agg(F.lit("documents").alias("kind"), F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).cast("long").alias("bytes"))
    return good.unionByName(done.where("error is not null").agg(F.lit("failures").alias("kind"), F.count("*").alias("documents"), F.lit(0).cast("long").alias("bytes")))


def embedding_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("none")), F.lit(" | text: "), text)


def query_prompt(query: str) -> str:
    return f"task: search result | query: {query}"
