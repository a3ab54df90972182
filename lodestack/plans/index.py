"""A versioned index: immutable Parquet segments, JSON manifests, atomic generations, search, retrieval, compaction, maintenance.

A segment holds ``events`` (the change records, in buckets by id), ``passages`` (with their vectors, in buckets by document), and per scope, documents or
passages, ``postings`` (in buckets by term, sorted by term, with positions) and ``objects`` (lengths and, for documents, the parsed metadata). A search
reads postings of its terms, or vectors, never texts; the texts of a page's few rows are read by id at the end.

Beside the segments lie ``_manifest`` (a file per generation), ``_stats`` and ``_stale`` (statistics of a generation and its superseded rows, computed once),
``_ann`` (an inverted file of vectors per generation), ``_wal`` (unpublished batches), ``_lock`` and ``_status.json``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.filters import compile_filter, metadata_map
from lodestack.functions.text import query_tokens, sentence_passages, snippets
from lodestack.operators import ann, fusion, lexical, vector, versions
from lodestack.plans.config import IndexConfig, SearchRequest
from lodestack.sources.ingest import duplicate_ids, parse_ops
from lodestack.storage import Files, ship


class GenerationConflict(RuntimeError):
    """Another writer published first, or is writing."""


class CorruptIndex(RuntimeError):
    """Stored files aren't what the manifest says."""


@dataclass(frozen=True)
class ApplyResult:
    generation: int
    accepted: int
    upserts: int
    deletes: int
    segment_ids: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    """One generation: what it names never changes."""

    generation: int
    manifest: dict

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]


DOCUMENT = "op id url title body metadata updated_at_unix_ms".split()
EVENTS = "op string, id string, url string, title string, body string, metadata string, updated_at_unix_ms long, generation long"
PASSAGES = "passage_id string, document_id string, ordinal int, start_char int, end_char int, text string, embedding array<float>, generation long"
FIELDS = {"documents": ("title", "body"), "passages": ("passage",)}
#: Columns that go with an object: what a deletion or update of its document is recognised by.
CARRY = {"documents": ("generation",), "passages": ("doc", "generation")}
PARENT = {"documents": "id", "passages": "doc"}
LEASE = 3600.0
ENTRY = "map<string,array<struct<type:string,num:double,str:string,bool:boolean>>>"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


class Index:
    """An index folder on a file system that the driver and all executors share.

    ``hooks`` maps names of points (staged, written, logged, published, compacted) to callables, so that tests can fail there.
    """

    def __init__(self, spark: SparkSession, folder: str, config: IndexConfig, hooks: dict[str, Callable[[], None]] | None = None):
        ship(spark)
        self.spark, self.folder, self.config, self.hooks = spark, str(folder).rstrip("/"), config, hooks or {}
        self.files = Files(spark)
        self._seen: dict[int, dict] = {}  # statistics of generations, which never change

    @classmethod
    def create(cls, spark: SparkSession, folder: str, config: IndexConfig) -> "Index":
        index = cls(spark, folder, config)
        index.files.mkdirs(f"{index.folder}/_manifest")
        index._publish(0, {"generation": 1, "config": config.fingerprint(), "segments": [], "batch_id": None})
        return index

    @classmethod
    def build(cls, spark: SparkSession, folder: str, config: IndexConfig, lines: DataFrame) -> "Index":
        """A new index from NDJSON upserts (column value, and a column line if there are numbers), made aside and renamed when whole; ValueError
        names the first line that is anything else."""
        aside = f"{folder}.{uuid.uuid4().hex}.building"
        index = cls.create(spark, aside, config)
        numbered = [c for c in ("line",) if c in lines.columns]
        ops = parse_ops(lines.select("value", *numbered))
        bad = ops.where("error is not null or op <> 'upsert'").orderBy(*numbered, "error").select(*numbered, F.coalesce("error", F.lit("not_an_upsert")).alias("error")).limit(1).collect()
        if bad:
            index.files.delete(aside)
            raise ValueError(f"a build takes valid upserts only: {bad[0].asDict()}")
        index.apply(ops)
        index.files.rename(aside, folder)
        return cls(spark, folder, config)

    def _at(self, point: str) -> None:
        if point in self.hooks:
            self.hooks[point]()

    # -- manifests

    def generations(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.files.names(f"{self.folder}/_manifest") if n.endswith(".json") and n.split(".")[0].isdigit())

    def generation(self) -> int:
        return max(self.generations(), default=0)

    def manifest(self, generation: int | None = None) -> dict:
        m = json.loads(self.files.read(f"{self.folder}/_manifest/{generation or self.generation()}.json"))
        if m["config"] != self.config.fingerprint():
            raise ValueError("the index was built with another configuration")
        return m

    def snapshot(self, generation: int | None = None) -> Snapshot:
        m = self.manifest(generation)
        return Snapshot(m["generation"], m)

    def reload(self, held: Snapshot) -> Snapshot:
        """The current snapshot; CorruptIndex if it is older than the held one, or another manifest of the same generation."""
        now = self.snapshot()
        if now.generation < held.generation or now.generation == held.generation and now.manifest != held.manifest:
            raise CorruptIndex(f"generation {now.generation} doesn't follow {held.generation}")
        return now

    def _publish(self, expected: int, manifest: dict) -> int:
        """Write the next generation if ``expected`` is still the current one: a whole file gets its name at once."""
        if self.generation() != expected:
            raise GenerationConflict(f"generation {expected} is not current")
        if not self.files.write_new(f"{self.folder}/_manifest/{expected + 1}.json", json.dumps(manifest | {"generation": expected + 1})):
            raise GenerationConflict(f"generation {expected + 1} exists")
        return expected + 1

    @contextmanager
    def _writing(self):
        """One writer at a time; a lock older than LEASE seconds was left behind."""
        path, own = f"{self.folder}/_lock", uuid.uuid4().hex
        if self.files.exists(path) and self.files.age(path) > LEASE:
            self.files.delete(path)
        if not self.files.write_new(path, own):
            raise GenerationConflict("another writer holds the lock")
        try:
            yield
        finally:
            if self.files.exists(path) and self.files.read(path) == own:
                self.files.delete(path)

    # -- tables of one generation

    def _table(self, part: str, schema: str, segments: list[dict]) -> DataFrame:
        out, names = None, lexical.schema_of(schema).names
        for s in segments:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{s['id']}/{part}").select(names)  # no partition columns
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def events(self, generation: int | None = None) -> DataFrame:
        return self._table("events", EVENTS, self.manifest(generation)["segments"])

    def documents(self, generation: int | None = None) -> DataFrame:
        """Visible documents."""
        snap = self.snapshot(generation)
        return self._live(self._table("events", EVENTS, snap.segments).where("op = 'upsert'"), snap, "id")

    def passages(self, generation: int | None = None, document_id: str | None = None) -> DataFrame:
        """Visible passages: those that came with their document's visible version."""
        snap = self.snapshot(generation)
        p = self._table("passages", PASSAGES, snap.segments) if document_id is None else self._by_key("passages", PASSAGES, snap, "document_id", [document_id])
        p = self._live(p, snap, "document_id")
        return p.orderBy("ordinal") if document_id is not None else p

    def _by_key(self, part: str, schema: str, snap: Snapshot, key: str, keys: list[str]) -> DataFrame:
        """The rows of a bucketed part with these few keys: only their buckets are read, and the filter goes to the pages."""
        out = None
        for s in snap.segments:
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.folder}/{s['id']}/{part}")
            own = F.lit(False)
            for k in keys:
                own = own | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(k)), F.lit(s["buckets"])).cast("int"))
            rows = rows.where(own & F.col(key).isin(keys)).drop("bucket")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def _objects(self, scope: str, snap: Snapshot) -> DataFrame:
        own = ", ".join(["id string", *(["doc string"] if scope == "passages" else []), "generation long", *[f"len_{f} long" for f in FIELDS[scope]], *([f"meta {ENTRY}"] if scope == "documents" else [])])
        return self._table(f"objects-{scope}", own, snap.segments)

    def _known(self, snap: Snapshot) -> dict:
        """Statistics of a generation, visible and physical, and the number of its superseded rows: computed once, then read."""
        if snap.generation in self._seen:
            return self._seen[snap.generation]
        path = f"{self.folder}/_stats/{snap.generation}.json"
        if not self.files.exists(path):
            narrow = self._table("events", "op string, id string, generation long", snap.segments)
            last = versions.latest(narrow, order=("generation",)).where("op = 'upsert'")
            stale = narrow.where("op = 'upsert'").join(last.select("id", "generation"), ["id", "generation"], "left_anti").select("id", "generation")
            stale.write.mode("overwrite").parquet(f"{self.folder}/_stale/{snap.generation}")
            known = {"stale": self._stale(snap).count()}
            for scope, fields in FIELDS.items():
                objects = self._objects(scope, snap)
                known[f"physical-{scope}"] = lexical.index_stats(objects, list(fields))
                live = objects.join(self._stale(snap).withColumnRenamed("id", PARENT[scope]), [PARENT[scope], "generation"], "left_anti")
                known[scope] = lexical.index_stats(live, list(fields)) if known["stale"] else known[f"physical-{scope}"]
            self.files.write_new(path, json.dumps(known))
        self._seen[snap.generation] = json.loads(self.files.read(path))
        return self._seen[snap.generation]

    def _stale(self, snap: Snapshot) -> DataFrame:
        return self.spark.read.schema("id string, generation long").parquet(f"{self.folder}/_stale/{snap.generation}")

    def _live(self, rows: DataFrame, snap: Snapshot, parent: str) -> DataFrame:
        """rows (parent, generation) of visible documents: without the superseded ones, if there are any."""
        if not self._known(snap)["stale"]:
            return rows
        return rows.join(self._stale(snap).withColumnRenamed("id", parent), [parent, "generation"], "left_anti").select(*rows.columns)

    # -- writing

    def prepare(self, documents: DataFrame) -> DataFrame:
        """Passages of documents (id, body)."""
        chunk = sentence_passages(self.config.chunk_max_chars, self.config.chunk_overlap_chars)
        return documents.select(F.col("id").alias("document_id"), F.inline(chunk("id", "body")))

    def apply(self, ops: DataFrame, batch_id: int | None = None) -> ApplyResult:
        """Apply one batch (op, id, url, title, body, metadata, updated_at_unix_ms, vectors), all or nothing, as one generation.

        ops is evaluated once. A batch of more text than a segment should hold becomes several segments, documents whole. A batch whose ``batch_id`` the
        index already holds is not applied again, so a replayed micro-batch changes nothing.
        """
        with self._writing():
            self._recover()
            stage = f"{self.folder}/_staging/{uuid.uuid4().hex}"
            try:
                return self._apply(ops, batch_id, stage)
            finally:
                self.files.delete(stage)

    def _apply(self, ops: DataFrame, batch_id: int | None, stage: str) -> ApplyResult:
        current = self.generation()
        manifest = self.manifest(current)
        if batch_id is not None and manifest["batch_id"] is not None and manifest["batch_id"] >= batch_id:
            return ApplyResult(current, 0, 0, 0, ())
        kept = [*DOCUMENT, *[c for c in ("vectors", "error") if c in ops.columns]]
        ops.select(*kept).write.parquet(f"{stage}/ops")
        self._at("staged")
        ops = self.spark.read.schema(ops.select(*kept).schema).parquet(f"{stage}/ops")
        kind = lambda op: F.coalesce(F.sum((F.col("op") == op).cast("long")), F.lit(0))
        text = F.coalesce(F.octet_length("title"), F.lit(0)).cast("long") + F.coalesce(F.octet_length("body"), F.lit(0))
        wrong = F.sum(F.col("error").isNotNull().cast("long")) if "error" in kept else F.lit(0)
        c = ops.agg(F.count("*").alias("n"), kind("upsert").alias("u"), kind("delete").alias("d"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes"), F.count_distinct("id").alias("ids"), F.coalesce(wrong, F.lit(0)).alias("bad")).first()
        if c["n"] == 0:
            return ApplyResult(current, 0, 0, 0, ())
        if c["bad"]:
            raise ValueError("the batch holds invalid operations")
        if c["u"] + c["d"] != c["n"] or c["ids"] != c["n"]:
            raise ValueError("the batch holds unknown operations, an id twice or none")
        g, slices = current + 1, versions.slice_count(c["bytes"])
        if slices > 1:
            ops.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).write.partitionBy("_slice").parquet(f"{stage}/slices")
        entries = []
        for k in range(slices):
            part = ops if slices == 1 else self.spark.read.schema(ops.schema).parquet(f"{stage}/slices/_slice={k}") if self.files.exists(f"{stage}/slices/_slice={k}") else None
            if part is not None:
                entries.append(self._write_segment(part, g, c["bytes"] // slices, f"{stage}/{k}"))
        self._at("written")
        new = manifest | {"segments": manifest["segments"] + entries, "batch_id": batch_id if batch_id is not None else manifest["batch_id"]}
        log = f"{self.folder}/_wal/{uuid.uuid4().hex}.json"
        self.files.write_new(log, json.dumps({"base": current, "manifest": new}))
        self._at("logged")
        self._publish(current, new)
        self._at("published")
        self.files.delete(log)
        return ApplyResult(g, c["n"], c["u"], c["d"], tuple(e["id"] for e in entries))

    def _recover(self) -> None:
        """Finish or forget batches whose writer ended between writing and publishing: replayed if the index still stands where they began.
        A log whose batch was published, or overtaken, goes; the segments of the latter are garbage."""
        for name in self.files.names(f"{self.folder}/_wal"):
            path = f"{self.folder}/_wal/{name}"
            if not name.endswith(".json"):
                continue
            held = json.loads(self.files.read(path))
            if held["base"] == self.generation():
                known = {s["id"] for s in self.manifest()["segments"]}
                self._check_files([s for s in held["manifest"]["segments"] if s["id"] not in known])
                self._publish(held["base"], held["manifest"])
            self.files.delete(path)

    def recover(self) -> int:
        """Replay what a lost writer left; returns the generation."""
        with self._writing():
            self._recover()
        return self.generation()

    def _write_segment(self, ops: DataFrame, g: int, text_bytes: int, stage: str) -> dict:
        segment, buckets = f"segment-{uuid.uuid4().hex}", lexical.bucket_count(text_bytes)
        at, gen = f"{self.folder}/{segment}", F.lit(g).cast("long").alias("generation")
        upserts = ops.where("op = 'upsert'")
        chunks = self.prepare(upserts)
        if self.config.vectors:
            chunks.write.parquet(f"{stage}/passages")
            chunks = self.spark.read.schema(chunks.schema).parquet(f"{stage}/passages")
            given = upserts.select(F.col("id").alias("document_id"), F.size("vectors").alias("_n"), F.col("vectors"))
            made = chunks.groupBy("document_id").agg(F.count("*").alias("_c"))
            wrong = given.join(made, "document_id", "full_outer").where("coalesce(_n, 0) <> coalesce(_c, 0)")
            bad = given.where(F.exists("vectors", lambda v: (F.size(v) != self.config.dimensions) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 3.4028234663852886e38))))
            if wrong.limit(1).count() or bad.limit(1).count():
                raise ValueError("every passage needs one finite vector of the index's dimensions")
            chunks = chunks.join(given, "document_id").withColumn("embedding", F.get("vectors", F.col("ordinal")).cast("array<float>"))
        else:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        passages = chunks.select("passage_id", "document_id", "ordinal", "start_char", "end_char", "text", "embedding", gen)
        documents = upserts.select("id", gen, "title", "body", "metadata")

        def write_passages() -> None:
            self._write_rows(passages, "document_id", "ordinal", buckets, f"{at}/passages")
            stored = self.spark.read.schema(PASSAGES).parquet(f"{at}/passages")
            objects = stored.select(F.col("passage_id").alias("id"), F.col("document_id").alias("doc"), "generation", F.col("text").alias("passage"))
            self._write_scope("passages", objects, buckets, at)

        self._together(lambda: self._write_rows(ops.select(*DOCUMENT, gen), "id", "id", buckets, f"{at}/events"), write_passages, lambda: self._write_scope("documents", documents, buckets, at))
        return self._entry(segment, g, text_bytes, buckets)

    @staticmethod
    def _together(*jobs: Callable[[], None]) -> None:
        """Independent jobs side by side."""
        with ThreadPoolExecutor(len(jobs)) as pool:
            for done in [pool.submit(job) for job in jobs]:
                done.result()

    @staticmethod
    def _write_rows(rows: DataFrame, key: str, order: str, buckets: int, path: str) -> None:
        placed = rows.withColumn("bucket", _bucket(key, buckets))
        placed.repartition("bucket").sortWithinPartitions("bucket", key, order).write.partitionBy("bucket").parquet(path)

    def _write_scope(self, scope: str, objects: DataFrame, buckets: int, at: str) -> None:
        fields, carry, profile = list(FIELDS[scope]), CARRY[scope], self.config.tokenizer_id
        if scope == "documents":
            meta = metadata_map(F.col("metadata"), list(self.config.filterable_fields)).cast(ENTRY) if self.config.filterable_fields else F.lit(None).cast(ENTRY)
            objects = objects.withColumn("meta", meta)
        lexical.write_postings(objects, fields, f"{at}/postings-{scope}", buckets, "id", carry, profile)
        lengths = [F.size(lexical.profile_tokens(F.col(f), profile)).cast("long").alias(f"len_{f}") for f in fields]
        own = objects.select("id", *carry, *lengths, *(["meta"] if scope == "documents" else []))
        self._write_rows(own, "id", "id", buckets, f"{at}/objects-{scope}")

    def _entry(self, segment: str, g: int, text_bytes: int, buckets: int) -> dict:
        at = f"{self.folder}/{segment}"
        rows = self.spark.read.schema(EVENTS).parquet(f"{at}/events").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("op") == "delete").cast("long")), F.lit(0)).alias("d")).first()
        passages = self.spark.read.schema(PASSAGES).parquet(f"{at}/passages").count()
        return {"id": segment, "bytes": self.files.size(at), "rows": rows["n"], "tombstones": rows["d"], "passages": passages, "generation": g, "text_bytes": int(text_bytes), "buckets": buckets, "fingerprint": self._fingerprint(segment)}

    def _fingerprint(self, segment: str) -> str:
        """A digest of the digests of a segment's files, computed where the files are read."""
        f = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{segment}")
        line = F.concat_ws(" ", F.element_at(F.split("path", f"/{segment}/"), -1), F.col("length").cast("string"), F.sha2("content", 256))
        return f.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")).first()["h"]  # a line per file

    def _check_files(self, segments: list[dict]) -> None:
        for s in segments:
            if not self.files.exists(f"{self.folder}/{s['id']}") or self._fingerprint(s["id"]) != s["fingerprint"]:
                raise CorruptIndex(f"{s['id']} isn't what its manifest says")

    # -- maintenance

    def status(self) -> dict:
        """The state of the last compaction: running, succeeded, failed, or interrupted if its writer is gone."""
        path = f"{self.folder}/_status.json"
        if not self.files.exists(path):
            return {"state": "none"}
        s = json.loads(self.files.read(path))
        return s | {"state": "interrupted"} if s["state"] == "running" and time.time() - s["started"] > LEASE else s

    def compact(self, manual: bool = True, **policy) -> dict | None:
        """Rewrite the chosen range of segments as one; None if the policy finds nothing. Segments appended meanwhile survive."""
        before = self.manifest()
        chosen = versions.choose_range([s["bytes"] for s in before["segments"]], manual=manual, **policy)
        if chosen is None:
            return None
        status = {"state": "running", "started": time.time(), "range": list(chosen)}
        self.files.write(f"{self.folder}/_status.json", json.dumps(status))
        try:
            done = self._compact(before, *chosen)
        except BaseException as e:
            self.files.write(f"{self.folder}/_status.json", json.dumps(status | {"state": "failed", "error": f"{type(e).__name__}: {e}"[:500]}))
            raise
        self.files.write(f"{self.folder}/_status.json", json.dumps(status | {"state": "succeeded", "ended": time.time()} | done))
        return done

    def _compact(self, before: dict, start: int, length: int) -> dict:
        old = before["segments"][start : start + length]
        self._check_files(old)
        narrow = self._table("events", "op string, id string, generation long", old)
        last = versions.latest(narrow, order=("generation",))
        if length == len(before["segments"]):  # only then nothing older can come back
            last = last.where("op = 'upsert'")
        segment, text_bytes = f"segment-{uuid.uuid4().hex}", sum(s["text_bytes"] for s in old)
        at, buckets = f"{self.folder}/{segment}", lexical.bucket_count(text_bytes)
        kept = last.select("id", "generation")
        live = last.where("op = 'upsert'").select("id", "generation")
        only = lambda rows, ids, parent: rows.join(ids.withColumnRenamed("id", parent), [parent, "generation"], "left_semi").select(*rows.columns)

        def merge(scope: str) -> None:
            snap = Snapshot(0, before | {"segments": old})
            post = self._postings(scope, snap, False).postings()
            lexical.store_postings(only(post, live, PARENT[scope]), f"{at}/postings-{scope}", buckets)
            self._write_rows(only(self._objects(scope, snap), live, PARENT[scope]), "id", "id", buckets, f"{at}/objects-{scope}")

        self._together(
            lambda: self._write_rows(only(self._table("events", EVENTS, old), kept, "id"), "id", "id", buckets, f"{at}/events"),
            lambda: self._write_rows(only(self._table("passages", PASSAGES, old), live, "document_id"), "document_id", "ordinal", buckets, f"{at}/passages"),
            lambda: merge("documents"),
            lambda: merge("passages"),
        )
        entry = self._entry(segment, before["generation"], text_bytes, buckets)
        self._at("compacted")
        with self._writing():
            now = self.manifest()
            if now["segments"][start : start + length] != old:
                raise GenerationConflict("the range changed while it was rewritten")
            g = self._publish(now["generation"], now | {"segments": now["segments"][:start] + [entry] + now["segments"][start + length :]})
        return {"generation": g, "rows": entry["rows"], "removed": sum(s["rows"] for s in old) - entry["rows"]}

    def collect_garbage(self, keep: int | None = None, min_age: float = 24 * 3600.0) -> list[str]:
        """Remove segments that no retained generation and no logged batch names, and older than ``min_age`` seconds, so that a running
        writer's stay. ``keep``: how many of the latest generations are retained, all if None; older manifests go."""
        gone = []
        kept = self.generations()[-keep:] if keep else self.generations()
        for g in self.generations():
            if g not in kept:
                for path in (f"_manifest/{g}.json", f"_stats/{g}.json", f"_stale/{g}"):
                    self.files.delete(f"{self.folder}/{path}")
        held = sorted((n for n in self.files.names(f"{self.folder}/_ann") if self.files.exists(f"{self.folder}/_ann/{n}/base.json")), key=int)
        for n in held[:-1]:  # only the newest base is searched
            if self.files.age(f"{self.folder}/_ann/{n}") >= min_age:
                self.files.delete(f"{self.folder}/_ann/{n}")
        named = {s["id"] for g in kept for s in self.manifest(g)["segments"]}
        for name in self.files.names(f"{self.folder}/_wal"):
            named |= {s["id"] for s in json.loads(self.files.read(f"{self.folder}/_wal/{name}"))["manifest"]["segments"]}
        for n in self.files.names(self.folder):
            if n.startswith("segment-") and n not in named and self.files.age(f"{self.folder}/{n}") >= min_age:
                self.files.delete(f"{self.folder}/{n}")
                gone.append(n)
        return gone

    def maintain(self, **policy) -> dict:
        """One round of upkeep: replay a lost batch, compact if the policy asks for it, renew the vector base, collect garbage."""
        self.recover()
        compacted = self.compact(manual=False, **policy)
        return {"compacted": compacted, "ann": self.maintain_ann(), "garbage": self.collect_garbage()}

    def verify(self) -> list[str]:
        """Broken rules of the current generation: files that differ from their digests, repeated or orphaned passages, gaps, bad vectors, bad postings,
        and segment folders that nothing names."""
        snap = self.snapshot()
        out = []
        for s in snap.segments:
            try:
                self._check_files([s])
            except CorruptIndex as e:
                out.append(str(e))
        if out:
            return out
        p = self.passages()
        if duplicate_ids(p, "passage_id").limit(1).count():
            out.append("duplicate passage")
        if p.groupBy("document_id").agg(F.max("ordinal").alias("m"), F.count("*").alias("n")).where("m + 1 <> n").limit(1).count():
            out.append("passage ordinals have gaps")
        if p.join(self.documents().select(F.col("id").alias("document_id")), "document_id", "left_anti").limit(1).count():
            out.append("passage without its document")
        if self.config.vectors and p.where(F.size("embedding") != self.config.dimensions).limit(1).count():
            out.append("vector of wrong dimensions")
        for scope, fields in FIELDS.items():
            if lexical.posting_violations(self._postings(scope, snap, False).postings(), list(fields)).limit(1).count():
                out.append(f"bad postings of {scope}")
        named = {s["id"] for g in self.generations() for s in self.manifest(g)["segments"]}
        return out + [f"orphan {n}" for n in self.files.names(self.folder) if n.startswith("segment-") and n not in named]

    # -- vectors

    def _vectors(self, segments: list[dict]) -> DataFrame:
        return self._table("passages", "passage_id string, document_id string, embedding array<float>, generation long", segments)

    def ann_base(self) -> dict | None:
        """The newest stored inverted file: generation, segments (id, fingerprint) and its model."""
        held = [n for n in self.files.names(f"{self.folder}/_ann") if self.files.exists(f"{self.folder}/_ann/{n}/base.json")]
        return json.loads(self.files.read(f"{self.folder}/_ann/{max(held, key=int)}/base.json")) if held else None

    def build_ann(self) -> dict | None:
        """Store an inverted file of the current generation's visible vectors; None without vectors. Written under its generation, so that a newer one is never replaced."""
        snap = self.snapshot()
        path = f"{self.folder}/_ann/{snap.generation}"
        if not self.config.vectors or self.files.exists(f"{path}/base.json"):
            return self.ann_base()
        rows = self._live(self._vectors(snap.segments), snap, "document_id")
        model = ann.fit(rows, self.config.metric, "passage_id")
        if model is None:
            return None
        rows.withColumn("cell", ann.cell_of(model, rows)).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        base = {"generation": snap.generation, "segments": [[s["id"], s["fingerprint"]] for s in snap.segments], "model": model.dump()}
        self.files.write_new(f"{path}/base.json", json.dumps(base))
        return base

    def ann_plan(self, snap: Snapshot) -> dict:
        """Which segments the stored base covers, by id and fingerprint; the others are searched exactly."""
        base = self.ann_base()
        held = {tuple(x) for x in base["segments"]} if base else set()
        now = [(s["id"], s["fingerprint"]) for s in snap.segments]
        return {"base": base, "covered": [s for s, k in zip(snap.segments, now) if k in held], "delta": [s for s, k in zip(snap.segments, now) if k not in held], "missing": len(held - set(now))}

    def maintain_ann(self, most: int = 8) -> str:
        """Renew the base if there is none, more than ``most`` segments aren't in it, or it has some that are gone."""
        plan = self.ann_plan(self.snapshot())
        if not self.config.vectors or plan["base"] and len(plan["delta"]) <= most and not plan["missing"]:
            return "kept"
        return "built" if self.build_ann() else "empty"

    def _near(self, request: SearchRequest, snap: Snapshot) -> DataFrame:
        """Visible vectors that may be nearest: the probed cells of the base and all of the segments it doesn't cover."""
        plan = self.ann_plan(snap)
        if request.exact or not plan["base"] or plan["missing"]:
            return self._live(self._vectors(snap.segments), snap, "document_id")
        import numpy as np

        model = ann.AnnModel.load(plan["base"]["model"])
        cells = [int(c) for c in model.cells(np.array([request.vector], np.float64), model.probes)[0]]
        stored = self.spark.read.schema("passage_id string, document_id string, embedding array<float>, generation long, cell int").parquet(f"{self.folder}/_ann/{plan['base']['generation']}/vectors")
        return self._live(stored.where(F.col("cell").isin(cells)).drop("cell").unionByName(self._vectors(plan["delta"])), snap, "document_id")

    # -- searching

    def _postings(self, scope: str, snap: Snapshot, visible: bool, stats: dict | None = None) -> lexical.LexicalIndex:
        fields, parent = FIELDS[scope], PARENT[scope]
        own = ", ".join(["term string", "id string", *(["doc string"] if scope == "passages" else []), "generation long", *[f"tf_{f} long, len_{f} long, pos_{f} array<int>" for f in fields], "bucket int"])
        parts = tuple((f"{self.folder}/{s['id']}/postings-{scope}", s["buckets"]) for s in snap.segments)
        live = (lambda rows: self._live(rows, snap, parent)) if visible else (lambda rows: rows)
        return lexical.LexicalIndex(self.spark, parts, lexical.schema_of(own), fields, stats or {}, "id", live)

    def candidates(self, request: SearchRequest, snap: Snapshot | None = None) -> DataFrame:
        """Fused hits (id, lexical_score, vector_score, fused_score, position) of a checked request."""
        request.check(self.config)
        snap = snap or self.snapshot()
        known, scope, k = self._known(snap), request.scope, request.candidate_k
        physical = request.stats_scope == "physical"  # stale and deleted versions count until they are compacted away
        allowed = None
        if request.filter is not None:
            allowed = self._objects("documents", snap).where(compile_filter(request.filter, list(self.config.filterable_fields))).select("id", "generation")

        def where(rows: DataFrame, parent: str = PARENT[scope], live: bool = physical) -> DataFrame:
            rows = self._live(rows, snap, parent) if live else rows
            return rows if allowed is None else rows.join(allowed.withColumnRenamed("id", parent), [parent, "generation"], "left_semi").select(*rows.columns)

        lex = vec = self.spark.createDataFrame([], "id string, score double")
        if request.mode != "vector":
            terms = query_tokens(request.query, self.config.tokenizer_id)
            stats = known[f"physical-{scope}" if physical else scope]
            index = self._postings(scope, snap, not physical, stats)
            lex = lexical.top(index.score(terms, request.operator, terms if request.phrase else None, where), k).select("id", "score")
        if request.mode != "lexical":
            q = self.spark.range(1).select(vector.literal(list(request.vector)).alias("q"))
            scored = vector.score_vectors(where(self._near(request, snap), "document_id", False), q, self.config.metric)
            if scope == "documents":
                vec = vector.best_per_document(scored, F.col("document_id"), k).select(F.col("document_id").alias("id"), "score")
            else:
                vec = scored.select(F.col("passage_id").alias("id"), "score").orderBy(F.desc("score"), "id").limit(k)
        w_lex, w_vec = {"lexical": (1.0, 0.0), "vector": (0.0, 1.0)}.get(request.mode, (request.w_lex, request.w_vec))
        return fusion.rrf(lex, vec, request.offset + request.limit + 1, w_lex, w_vec)

    def _page(self, request: SearchRequest, snap: Snapshot) -> tuple[list, bool]:
        """A page's hits (at most 100) and whether there are more."""
        hits = self.candidates(request, snap).where(F.col("position") > request.offset).orderBy("position").collect()
        return hits[: request.limit], len(hits) > request.limit

    def _documents_of(self, ids: list[str], snap: Snapshot) -> DataFrame:
        return self._live(self._by_key("events", EVENTS, snap, "id", ids).where("op = 'upsert'"), snap, "id")

    def _passages_of(self, ids: list[str], snap: Snapshot) -> DataFrame:
        """Passages by id: their documents' ids first, then the rows of those documents."""
        own = self._by_key("objects-passages", "id string, doc string, generation long", snap, "id", ids)
        docs = sorted({r["doc"] for r in self._live(own, snap, "doc").select("doc").collect()})  # one per hit
        rows = self._by_key("passages", PASSAGES, snap, "document_id", docs).where(F.col("passage_id").isin(ids))
        return self._live(rows, snap, "document_id")

    HIT = "id string, lexical_score double, vector_score double, fused_score double, position int"

    def search(self, request: SearchRequest, snap: Snapshot | None = None) -> DataFrame:
        """A page of results with title, url and snippet; the texts of the page's rows alone are read, by id."""
        snap = snap or self.snapshot()
        return self._results(self._page(request, snap)[0], request, snap)

    def _results(self, hits: list, request: SearchRequest, snap: Snapshot) -> DataFrame:
        page, ids = self.spark.createDataFrame([tuple(h) for h in hits], self.HIT), [h["id"] for h in hits]
        terms = [request.query, *query_tokens(request.query, self.config.tokenizer_id)] if request.query else []
        if request.scope == "documents":
            texts = self._documents_of(ids, snap).select("id", F.col("id").alias("document_id"), "title", "url", F.col("body").alias("_text"))
        else:
            own = self._passages_of(ids, snap).select(F.col("passage_id").alias("id"), "document_id", F.col("text").alias("_text"))
            parents = self._documents_of([r["document_id"] for r in own.select("document_id").distinct().collect()], snap) if ids else self._documents_of([], snap)
            texts = own.join(parents.select(F.col("id").alias("document_id"), "title", "url"), "document_id")
        rows = texts.join(F.broadcast(page), "id")  # a page
        return rows.select("id", "document_id", "title", "url", snippets("_text", terms).alias("snippet"), "lexical_score", "vector_score", "fused_score", "position").orderBy("position")

    def retrieve(self, request: SearchRequest, snap: Snapshot | None = None) -> DataFrame:
        """One row: context, used_bytes, citations (passage_id, document_id, url, title, text, start_char, end_char, context_start, context_end and scores) of the best passages."""
        snap = snap or self.snapshot()
        request = replace(request, scope="passages", offset=0, cursor=None)
        hits, _ = self._page(request, snap)
        page, ids = self.spark.createDataFrame([tuple(h) for h in hits], self.HIT), [h["id"] for h in hits]
        own = self._passages_of(ids, snap)
        parents = self._documents_of(sorted({r["document_id"] for r in own.select("document_id").collect()}), snap)
        rows = own.join(parents.select(F.col("id").alias("document_id"), "title", "url"), "document_id").join(F.broadcast(page.withColumnRenamed("id", "passage_id")), "passage_id")
        if rows.count() != len(hits):
            raise CorruptIndex("a hit has no passage")
        rows = rows.select(F.col("position").alias("rank"), "passage_id", "document_id", "url", "title", "text", "start_char", "end_char", "lexical_score", "vector_score", "fused_score")
        folded = fusion.context_fold(rows, request.limit, request.max_passages_per_document, request.max_context_bytes)
        names = ("passage_id", "document_id", "url", "title", "text", "start_char", "end_char", "lexical_score", "vector_score", "fused_score")
        cited = F.transform("citations", lambda c: F.struct(*[c[n].alias(n) for n in names], c["start"].alias("context_start"), c["end"].alias("context_end")))
        return folded.select("context", "used_bytes", cited.alias("citations"))

    def response(self, request: SearchRequest) -> dict:
        """The page as a JSON-ready answer with its cursor; ``request.cursor`` continues an earlier answer of the same generation and request."""
        snap, digest = self.snapshot(), request.digest()
        if request.cursor is not None:
            request = replace(request, offset=fusion.decode_cursor(request.cursor, snap.generation, digest), cursor=None)
        hits, more = self._page(request, snap)
        rows = [r.asDict() for r in self._results(hits, request, snap).collect()] if hits else []
        return {"generation": snap.generation, "total": len(rows), "hits": rows, "next_cursor": fusion.encode_cursor(snap.generation, digest, request.offset + request.limit) if more else None}
