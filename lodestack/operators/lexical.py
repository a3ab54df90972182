"""Lexical search: occurrences, stored postings, BM25F with OR, AND and phrase matching, over any number of documents.

A stored index is a Parquet table of postings, in buckets by the hash of the term and sorted by term inside a bucket, beside a table
of objects with their lengths. A query reads the buckets of its terms, in them the pages that hold those terms, and no text; what is shuffled
is rows of query terms. Statistics come with the index. ``score`` searches a table that has no index, in two scans of its texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.scoring import bm25f, field_weight
from lodestack.functions.text import profile_tokens, tokens
from lodestack.storage import Files, materialize, ship

BOOSTS = {"title": 2.0, "body": 1.0, "passage": 1.0}
BLOCK = 128


def occurrences(objects: DataFrame, fields: list[str], key: str = "id", terms: list[str] | None = None) -> DataFrame:
    """(key, field, pos, term, field_len) for every token, or only for ``terms`` (filtered before the rows are made)."""
    t = objects.select(key, *[tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)])
    arrays = []
    for i, f in enumerate(fields):
        pairs = F.transform(f"_t{i}", _placed(f, f"_t{i}"))
        arrays.append(pairs if terms is None else F.filter(pairs, lambda p: p["term"].isin(terms)))
    return t.select(key, F.inline(F.concat(*arrays)))


def corpus_stats(objects: DataFrame, fields: list[str]) -> DataFrame:
    """One row: n objects and the token total of each field."""
    return objects.select(*[F.size(tokens(F.col(f))).alias(f) for f in fields]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f"tokens_{f}") for f in fields])


def postings(occ: DataFrame, fields: list[str], key: str = "id", positions: bool = False) -> DataFrame:
    """(term, key, tf_<field>, len_<field>...): one row per term and object; positions sorted per field on demand."""
    return occ.groupBy("term", key).agg(*_posting_aggs(fields, positions))


def _posting_aggs(fields: list[str], positions: bool) -> list[Column]:
    aggs = []
    for f in fields:
        here = F.col("field") == f
        aggs += [F.sum(F.when(here, 1).otherwise(0)).cast("long").alias(f"tf_{f}"), F.coalesce(F.max(F.when(here, F.col("field_len"))), F.lit(0)).cast("long").alias(f"len_{f}")]
        if positions:
            aggs.append(F.sort_array(F.collect_list(F.when(here, F.col("pos")))).alias(f"pos_{f}"))
    return aggs


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def score(objects: DataFrame, terms: list[str], fields: list[str], key: str = "id", boosts: dict[str, float] | None = None, operator: str = "or", phrase: list[str] | None = None, where: Column | None = None, stats_over: DataFrame | None = None) -> DataFrame:
    """(key, score, matched): objects (one row per key) with a positive BM25F score under ``operator``, and the phrase if one is given.

    Two scans and no shuffle: one aggregates the statistics to one row, the other scores rows in place.
    ``where`` filters objects (it is pushed below tokenising); statistics are those of ``stats_over`` (default: objects before ``where``).
    """
    boosts = boosts or BOOSTS
    distinct = list(dict.fromkeys(terms))
    everything = stats_over if stats_over is not None else objects
    if not distinct:
        return objects.where(F.lit(False)).select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"))
    mine = objects if where is None else objects.where(where)
    some = lambda i: reduce(lambda a, b: a | b, [F.size(F.filter(f"_q_{f}", _is(distinct[i]))) > 0 for f in fields])
    totals = [F.coalesce(F.sum(f"len_{f}"), F.lit(0)).cast("double").alias(f"tokens_{f}") for f in fields]
    stats = _query_tokens(everything, distinct, fields, key).agg(F.count("*").cast("double").alias("n"), *totals, *[F.sum(some(i).cast("long")).cast("double").alias(f"df_{i}") for i in range(len(distinct))])
    rows = _query_tokens(mine, distinct, fields, key).where(reduce(lambda a, b: a | b, [F.size(f"_q_{f}") > 0 for f in fields]))
    rows = rows.crossJoin(F.broadcast(stats))  # one row: a second scan instead of a shuffle
    parts = []
    for i, term in enumerate(distinct):
        tf = {f: F.size(F.filter(f"_q_{f}", _is(term))).cast("double") for f in fields}
        weight = reduce(lambda a, b: a + b, [field_weight(tf[f], F.col(f"len_{f}").cast("double"), F.col(f"tokens_{f}") / F.col("n"), boosts[f]) for f in fields])
        parts.append(F.struct(weight.alias("w"), F.col(f"df_{i}").alias("df")))
    rows = rows.select(key, "n", F.filter(F.array(*parts), lambda p: p["w"] > 0).alias("_p"))
    total = F.aggregate("_p", F.lit(0.0), lambda a, p: a + bm25f(p["w"], F.col("n"), p["df"]))
    hits = rows.select(key, F.round(total, 6).alias("score"), F.size("_p").cast("long").alias("matched")).where("score > 0")
    if operator == "and" or phrase:
        hits = hits.where(F.col("matched") == len(distinct))
    if phrase:
        hits = hits.join(phrase_objects(mine, phrase, fields, key), key, "left_semi")
    return hits


# -- stored postings

#: Objects' texts of this many bytes share a bucket of postings.
BUCKET_BYTES = 64 << 20
MAX_BUCKETS = 4096
SALTS = 8


def bucket_count(text_bytes: int) -> int:
    """A power of two, so that indexes of different sizes have few different numbers of buckets."""
    return min(MAX_BUCKETS, 1 << max(0, -(-text_bytes // BUCKET_BYTES) - 1).bit_length())


def write_postings(objects: DataFrame, fields: list[str], path: str, buckets: int, key: str = "id", carry: tuple[str, ...] = (), profile: str = "simple", unique: bool | None = None) -> None:
    """Postings of objects (key, fields, and the columns ``carry``, which go with each posting), with positions: one shuffle, of postings and not of occurrences.

    An object is inverted where it is read. If keys repeat (``unique`` says that they don't; None: they are counted), their postings are merged.
    """
    store_postings(object_postings(objects, fields, key, carry, profile, unique=unique), path, buckets, key)


def store_postings(post: DataFrame, path: str, buckets: int, key: str = "id") -> None:
    """Postings in buckets by term, sorted by term. A bucket is dealt to salts by key, each of which is one partition: it holds postings of some 8 MB of
    text, so it is sorted in memory, and since a term has one posting an object, no term makes a hot task."""
    salts = min(SALTS, 4 * buckets)
    placed = post.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    place = F.col("bucket") * salts + F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(salts)).cast("int")
    placed.repartitionById(buckets * salts, place).sortWithinPartitions("bucket", "term", key).write.partitionBy("bucket").parquet(path)


def object_postings(objects: DataFrame, fields: list[str], key: str = "id", carry: tuple[str, ...] = (), profile: str = "simple", positions: bool = True, unique: bool | None = None) -> DataFrame:
    """inverted(), with the postings of keys that repeat merged; only for those is anything shuffled."""
    post = inverted(objects, fields, key, carry, profile, positions)
    if unique_keys(objects, [key, *carry]) if unique is None else unique:
        return post
    merged = [x for f in fields for x in (F.sum(f"tf_{f}").alias(f"tf_{f}"), F.max(f"len_{f}").alias(f"len_{f}"), *([F.sort_array(F.flatten(F.collect_list(f"pos_{f}"))).alias(f"pos_{f}")] if positions else []))]
    return post.groupBy("term", key, *carry).agg(*merged)


def unique_keys(objects: DataFrame, names: list[str]) -> bool:
    return not objects.groupBy(*names).count().where("count > 1").limit(1).count()


def inverted(objects: DataFrame, fields: list[str], key: str = "id", carry: tuple[str, ...] = (), profile: str = "simple", positions: bool = True) -> DataFrame:
    """(term, key, carry, tf_<field>, len_<field>, pos_<field>): the postings of every object (row), made in Arrow batches where the object is read, without a shuffle."""
    ship(objects.sparkSession)
    names = [key, *carry]
    t = objects.select(*names, *[profile_tokens(F.col(f), profile).alias(f"_t{i}") for i, f in enumerate(fields)])
    kind = dict(t.dtypes)
    own = [x for f in fields for x in (f"tf_{f} long", f"len_{f} long", *([f"pos_{f} array<int>"] if positions else []))]
    return t.mapInArrow(_inverter(names, fields, positions), schema_of(", ".join(["term string", *[f"`{n}` {kind[n]}" for n in names], *own])))


#: Tokens that are inverted at once, about.
INVERT = 1 << 20


def _inverter(names: list[str], fields: list[str], positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(pc.list_value_length(batch.column(f"_t{i}")).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(fields)))
            chunk = np.cumsum(sizes) // INVERT
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if sizes[a:b].any():
                    yield _invert(batch.slice(a, b - a), names, fields, positions)

    return run


def _invert(batch: pa.RecordBatch, names: list[str], fields: list[str], positions: bool) -> pa.RecordBatch:
    n, lengths, docs, places, kinds, words = batch.num_rows, [], [], [], [], []
    for i in range(len(fields)):
        column = batch.column(f"_t{i}")
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        total = int(size.sum())
        lengths.append(size)
        docs.append(np.repeat(np.arange(n), size))
        places.append(np.arange(total) - np.repeat(np.cumsum(size) - size, size))
        kinds.append(np.full(total, i, np.int8))
        words.append(column.flatten())
    coded = pa.concat_arrays(words).dictionary_encode()
    both = coded.indices.to_numpy().astype(np.int64) * n + np.concatenate(docs)
    order = np.argsort(both, kind="stable")  # by term and object, then by field and place
    both, kind = both[order], np.concatenate(kinds)[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    term, doc = both[first] // n, both[first] % n
    out = {"term": coded.dictionary.take(pa.array(term)).cast(pa.string())} | {c: batch.column(c).take(pa.array(doc)) for c in names}
    place = np.concatenate(places)[order].astype(np.int32)
    for i, f in enumerate(fields):
        here = kind == i
        tf = np.add.reduceat(here.astype(np.int64), first)
        out |= {f"tf_{f}": pa.array(tf), f"len_{f}": pa.array(np.where(tf > 0, lengths[i][doc], 0))}
        if positions:
            out[f"pos_{f}"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tf))).astype(np.int32)), pa.array(place[here]))
    return pa.RecordBatch.from_pydict(out)


def write_objects(objects: DataFrame, fields: list[str], path: str, key: str = "id", carry: tuple[str, ...] = (), profile: str = "simple") -> None:
    """One row per object: key, the columns ``carry``, and the length of each field."""
    objects.select(key, *carry, *[F.size(profile_tokens(F.col(f), profile)).cast("long").alias(f"len_{f}") for f in fields]).write.parquet(path)


def index_stats(objects: DataFrame, fields: list[str]) -> dict:
    """n and tokens_<field> of a stored table of objects."""
    row = objects.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f"tokens_{f}") for f in fields]).first()
    return row.asDict()


def _same(rows: DataFrame) -> DataFrame:
    return rows


@dataclass(frozen=True)
class LexicalIndex:
    """Stored postings of one kind of objects: parts (path, buckets) of one schema, statistics, and a filter of rows that don't count."""

    spark: object
    parts: tuple[tuple[str, int], ...]
    schema: object
    fields: tuple[str, ...]
    stats: dict
    key: str = "id"
    live: Callable[[DataFrame], DataFrame] = _same

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """The postings, or only those of ``terms``: their buckets, and the filter on the term goes to the Parquet pages."""
        by: dict[int, list[str]] = {}
        for path, buckets in self.parts:
            by.setdefault(buckets, []).append(path)
        found = []
        for buckets, paths in sorted(by.items()):
            rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in paths])
            if terms is not None:
                own = reduce(lambda a, b: a | b, [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms])
                rows = rows.where(own & F.col("term").isin(terms))
            found.append(rows)
        rows = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.schema)
        return self.live(rows)

    def _weighted(self, rows: DataFrame, boosts: dict[str, float]) -> Column:
        """A posting's weighted frequency over all fields."""
        n = self.stats["n"]
        parts = [field_weight(F.col(f"tf_{f}").cast("double"), F.col(f"len_{f}").cast("double"), F.lit(float(self.stats[f"tokens_{f}"]) / n if n else 0.0), boosts[f]) for f in self.fields]
        return reduce(lambda a, b: a + b, parts)

    def score(self, terms: list[str], operator: str = "or", phrase: list[str] | None = None, where: Callable[[DataFrame], DataFrame] = _same, boosts: dict[str, float] | None = None) -> DataFrame:
        """(key, score, matched) as ``score`` gives them; ``where`` keeps the postings of objects that may be found."""
        distinct = list(dict.fromkeys(terms))
        post = self.postings(distinct) if distinct else self.postings([""]).where(F.lit(False))
        df = post.groupBy("term").agg(F.count("*").cast("double").alias("df"))
        mine = where(post)
        rows = mine.join(F.broadcast(df), "term")  # a row per query term
        value = bm25f(self._weighted(rows, boosts or BOOSTS), F.lit(float(self.stats["n"])), F.col("df"))
        hits = rows.select(self.key, value.alias("_s")).groupBy(self.key).agg(F.round(F.sum("_s"), 6).alias("score"), F.count("*").alias("matched")).where("score > 0")
        if operator == "and" or phrase:
            hits = hits.where(F.col("matched") == len(distinct))
        if phrase:
            hits = hits.join(self.phrase(phrase, where), self.key, "left_semi")
        return hits

    def phrase(self, phrase: list[str], where: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
        """Keys of objects in which the tokens follow one another in one field, from stored positions."""
        rows = where(self.postings(list(dict.fromkeys(phrase))))
        places = [F.transform(f"pos_{f}", _of_field(f)) for f in self.fields]
        return _runs(rows.select(self.key, "term", F.inline(F.concat(*places))), phrase, self.key)

    def score_many(self, queries: DataFrame, k: int, boosts: dict[str, float] | None = None, profile: str = "simple") -> DataFrame:
        """(query_id, key, score, rank): the best k of every query (query_id, query), each read whole.

        Postings of the queries' terms are dealt to blocks of objects and scored by a matrix product, queries in blocks as well; what leaves a block
        is its best k of each query, so no pair of a query and an object is a row.
        """
        spark = self.spark
        ship(spark)
        wanted = queries.select("query_id", F.explode(F.array_distinct(profile_tokens(F.col("query"), profile))).alias("term")).distinct()
        asked = max(1, -(-wanted.select("query_id").distinct().count() // QUERY_BLOCK))
        wanted = wanted.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(asked)).cast("int"))
        df = materialize(document_frequency(self.postings().join(wanted.select("term").distinct(), "term", "left_semi")), "frequencies")
        terms = wanted.select("qb", "term").distinct().join(df, "term")
        blocks = max(1, -(-int(terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]) // (POSTING_BLOCK * asked)))
        scored = self.postings().join(terms, "term")
        scored = scored.select("qb", F.pmod(F.xxhash64(self.key), F.lit(blocks)).cast("int").alias("ob"), F.col(self.key).alias("_key"), "term", bm25f(self._weighted(scored, boosts or BOOSTS), F.lit(float(self.stats["n"])), F.col("df").cast("double")).alias("_s"))
        given = wanted.groupBy("qb", "query_id").agg(F.collect_list("term").alias("terms")).select(F.col("qb").alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_ob"), "query_id", "terms")
        kind = dict(scored.dtypes)["_key"], dict(wanted.dtypes)["query_id"]
        at = lambda rows, *by: rows.repartition(asked * blocks, *by).groupBy(*by)
        found = at(scored, "qb", "ob").cogroup(at(given, "_qb", "_ob")).applyInArrow(_best_of_block(k), f"query_id {kind[1]}, _key {kind[0]}, _s double")
        hits = found.select("query_id", F.col("_key").alias(self.key), F.round("_s", 6).alias("score")).where("score > 0")
        ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), self.key)))
        return ranked.where(F.col("rank") <= k)


#: Queries, postings and cells of the matrices of one block at most, about; queries of one product.
QUERY_BLOCK, POSTING_BLOCK, MATRIX, AT_ONCE = 16384, 1 << 21, 1 << 22, 512


def _best_of_block(k: int):
    def run(posts: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "_key": [], "_s": []}
        if posts.num_rows and asked.num_rows:
            coded, held = (pc.dictionary_encode(posts[c].combine_chunks()) for c in ("term", "_key"))
            order = np.argsort(held.indices.to_numpy(), kind="stable")
            doc, term, score = held.indices.to_numpy()[order], coded.indices.to_numpy()[order], posts["_s"].to_numpy()[order]
            lists = asked["terms"].combine_chunks()
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
            codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=coded.dictionary), -1).to_numpy(zero_copy_only=False)
            docs, width = len(held.dictionary), len(coded.dictionary)
            step = max(1, min(AT_ONCE, MATRIX // docs))
            for a in range(0, asked.num_rows, step):
                b = min(a + step, asked.num_rows)
                mine, who = codes[starts[a] : starts[b]], np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
                own = np.unique(mine[mine >= 0])
                if not len(own):
                    continue
                place = np.full(width, -1)
                place[own] = np.arange(len(own))
                q, s = np.zeros((b - a, len(own))), np.empty((b - a, docs))
                q[who[mine >= 0], place[mine[mine >= 0]]] = 1
                some = place[term] >= 0
                d, t, x = doc[some], place[term[some]], score[some]
                rows = max(1, MATRIX // max(len(own), AT_ONCE))
                for lo in range(0, docs, rows):
                    i, j = np.searchsorted(d, (lo, lo + rows))
                    m = np.zeros((min(rows, docs - lo), len(own)))
                    m[d[i:j] - lo, t[i:j]] = x[i:j]
                    np.matmul(q, m.T, out=s[:, lo : lo + rows])
                # all that can be among the best k when scores are rounded to 6 places and ties are broken by key
                least = np.partition(s, docs - k, axis=1)[:, docs - k] - 2e-6 if docs > k else np.full(b - a, -np.inf)
                i, j = np.nonzero((s >= least[:, None]) & (s > 0))
                for name, x in (("query_id", asked["query_id"].take(pa.array(i + a)).combine_chunks()), ("_key", held.dictionary.take(pa.array(j))), ("_s", pa.array(s[i, j]))):
                    out[name].append(x)
        kinds = {"query_id": asked.schema.field("query_id").type, "_key": posts.schema.field("_key").type, "_s": pa.float64()}
        return pa.table({n: pa.chunked_array(x, kinds[n]) for n, x in out.items()})

    return run


def build_index(objects: DataFrame, fields: list[str], folder: str, key: str = "id", carry: tuple[str, ...] = (), profile: str = "simple", unique: bool | None = None) -> LexicalIndex:
    """Store the postings and lengths of a table of objects (key, fields) below folder, and its statistics. ``unique``: as in write_postings()."""
    spark = objects.sparkSession
    size = objects.agg(F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in fields])), F.lit(0))).first()[0]
    buckets = bucket_count(size)
    write_postings(objects, fields, f"{folder}/postings", buckets, key, carry, profile, unique)
    write_objects(objects, fields, f"{folder}/objects", key, carry, profile)
    stats = index_stats(spark.read.parquet(f"{folder}/objects"), fields)
    Files(spark).write(f"{folder}/index.json", json.dumps({"buckets": buckets, "stats": stats, "fields": fields, "key": key}))
    return LexicalIndex(spark, ((f"{folder}/postings", buckets),), posting_schema(objects, fields, key, carry), tuple(fields), stats, key)


def schema_of(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def posting_schema(objects: DataFrame, fields: list[str], key: str = "id", carry: tuple[str, ...] = ()):
    """The schema of write_postings() over objects."""
    kind = dict(objects.dtypes)
    own = ["term string", *[f"{c} {kind[c]}" for c in (key, *carry)]]
    return schema_of(", ".join([*own, *[f"tf_{f} long, len_{f} long, pos_{f} array<int>" for f in fields], "bucket int"]))


# -- scans


def _is(term: str):
    return lambda x: x == term


def _of_field(field: str):
    return lambda p: F.struct(F.lit(field).alias("field"), p.alias("pos"))


def _placed(field: str, column: str):
    return lambda x, at: F.struct(F.lit(field).alias("field"), at.alias("pos"), x.alias("term"), F.size(column).alias("field_len"))


def _query_tokens(objects: DataFrame, terms: list[str], fields: list[str], key: str) -> DataFrame:
    """key, len_<field> and the query's tokens of each field (``_q_<field>``)."""
    t = objects.select(key, *[tokens(F.col(f)).alias(f"_t_{f}") for f in fields])
    return t.select(key, *[F.size(f"_t_{f}").alias(f"len_{f}") for f in fields], *[F.filter(f"_t_{f}", lambda x: x.isin(terms)).alias(f"_q_{f}") for f in fields])


def phrase_objects(objects: DataFrame, phrase: list[str], fields: list[str], key: str = "id") -> DataFrame:
    """Keys of objects in which the tokens follow one another in one field: places minus query places that agree for all tokens."""
    return _runs(occurrences(objects, fields, key, list(dict.fromkeys(phrase))), phrase, key)


def _runs(occ: DataFrame, phrase: list[str], key: str) -> DataFrame:
    """Keys with all of the phrase's places: a relational division on position differences."""
    q = F.create_map(*[x for t in dict.fromkeys(phrase) for x in (F.lit(t), F.array(*[F.lit(i) for i, w in enumerate(phrase) if w == t]))])
    hits = occ.select(key, "field", "pos", F.explode(F.element_at(q, F.col("term"))).alias("qpos"))
    runs = hits.groupBy(key, "field", (F.col("pos") - F.col("qpos")).alias("start")).agg(F.count_distinct("qpos").alias("k"))
    return runs.where(F.col("k") == len(phrase)).select(key).distinct()


def top(hits: DataFrame, k: int, key: str = "id", by: str = "score") -> DataFrame:
    """The best k by score, ties by ascending key: a partial top-k per partition, then one merge."""
    return hits.orderBy(F.desc(by), F.asc(key)).limit(k)


def posting_blocks(post: DataFrame, field: str = "body", key: str = "id", block: int = BLOCK) -> DataFrame:
    """Per term and block of postings in key order: size, largest frequency, smallest length."""
    b = post.withColumn("block", F.floor((F.row_number().over(W.partitionBy("term").orderBy(key)) - 1) / block))
    return b.groupBy("term", "block").agg(F.count("*").alias("size"), F.max(f"tf_{field}").alias("max_tf"), F.min(f"len_{field}").alias("min_len"))


def posting_violations(post: DataFrame, fields: list[str]) -> DataFrame:
    """Postings that break an invariant: no occurrence at all, or more occurrences than tokens."""
    some = reduce(lambda a, b: a + b, [F.col(f"tf_{f}") for f in fields])
    bad = reduce(lambda a, b: a | b, [F.col(f"tf_{f}") > F.col(f"len_{f}") for f in fields])
    return post.where((some < 1) | bad)
