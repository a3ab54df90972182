"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts are lower-cased, and byte 1- to 4-grams are hashed into ``DIMS`` buckets; counts end at ``MOST``, in training and prediction alike. A model is
fitted on about ``SAMPLE`` labelled rows, at most twice that, drawn by a seeded hash of id and text in equal parts per language (the ``SAMPLE`` languages with the most rows): IDF weights, and per language ``CENTROIDS`` unit centroids found by
spherical k-means. A text's language is that of the centroid with the largest cosine, which is also the score. A text whose
cosine lies below its centroid's ``REJECT`` quantile of training cosines is marked ``rejected``; a text without a letter is ``und``.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = 4096
SAMPLE = 4000
CENTROIDS = 4
ROUNDS = 12
REJECT = 0.01
SEED = 20240607
_MUL = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]
PIECE = 1 << 18
MOST = 65535


def features(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the whole text, read in pieces of bounded size."""
    raw = (" " + text.lower() + " ").encode()
    out = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 3], np.uint8).astype(np.uint32)
        own = min(PIECE, len(raw) - at)
        h = np.zeros(len(b), np.uint32)
        for n in range(4):
            h = h[: len(b) - n] * np.uint32(_MUL[3]) + (b[n:] + np.uint32(1)) * np.uint32(_MUL[n]) if n else b * np.uint32(_MUL[0])
            k = h[:own]
            out += np.bincount(((k ^ (k >> np.uint32(15))) * np.uint32(_MUL[1]) >> np.uint32(20)).astype(np.int64), minlength=DIMS)
    return np.minimum(out, MOST)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log term frequency times inverse document frequency."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Model:
    """Centroids with their languages and rejection thresholds."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, least: np.ndarray):
        self.idf, self.langs, self.centroids, self.least = idf, langs, centroids, least

    @staticmethod
    def fit(counts: np.ndarray, langs: list[str], k: int = CENTROIDS) -> "Model":
        """counts: one row per sampled text, in a fixed order; langs: their languages."""
        df = (counts > 0).sum(axis=0)
        idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
        x = weigh(counts.astype(np.float32), idf).astype(np.float32)
        names, rows, least = [], [], []
        which = np.array(langs)
        for name in sorted(set(langs)):
            own = x[which == name]
            rng = np.random.default_rng(SEED)
            centre = own.mean(axis=0)
            c = [own[int(np.argmax(own @ centre))]]
            while len(c) < min(k, len(own)):  # the farthest of a few drawn texts begins the next cluster
                drawn = own[rng.choice(len(own), min(16, len(own)), replace=False)]
                c.append(drawn[int(np.argmin(np.max(drawn @ np.array(c).T, axis=1)))])
            c = np.array(c)
            for _ in range(ROUNDS):
                near = np.argmax(own @ c.T, axis=1)
                c = np.array([m / max(1e-12, np.linalg.norm(m)) if (near == j).any() else c[j] for j in range(len(c)) for m in [own[near == j].sum(axis=0)]])
            near = np.argmax(own @ c.T, axis=1)
            for j in range(len(c)):
                hit = (own[near == j] @ c[j]) if (near == j).any() else np.zeros(1)
                names.append(name)
                rows.append(c[j])
                least.append(float(np.quantile(hit, REJECT)))
        return Model(idf, names, np.array(rows, np.float32), np.array(least))

    def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        cos = weigh(counts.astype(np.float32), self.idf).astype(np.float64) @ self.centroids.T.astype(np.float64)
        cos = np.round(cos, 9)  # so that a batch's size doesn't show
        best = np.argmax(cos, axis=1)
        top = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)
        return [(self.langs[b], float(s), bool(s < self.least[b])) for b, s in zip(best, top)]


def held_out(doc_id: "F.Column"):
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on rows with text and language that aren't held out; None if there are none. At most about ``sample`` rows reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    per = max(1, sample // len(sizes))
    rates = known.sparkSession.createDataFrame([(lang, min(1.0, per / n)) for lang, n in sizes.items()], "lang string, rate double")
    key = F.xxhash64(F.lit(SEED), "doc_id", "text")
    rows = known.select(key.alias("key"), "doc_id", "lang", "text").join(F.broadcast(rates), "lang")  # at most ``sample`` languages
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) < F.col("rate")).dropDuplicates(["key", "lang"]).select("key", "doc_id", "lang", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for key, doc, lang, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "lang", "text"))):
                if has_letter(text):
                    yield pa.RecordBatch.from_pydict({"key": [key], "doc_id": [doc], "lang": [lang], "counts": [features(text).astype("<u2").tobytes()]}, schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("counts", pa.binary())]))

    found = drawn.mapInArrow(run, "key long, doc_id long, lang string, counts binary")
    rows = found.orderBy("key", "lang").limit(2 * sample + 64).collect()  # in the order of the hash: the same rows on every run
    if not rows:
        return None
    return Model.fit(np.array([np.frombuffer(r["counts"], "<u2") for r in rows]), [r["lang"] for r in rows])


def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        cos = weigh(counts.astype(np.float32), self.idf).astype(np.float64) @ self.centroids.T.astype(np.float64)
        cos = np.round(cos, 9)  # so that a batch's size doesn't show
        best = np.argmax(cos, axis=1)
        top = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)
        return [(self.langs[b], float(s), bool(s < self.least[b])) for b, s in zip(best, top)]


def held_out(doc_id: "F.Column"):
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on rows with text and language that aren't held out; None if there are none. At most about ``sample`` rows reach the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    per = max(1, sample // len(sizes))
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw < rate).select(F.xxhash64(F.lit(SEED), "doc_id").alias("key"), "doc_id", "lang", "text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for key, doc, lang, text in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "lang", "text"))):
                if has_letter(text):
                    c = np.minimum(features(text), 65535).astype("<u2")
                    yield pa.RecordBatch.from_pydict({"key": [key], "doc_id": [doc], "lang": [lang], "counts": [c.tobytes()]}, schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("counts", pa.binary())]))

    rows = drawn.mapInArrow(run, "key long, doc_id long, lang string, counts binary").limit(2 * sample + 64).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["key"], r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["counts"]))
    return Model.fit(np.array([np.frombuffer(r["counts"], "<u2") for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, rejected. Without a model every text is ``und``."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            texts, ids, held = b.column("text"), b.column("doc_id"), b.column("held")
            for at in range(0, b.num_rows, 128):
                part = [texts[i].as_py() for i in range(at, min(at + 128, b.num_rows))]
                found: list = [("und", 0.0, True)] * len(part)
                on = [i for i, t in enumerate(part) if m is not None and has_letter(t)]
                if on:
                    for i, p in zip(on, m.predict(np.array([features(part[i]) for i in on]))):
                        found[i] = p
                names, scores, rejected = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.slice(at, 128), held.slice(at, 128), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Train on docs (doc_id, text, lang) and predict every row of it.

    Null, empty and letterless texts are ``und`` with score 0; long texts are read whole; repeated rows agree; of equal cosines the first centroid by
    language wins; an empty table gives no rows, one without usable labels only ``und``; other columns are ignored.
    """
    return predict(docs, train(docs.select(F.col("doc_id").cast("long"), "text", "lang"), sample))


def crc_held_out(doc_id: int | None) -> bool:
    """The split of ``held_out`` for one id, in Python."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
