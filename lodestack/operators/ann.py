"""Approximate nearest neighbours: an inverted file of vectors by centroid, with exact scores of what it probes.

A model is fitted on a bounded sample (``SAMPLE`` vectors in the order of a hash): about sqrt(n) centroids, at most ``MAX_CELLS``, and the number of cells
to *probe*, which is calibrated: the sample's own exact neighbours have to lie in the probed cells as often as ``TARGET`` says. So vectors in
clusters need few cells, and vectors without any structure need nearly all of them; recall is kept, speed is what varies. Every
vector is indexed: it belongs to its nearest centroid's cell.

A search joins queries and vectors by cell, in blocks of bounded size on both sides; each block is one matrix product that gives its best k per
query. Exact search is the same with a single cell.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.functions.scoring import vector_score

SAMPLE = 16384
MAX_CELLS = 4096
ROUNDS = 12
TARGET = 0.985
NEIGHBOURS = 10
SEED = 20240607
#: Vectors and queries of one block at most, about.
BLOCK = 16384
#: Scores that are held at once, about, so 8 bytes times a few of them.
SCORES = 1 << 20


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "l2":
        return 2 * q @ x.T - (x * x).sum(1)[None, :] - (q * q).sum(1)[:, None]
    s = q @ x.T
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(s, norm, out=np.zeros_like(s), where=norm > 0)
    return s


def _tiles(n: int, width: int):
    """Slices of n rows that have SCORES cells at most, or one row."""
    step = max(1, SCORES // max(1, width))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


@dataclass(frozen=True)
class AnnModel:
    metric: str
    centroids: np.ndarray
    probes: int

    def cells(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n best cells of each vector, best first."""
        out = np.empty((len(x), min(n, len(self.centroids))), np.int32)
        for at in _tiles(len(x), len(self.centroids)):
            s = _scores(self.metric, x[at], self.centroids)
            out[at] = np.argmax(s, axis=1)[:, None] if n == 1 else np.argsort(-s, axis=1, kind="stable")[:, :n]
        return out

    def dump(self) -> str:
        return json.dumps({"metric": self.metric, "probes": self.probes, "centroids": self.centroids.tolist()})

    @staticmethod
    def load(text: str) -> "AnnModel":
        d = json.loads(text)
        return AnnModel(d["metric"], np.array(d["centroids"], np.float64), d["probes"])


def fit_sample(x: np.ndarray, metric: str, cells: int, target: float = TARGET, neighbours: int = NEIGHBOURS) -> AnnModel:
    """A model of a sample: k-means centroids, and as many probes as the sample's own neighbours need."""
    rng = np.random.default_rng(SEED)
    cells = max(1, min(cells, len(x)))
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(ROUNDS):
        near = AnnModel(metric, c, cells).cells(x)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=cells)
        c = np.where(size[:, None] > 0, sums / np.maximum(1, size)[:, None], c)
    model = AnnModel(metric, c, cells)
    asked = x[rng.choice(len(x), min(len(x), 512), replace=False)]
    s = _scores(metric, asked, x)
    k = min(neighbours, len(x))
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    own, order = model.cells(x)[:, 0], np.argsort(-_scores(metric, asked, c), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).reshape(-1))
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return AnnModel(metric, c, probes)


def fit(vectors: DataFrame, metric: str, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> AnnModel | None:
    """A model of a table of vectors, None if it is empty. ``sample`` rows at most reach the driver."""
    n = vectors.count()
    rows = vectors.where(F.col(vector).isNotNull()).select(vector, F.xxhash64(F.lit(SEED), F.col(key)).alias("_h")).orderBy("_h").limit(sample).collect()
    if not rows:
        return None
    return fit_sample(np.array([r[vector] for r in rows], np.float64), metric, min(MAX_CELLS, int(np.sqrt(n))), target)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A matrix of a column of vectors of one length."""
    sizes = pc.unique(pc.list_value_length(column))
    if len(sizes) > 1 or column.null_count:
        raise ValueError("vectors have to be there and of one length")
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cell_of(model: AnnModel, vectors: DataFrame, vector: str = "embedding") -> Column:
    """The cell of each vector, in Arrow batches."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # MAX_CELLS centroids at most

    def run(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(_matrix(column))[:, 0]) if len(column) else pd.Series([], dtype="int64")

    return F.pandas_udf(run, "int")(F.col(vector))


def probed(model: AnnModel, queries: DataFrame, vector: str = "qv") -> Column:
    """The cells to probe for each query."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.cells(_matrix(column), shared.value.probes))) if len(column) else pd.Series([], dtype="object")

    return F.pandas_udf(run, "array<int>")(F.col(vector))


def block_search(vectors: DataFrame, queries: DataFrame, metric: str, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(q, key, score, rank): the best k of each query (q, qv, cells) among vectors (key, vector, cell) of its cells.

    Both sides of a cell are split in blocks by hash, as many as their counts ask for; scores are exact, ties go to the smaller key.
    """
    wide = queries.select("q", "qv", F.explode("cells").alias("cell"))
    splits = lambda rows: F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int")
    held = vectors.groupBy("cell").agg(splits(vectors).alias("vs")).join(wide.groupBy("cell").agg(splits(wide).alias("qs")), "cell")  # a row per cell
    part = lambda name, by: F.pmod(F.xxhash64(F.col(name)), F.col(by)).cast("int")
    left = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v"), "cell").join(F.broadcast(held), "cell").withColumn("vp", part("_key", "vs"))
    left = left.withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("cell", "vp", "qp", "_key", "_v")
    right = wide.join(F.broadcast(held), "cell").withColumn("qp", part("q", "qs"))
    right = right.withColumn("vp", F.explode(F.sequence(F.lit(0), F.col("vs") - 1))).select("cell", "vp", "qp", "q", "qv")

    def best(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": [], "_key": []}
        if mine.num_rows and asked.num_rows:
            mine = mine.take(pc.array_sort_indices(mine["_key"].combine_chunks()))
            x, m = _rows(mine["_v"]), min(k, mine.num_rows)
            for at in _tiles(asked.num_rows, len(x)):
                some = asked.slice(at.start, at.stop - at.start)
                s = np.round(_scores(metric, _rows(some["qv"]), x), 6)
                least = np.partition(s, len(x) - m, axis=1)[:, len(x) - m, None]
                more = s > least
                tied = s == least
                i, j = np.nonzero(more | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= m - more.sum(axis=1)[:, None])))  # of ties the first, by key
                out["q"].append(some["q"].combine_chunks().take(pa.array(i)))
                out["_key"].append(mine["_key"].combine_chunks().take(pa.array(j)))
        return pa.table({"q": pa.chunked_array(out["q"], asked.schema.field("q").type), "_key": pa.chunked_array(out["_key"], mine.schema.field("_key").type)})

    names = ["cell", "vp", "qp"]
    types = {f.name: f.dataType.simpleString() for f in left.schema} | {f.name: f.dataType.simpleString() for f in right.schema}
    found = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInArrow(best, f"q {types['q']}, _key {types['_key']}")
    scored = found.join(vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v")), "_key").join(queries.select("q", "qv"), "q")
    scored = scored.select("q", F.col("_key").alias(key), F.round(vector_score(metric, F.col("qv"), F.col("_v")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), key)))
    return ranked.where(F.col("rank") <= k)


def ann_search(model: AnnModel | None, vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best k of each query (q, qv) in the cells that the model probes; vectors may hold their ``cell`` already."""
    if model is None:
        return queries.select("q", F.lit(None).cast(dict(vectors.dtypes)[key]).alias(key), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where(F.lit(False))
    placed = vectors if "cell" in vectors.columns else vectors.withColumn("cell", cell_of(model, vectors, vector))
    return block_search(placed, queries.withColumn("cells", probed(model, queries)), model.metric, k, key, vector)


def exact_search(vectors: DataFrame, queries: DataFrame, metric: str, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best k of each query (q, qv) among all vectors, block by block."""
    return block_search(vectors.withColumn("cell", F.lit(0)), queries.withColumn("cells", F.array(F.lit(0))), metric, k, key, vector)
