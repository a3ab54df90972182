"""Versions of documents: visibility, compaction, segment planning, base and delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIB = 1 << 20


def latest(log: DataFrame, key: str = "id", order: tuple[str, ...] = ("generation", "seq")) -> DataFrame:
    """The last event of every key: a partial aggregation, so a key with very many events isn't sorted in one task."""
    rest = [c for c in log.columns if c != key]
    picked = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_e"))
    return picked.select(key, *[F.col(f"_e.{c}").alias(c) for c in rest])


def visible(log: DataFrame, **keys) -> DataFrame:
    return latest(log, **keys).where("op = 'upsert'")


def deleted(log: DataFrame, **keys) -> DataFrame:
    return latest(log, **keys).where("op = 'delete'")


def as_of(log: DataFrame, generation: int, **keys) -> DataFrame:
    return visible(log.where(F.col("generation") <= generation), **keys)


def compact(log: DataFrame, first: int, last: int, total: int, **keys) -> DataFrame:
    """The rows that remain of segments first..last: the last event of each id; deletions go only if the range is everything."""
    kept = latest(log.where(F.col("segment").between(first, last)), **keys)
    return kept.where("op = 'upsert'") if first == 0 and last == total - 1 else kept


def tier(size: Column, small: int = 64 * MIB) -> Column:
    """Powers of four above the floor of small / 64."""
    floor = small // 64
    return F.floor(F.log(F.greatest(size, F.lit(floor)) / F.lit(float(floor))) / F.log(F.lit(4.0)) + 1e-9)


def small_runs(segments: DataFrame, small: int) -> DataFrame:
    """(run_start, length, bytes) for each maximal run of adjacent segments below ``small``. One row per segment: a manifest's size."""
    s = segments.withColumn("n", F.row_number().over(W.orderBy("ordinal"))).where(F.col("bytes") < small)
    s = s.withColumn("g", F.col("n") - F.row_number().over(W.orderBy("ordinal")))
    return s.groupBy("g").agg(F.min("ordinal").alias("run_start"), F.count("*").alias("length"), F.sum("bytes").alias("bytes")).drop("g")


def compaction_candidates(segments: DataFrame, small: int = 64 * MIB, least: int = 4, most: int = 8) -> DataFrame:
    """(run_start, length, bytes, tier) of adjacent segments of one tier, cut into stretches of at most ``most`` and kept from ``least`` on."""
    s = segments.withColumn("tier", tier(F.col("bytes"), small)).withColumn("n", F.row_number().over(W.orderBy("ordinal")))
    s = s.withColumn("g", F.col("n") - F.row_number().over(W.partitionBy("tier").orderBy("ordinal")))
    s = s.withColumn("part", F.floor((F.row_number().over(W.partitionBy("tier", "g").orderBy("ordinal")) - 1) / most))
    runs = s.groupBy("tier", "g", "part").agg(F.min("ordinal").alias("run_start"), F.count("*").alias("length"), F.sum("bytes").alias("bytes"))
    return runs.where(F.col("length") >= least).select("run_start", "length", "bytes", F.col("tier").cast("long").alias("tier"))


def choose_range(sizes: list[int], small: int = 64 * MIB, least: int = 4, most: int = 8, budget: int = 512 * MIB, manual: bool = False) -> tuple[int, int] | None:
    """The range (start, length) of a manifest's segments to compact: the longest same-tier stretch within the limits, then the
    smallest, then the earliest. Manual mode needs two and falls back to the first segment."""
    floor = small // 64

    def level(n: int) -> int:
        n, t = max(n, floor), 0
        while n >= floor * 4:
            n //= 4
            t += 1
        return t

    best = None
    for i in range(len(sizes)):
        total, j = sizes[i], i + 1
        while j < len(sizes) and j - i < most and level(sizes[j]) == level(sizes[i]) and total + sizes[j] <= budget:
            total += sizes[j]
            j += 1
        if j - i >= (2 if manual else least) and (best is None or (-(j - i), total) < best[:2]):
            best = (-(j - i), total, i)
    if best:
        return best[2], -best[0]
    return (0, 1) if manual and sizes else None


def plan_segments(sizes: list[int], target: int = 128 * MIB, hard: int = 256 * MIB, tail: int = 64 * MIB, merged: int = 192 * MIB) -> list[tuple[int, int]]:
    """Cut documents of these payload sizes, in order, into slices [start, end): filled to the target, never beyond the hard bound
    unless a single document is, and a small tail joins its neighbour if that stays within ``merged``."""
    out, start, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (used + n > target or used + n > hard):
            out.append((start, i))
            start, used = i, 0
        used += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    if len(out) > 1:
        (a, b), (c, d) = out[-2:]
        if sum(sizes[c:d]) < tail and sum(sizes[a:d]) <= merged:
            out[-2:] = [(a, d)]
    return out


def slice_count(size: int, target: int = 128 * MIB, hard: int = 256 * MIB) -> int:
    """In how many segments of about ``target`` bytes to write a batch: one as long as that stays below ``hard``. Documents are dealt by a hash of
    their id, whole, so no order of all documents is needed."""
    return 1 if size <= hard else -(-size // target)


def base_delta(current: DataFrame, base: DataFrame) -> DataFrame:
    """(segment_id, fingerprint, state): base where the base has the same segment, else delta; missing for what only the base has."""
    keys = ["segment_id", "fingerprint"]
    now = current.join(base.select(*keys, F.lit(True).alias("_b")), keys, "left").select(*keys, F.when(F.col("_b"), "base").otherwise("delta").alias("state"))
    return now.unionByName(base.join(current, keys, "left_anti").select(*keys, F.lit("missing").alias("state")))


def group_requests(requests: list[tuple[int, list]], most: int = 10_000) -> list[list[int]]:
    """Requests (number, ids) in order, grouped so that no id repeats between the requests of a group and no group passes ``most`` operations."""
    groups, seen, size = [], set(), 0
    for request, ids in requests:
        if not groups or size + len(ids) > most or seen & set(ids):
            groups.append([])
            seen, size = set(), 0
        groups[-1].append(request)
        seen |= set(ids)
        size += len(ids)
    return groups


def microbatches(requests: DataFrame, most: int = 10_000) -> DataFrame:
    """(trigger, batch, request) of requests (trigger, request, ids): group_requests() within each trigger, whose requests one task holds."""
    import pandas as pd

    kind = dict(requests.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("request")
        rows = [(part["trigger"].iloc[0], b, r) for b, group in enumerate(group_requests([(r, list(i)) for r, i in zip(part["request"], part["ids"])], most)) for r in group]
        return pd.DataFrame(rows, columns=["trigger", "batch", "request"])

    return requests.groupBy("trigger").applyInPandas(run, f"trigger {kind['trigger']}, batch long, request {kind['request']}")
