"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a share of all words by weight, at most three times its own size. Its documents are taken as
often as the whole of the target allows; what is left of the target is a subset-sum problem over *document lengths*:
documents are counted by exact length, most of the budget is spread over the lengths in proportion, and
bounded knapsacks over lengths and counts exchange documents until the target is met, or as nearly as any choice of documents
can. Which documents of a length are taken is decided by a seeded hash.

The plan sees counts per (source, length), never documents. Hash slices bound the groups that are ranked, and rows that are alike are one
row there.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestack.llm.common import text_of
from lodestack.storage import materialize, scratch

CAP = 3
WEIGHTS = (1, 2, 3)
#: Words of the first window of exchanges, of the largest before the last one, and of the last one.
WINDOW, LOOSE, MOST = 1 << 14, 1 << 22, 1 << 27
SLICES = 256
SEED = 20240607


def n_words() -> "F.Column":
    """Runs without ASCII white space in ``text`` (null: 0)."""
    return F.size(F.filter(F.split(F.regexp_replace(text_of(), r"[\x09-\x0D]", " "), " ", -1), lambda w: w != "")).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources (one row per source) plus ``k``, its number by code points, null last: ranges are numbered apart, then shifted by their sizes."""
    ranged = sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(F.col("source").isNull(), "source")) - 1)
    return own.join(F.broadcast(before), "_p").withColumn("k", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source, null last.

    Targets that would pass ``cap`` times their source stop there; the excess is shared again by weight, until none is above. The
    share per weight only grows from round to round, and a round is one aggregate over the sources, so any number of them will do.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = numbered(sizes.withColumn("source_size", F.coalesce("source_size", F.lit(0)))).withColumn("w", w).drop("k")
    s = materialize(s.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w")), "weights")
    level, capped = -1.0, None
    while True:
        free = F.col("ratio") >= level
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(~free, F.col("most"))).alias("held"), F.sum(F.when(free, F.col("w"))).alias("w"), F.sum((~free).cast("long")).alias("capped")).first()
        if not r["w"] or r["capped"] == capped:
            break
        level, capped = (float(r["all"]) - (r["held"] or 0.0)) / r["w"], r["capped"]
    return s.select("source", "source_size", F.when(F.col("source_size") > 0, F.least(F.lit(level) * F.col("w"), F.col("most"))).otherwise(F.lit(0.0)).alias("target"))


class _Sums:
    """Which sums up to ``most`` some lengths make, and the part (length's number, how many) that first reached each."""

    def __init__(self, most: int):
        self.on, self.first, self.parts = np.zeros(most + 1, bool), np.zeros(most + 1, np.int32), []
        self.on[0] = True

    def add(self, i: int, k: int, length: int) -> bool:
        """Allow k more of length i, all or none; whether that reached a new sum."""
        w = k * length
        fresh = np.flatnonzero(self.on[:-w] & ~self.on[w:]) + w
        if len(fresh):
            self.on[fresh] = True
            self.first[fresh] = len(self.parts)
            self.parts.append((i, k, w))
        return len(fresh) > 0

    def used(self, total: int):
        """The parts that make ``total``: a sum's first part leaves a sum that earlier parts reached."""
        while total:
            i, k, w = self.parts[self.first[total]]
            yield i, k
            total -= w


def _split(count: int):
    """Powers of two and a rest, of which some make every number up to count."""
    step = 1
    while count > 0:
        yield min(step, count)
        count -= step
        step *= 2


def _exchange(lengths: list[int], counts: list[int], taken: list[int], left: int, window: int) -> tuple[list[int], int, bool]:
    """The best plan among those that give up at most ``window`` words of ``taken`` and take others instead: (plan, words left,
    whether that is the best of all)."""
    size = sum(n * t for n, t in zip(lengths, taken))
    rest = sum(n * (c - t) for n, c, t in zip(lengths, counts, taken))
    gone, come = _Sums(min(window, size)), _Sums(min(left + min(window, size), rest))

    def fits() -> bool:
        k = min(len(come.on) - left, len(gone.on))
        return k > 0 and bool((come.on[left : left + k] & gone.on[:k]).any())

    def grow() -> None:
        for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):  # short lengths make the finest sums
            for sums, spare in ((gone, taken[i]), (come, counts[i] - taken[i])):
                for k in _split(min(spare, (len(sums.on) - 1) // lengths[i])):
                    if sums.add(i, k, lengths[i]) and fits():
                        return

    grow()
    d, a = np.flatnonzero(gone.on), np.flatnonzero(come.on)
    best = a[np.searchsorted(a, d + left, "right") - 1]  # the most that fits where d words are given up; 0 always does
    at = int(np.argmin(d + left - best))
    plan = list(taken)
    for i, k in gone.used(int(d[at])):
        plan[i] -= k
    for i, k in come.used(int(best[at])):
        plan[i] += k
    still = int(d[at] + left - best[at])
    return plan, still, still == 0 or size <= window


def _filled(lengths: list[int], counts: list[int], taken: list[int], left: int, order) -> int:
    """Take what fits in this order; returns the words left."""
    for i in order:
        more = min(counts[i] - taken[i], left // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    return left


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near to budget as possible from below.

    Exact for any lengths and counts: a plan in proportion to the counts is improved by bounded-knapsack dynamic programs over what
    is given up and what is taken instead, in windows that grow until nothing is left over or the window holds every plan.
    The last window starts from a plan that fills one length after another (a vertex of the relaxed problem): some best plan
    differs from it by at most 2L + 2 documents, so by at most L (L + 2) words, L being the longest length after division by the greatest
    common divisor, however many documents there are. Windows end at ``MOST`` words, which is less than that only
    for L above 11,000; there a plan that no window improved may leave over what a larger exchange could have used.
    """
    taken = [0] * len(lengths)
    some = [i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0]
    if not some:
        return taken
    g = math.gcd(*(lengths[i] for i in some))
    n, c = [lengths[i] // g for i in some], [counts[i] for i in some]
    size, goal = sum(a * b for a, b in zip(n, c)), max(0, budget) // g
    plan = list(c) if goal >= size else [k * goal // size for k in c]
    left = 0 if goal >= size else goal - sum(a * b for a, b in zip(n, plan))
    for i in sorted(range(len(n)), key=lambda i: -n[i]):  # what rounding left
        more = min(c[i] - plan[i], left // n[i])
        plan[i] += more
        left -= more * n[i]
    reach = min(MOST, max(n) * (max(n) + 2))
    window, best = WINDOW, left == 0
    while not best and window < min(reach, LOOSE):
        plan, left, best = _exchange(n, c, plan, left, window)
        window *= 4
    if not best:
        vertex, rest = [0] * len(n), goal
        for i in range(len(n)):
            vertex[i] = min(c[i], rest // n[i])
            rest -= vertex[i] * n[i]
            if vertex[i] < c[i]:
                break
        vertex, rest, _ = _exchange(n, c, vertex, rest, reach)
        plan = vertex if rest < left else plan
    for i, k in zip(some, plan):
        taken[i] = k
    return taken


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source, source_size, target, times, taken.

    ``times`` is how often the mix takes the row, ``taken`` its words times that. Null text and empty text have size 0 and are never
    taken; a null source is a source of its own; rows that repeat a doc_id, or have none, are rows of their own. Rows with equal
    doc_id, size and text are alike, so which of them is taken once more doesn't matter. Long texts are counted whole. An empty docs gives no rows. Reruns agree.
    """
    return _mixed(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_row_id")), weights, cap, seed).drop("_row_id")


def _mixed(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """mix_sources plus ``_row_id``, a number of the row whose upper part is its partition's.

    Quotas go to *kinds*, rows alike in source, size, doc_id and text, which are one row each however often they are repeated;
    a kind that is taken in part is split by the partitions its rows came from, so no hot kind is ranked in one task.
    """
    rows = docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("text").alias("kind"), "_row_id", F.shiftright("_row_id", 33).alias("part"))
    rows = materialize(rows, "sizes")
    per_part = materialize(rows.groupBy("source", "size", "doc_id", "kind", "part").count(), "kinds")
    kinds = per_part.groupBy("source", "size", "doc_id", "kind").agg(F.sum("count").alias("n"))
    kinds = kinds.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "kind")).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    counts = materialize(kinds.groupBy("source", "size", "slice").agg(F.sum("n").alias("count")), "length-counts")
    targets = source_targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size")), weights, cap)
    targets = materialize(targets, "targets")

    def plan(table):
        import pyarrow as pa

        lengths, numbers = table.column("size").to_pylist(), table.column("n").to_pylist()
        size, target = table.column("source_size")[0].as_py(), table.column("target")[0].as_py()
        full = min(cap, int(target // size)) if size else 0
        order = sorted(range(len(lengths)), key=lambda i: lengths[i])
        take = fit_budget([lengths[i] for i in order], [numbers[i] for i in order], int(target + 0.5) - full * size) if full < cap else [0] * len(order)
        return pa.table({"source": pa.array([table.column("source")[0].as_py()] * len(order), pa.string()), "size": pa.array([lengths[i] for i in order], pa.int64()), "full": pa.array([full] * len(order), pa.int64()), "extra": pa.array(take, pa.int64())})

    by_length = counts.groupBy("source", "size").agg(F.sum("count").alias("n"))
    known = by_length.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, by_length["source"].eqNullSafe(targets["source"])).select(by_length["source"], "size", "n", "source_size", "target")
    plans = known.groupBy("source").applyInArrow(plan, "source string, size long, full long, extra long")  # a row per length
    far = (W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("count").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(*far)), F.lit(0))
    slices = counts.withColumn("before", before).alias("c").join(plans.alias("p"), F.expr("c.source <=> p.source and c.size = p.size")).select(
        F.col("c.source").alias("s"), F.col("c.size").alias("l"), F.col("c.slice").alias("x"), "full", F.greatest(F.lit(0), F.least(F.col("count"), F.col("extra") - F.col("before"))).alias("quota")
    )
    slices = slices.join(targets.select(F.col("source").alias("ts"), "source_size", "target"), F.expr("s <=> ts")).drop("ts")
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source", "size", "slice").orderBy("h", "doc_id", "kind").rowsBetween(*far)), F.lit(0))
    quotas = kinds.withColumn("earlier", earlier).join(slices, F.expr("source <=> s and size = l and slice = x"))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("earlier")))
    quotas = materialize(quotas.select("source", "size", "doc_id", "kind", "n", "full", more.alias("more"), "source_size", "target"), "quotas")
    same = " and ".join(f"a.{c} <=> b.{c}" for c in ("source", "size", "doc_id", "kind"))
    cut = quotas.where("more > 0 and more < n")
    split = per_part.alias("a").join(cut.alias("b"), F.expr(same)).select("a.*", "more")
    behind = F.coalesce(F.sum("count").over(W.partitionBy("source", "size", "doc_id", "kind").orderBy("part").rowsBetween(*far)), F.lit(0))
    split = split.withColumn("some", F.greatest(F.lit(0), F.least(F.col("count"), F.col("more") - behind))).drop("more", "count")
    told = rows.alias("a").join(split.alias("b"), F.expr(f"{same} and a.part = b.part")).select("a._row_id", "a.source", "a.size", "a.doc_id", "a.kind", "a.part", "some")
    told = told.withColumn("once", F.row_number().over(W.partitionBy("source", "size", "doc_id", "kind", "part").orderBy("_row_id")) <= F.col("some")).where("once")
    told = told.select(F.col("_row_id").alias("_r"), "once")
    out = rows.alias("a").join(quotas.alias("b"), F.expr(same)).select("a._row_id", "a.doc_id", "a.size", "a.source", "source_size", "target", "full", "more", "n")
    out = out.join(told, F.col("_row_id") == F.col("_r"), "left")
    times = F.col("full") + F.when((F.col("more") == F.col("n")) | F.coalesce("once", F.lit(False)), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(0).cast("long")
    return out.select("_row_id", "doc_id", "size", "source", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; same columns.

    Every row has its own number of repeats, whatever its doc_id; null and empty texts are never taken, long ones whole or not
    at all, and an empty docs gives no rows.
    """
    keyed = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_row_id")), "rows")
    with scratch():
        mixed = _mixed(keyed.select("_row.doc_id", "_row.source", "_row.text", "_row_id"), weights, cap, seed)
        mixed = materialize(mixed.where("times > 0").select("_row_id", "times"), "times", keep=True)
    repeated = keyed.join(mixed.hint("merge"), "_row_id")  # a number per row: too many to broadcast wherever it counts
    return repeated.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")
