"""URL filters: explicit rules, and a path-template tree per host for what no rule fits.

The tree is built from counts per (host, path), so hot URLs are one row and no host is ever collected. At a node whose paths all go
on alike, what they share is taken at once. Where they part, the branches with at least ``MIN_COUNT`` URLs are compared: branches of like
shares (of URLs labelled, of those blocked, of URLs that end there; in a bounded number of cells) are pooled, pools are merged where two-proportion tests
find no difference, first with all the rare segments together; a branch that differs from the rest of its pool, or is alone in it, stays literal. Merged
branches are the wildcard ``*``; a second pool of the same node is ``*2`` and so on. A literal segment that begins with ``*`` or a backslash gets a
backslash. Below a node of fewer than ``MIN_COUNT`` URLs all is wildcards. So the number of rounds is that of partings, however deep the paths.

Labels are the explicit rules' verdicts. A template's purity is its share of blocked labelled URLs, smoothed towards its ancestors up to the host and
the whole corpus, and towards the same template on all hosts if it has a literal segment. A URL without a rule is blocked iff that purity reaches
``PURITY`` and at least ``MIN_LABELS`` labels speak for it, on its host or in its template elsewhere.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.storage import materialize

#: (verdict, host, path): fits the host and its subdomains if the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_COUNT = 4
SIMILAR_Z = 2.58
SMOOTH = 4.0
MIN_LABELS = 5
PURITY = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules is a fixed list, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _differ(a: tuple, b: tuple) -> bool:
    """Whether two branches (n, lab, blk, leaf) differ in a share: two-proportion z tests; a share without a base tells nothing."""
    for part, whole in ((1, 0), (2, 1), (3, 0)):
        x, n, y, m = a[part], a[whole], b[part], b[whole]
        if n > 0 and m > 0:
            pool = (x + y) / (n + m)
            spread = math.sqrt(max(0.0, pool * (1 - pool) * (1 / n + 1 / m)))
            if spread > 0 and abs(x / n - y / m) > SIMILAR_Z * spread:
                return True
    return False


def merge_cells(cells: list[tuple[int, int, int, int, int, int]]) -> dict[int, tuple[str, tuple]]:
    """cell -> (wildcard, pooled n, lab, blk, leaf) of cells (cell, branches, n, lab, blk, leaf); rare segments are cell -1.

    Each cell joins the first pool that it doesn't differ from, the largest cells first; pools of one branch have the wildcard ''."""
    pools: list[list] = []  # [cells, branches, counts]
    for cell, branches, *own in sorted(cells, key=lambda c: (c[0] >= 0, -c[2], c[0])):
        home = next((p for p in pools if not _differ(p[2], tuple(own))), None)
        if home is None:
            pools.append([[cell], branches, tuple(own)])
        else:
            home[0].append(cell)
            home[1] += branches
            home[2] = tuple(x + y for x, y in zip(home[2], own))
    out, k = {}, 0
    for members, branches, counts in pools:
        many = branches > 1 or -1 in members
        k += many
        for c in members:
            out[c] = ("" if not many else "*" if k == 1 else f"*{k}", counts)
    return out


COUNTS = ("n", "lab", "blk", "leaf")
_PLACED = "array<struct<cell:int,wild:string,p_n:bigint,p_lab:bigint,p_blk:bigint,p_leaf:bigint>>"


def _merged(cells: Column) -> Column:
    """merge_cells() over an array of at most 151 cells a node."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[{"cell": c, "wild": w, "p_n": k[0], "p_lab": k[1], "p_blk": k[2], "p_leaf": k[3]} for c, (w, k) in merge_cells([tuple(int(x[f]) for f in ("cell", "branches", *COUNTS)) for x in cells]).items()] for cells in column])

    return F.pandas_udf(run, _PLACED)(cells)


def _different(row: dict[str, Column], rest: dict[str, Column]) -> Column:
    """_differ() as a Column."""
    out = F.lit(False)
    for part, whole in (("lab", "n"), ("blk", "lab"), ("leaf", "n")):
        x, y = row[part].cast("double"), rest[part].cast("double")
        n, m = (F.when(c > 0, c.cast("double")) for c in (row[whole], rest[whole]))
        pool = (x + y) / (n + m)
        spread = F.sqrt(F.greatest(F.lit(0.0), pool * (1 - pool) * (1 / n + 1 / m)))
        out = out | F.coalesce((spread > 0) & (F.abs(x / n - y / m) > SIMILAR_Z * spread), F.lit(False))
    return out


def _literal(segments: Column) -> Column:
    """These segments as one part of a template."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda x: F.when(F.startswith(x, F.lit("*")) | F.startswith(x, F.lit("\\")), F.concat(F.lit("\\"), x)).otherwise(x)), "/"))


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, n, lab, blk; one row per host and path) plus ``template`` and ``_parts``, the steps that made it."""
    segments = F.when(F.col("path") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.regexp_replace("path", "^/", ""), "/", -1))
    t = paths.withColumn("_rest", segments).withColumn("_parts", F.expr("cast(array() as array<string>)")).withColumn("template", F.lit(""))
    t, key = materialize(t, "paths"), ["host", "template"]
    while t.where(F.size("_rest") > 0).limit(1).count():
        going = t.where(F.size("_rest") > 0)
        sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")] + [F.sum(F.when(F.size("_rest") == 1, F.col("n")).otherwise(0)).alias("leaf")]
        kids = going.groupBy(*key, F.col("_rest")[0].alias("_seg")).agg(*sums, F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"))
        kids = materialize(kids, "branches")
        cell = F.ceil(4.0 * F.col("leaf") / F.col("n")) + 5 * F.ceil(4.0 * F.col("lab") / F.col("n")) + 25 * F.coalesce(F.ceil(4.0 * F.col("blk") / F.when(F.col("lab") > 0, F.col("lab"))) + 1, F.lit(0))
        kids = kids.withColumn("cell", F.when(F.col("n") < MIN_COUNT, -1).otherwise(cell).cast("int"))
        cells = kids.groupBy(*key, "cell").agg(F.count("*").alias("branches"), *[F.sum(c).alias(c) for c in COUNTS], F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        nodes = cells.groupBy(*key).agg(F.sum("n").alias("all_n"), F.sum("branches").alias("all_branches"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.collect_list(F.struct("cell", "branches", *COUNTS)).alias("cells"))
        nodes = materialize(nodes, "nodes")  # at most 151 cells each
        same = F.zip_with("_lo", "_hi", lambda a, b: F.coalesce(a == b, F.lit(False)))
        shared = F.coalesce(F.array_position(same, False).cast("int"), F.lit(0))
        nodes_ = nodes.select(*key, "all_n", F.when(F.col("all_branches") == 1, F.when(shared > 0, shared - 1).otherwise(F.least(F.size("_lo"), F.size("_hi")))).otherwise(0).alias("_same"))
        parting = nodes.where(f"all_n >= {MIN_COUNT} and all_branches > 1")
        pools = parting.select(*key, F.inline(_merged(F.col("cells"))))
        k = kids.where(F.col("cell") >= 0).join(pools, [*key, "cell"])
        own, rest = {c: F.col(c) for c in COUNTS}, {c: F.col(f"p_{c}") - F.col(c) for c in COUNTS}
        step = F.when((F.col("wild") == "") | _different(own, rest), _literal(F.array("_seg"))).otherwise(F.concat(F.lit("/"), F.col("wild")))
        steps = k.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_seg").alias("_s"), step.alias("_step"))
        joined = t.join(nodes_.select(F.col("host").alias("_nh"), F.col("template").alias("_nt"), "all_n", "_same"), (F.col("host") == F.col("_nh")) & (F.col("template") == F.col("_nt")) & (F.size("_rest") > 0), "left")
        joined = joined.join(steps, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.get("_rest", F.lit(0)) == F.col("_s")), "left")
        some, few = F.size("_rest") > 0, F.col("all_n") < MIN_COUNT
        took = F.when(~some, 0).when(few, F.size("_rest")).when(F.col("_same") > 0, F.col("_same")).otherwise(1)
        part = F.when(few, F.repeat(F.lit("/*"), F.size("_rest"))).when(F.col("_same") > 0, _literal(F.slice("_rest", 1, F.greatest(F.col("_same"), F.lit(1))))).otherwise(F.coalesce("_step", F.lit("/*")))
        grown = joined.withColumn("_part", F.when(some, part)).withColumn("_took", took)
        grown = grown.withColumn("_parts", F.when(some, F.concat("_parts", F.array("_part"))).otherwise(F.col("_parts"))).withColumn("template", F.when(some, F.concat("template", "_part")).otherwise(F.col("template")))
        grown = grown.withColumn("_rest", F.slice("_rest", F.col("_took") + 1, F.greatest(F.size("_rest"), F.lit(1))))
        t = materialize(grown.select(*t.columns), "paths")
    return t.drop("_rest")


def purities(t: DataFrame) -> DataFrame:
    """(host, template, labelled, support, purity) for every template of a stored table of paths with templates."""
    leaf = t.groupBy("host", "template", "_parts").agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk"))
    leaf = materialize(leaf, "templates")
    up = leaf.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_parts")))).withColumn("_p", F.array_join(F.slice("_parts", 1, F.col("_k")), ""))
    sums = up.groupBy("host", "_p").agg(F.sum("lab").alias("s_lab"), F.sum("blk").alias("s_blk"))
    whole = leaf.agg((F.sum("blk") / F.when(F.sum("lab") > 0, F.sum("lab"))).alias("rate")).select(F.coalesce("rate", F.lit(0.0)).alias("rate"))
    line = up.select("host", "template", "_k", "_p").join(sums, ["host", "_p"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("_k", "s_lab", "s_blk"))).alias("_line"))  # one per step
    elsewhere = leaf.groupBy("template").agg(F.sum("lab").alias("x_lab"), F.sum("blk").alias("x_blk")).where(F.col("template").rlike("/[^*]")).where("x_lab > 0")
    line = line.join(elsewhere, "template", "left").crossJoin(F.broadcast(whole))  # one row
    smooth = lambda p, lab, blk: (blk + SMOOTH * p) / (lab + SMOOTH)
    above = F.aggregate(F.slice("_line", 1, F.size("_line") - 1), F.col("rate").cast("double"), lambda p, x: smooth(p, x["s_lab"], x["s_blk"]))
    above = smooth(above, F.coalesce("x_lab", F.lit(0)), F.coalesce("x_blk", F.lit(0)))
    own = F.element_at("_line", -1)
    line = line.select("host", "template", smooth(above, own["s_lab"], own["s_blk"]).alias("purity"), F.greatest(F.col("_line")[0]["s_lab"], F.coalesce("x_lab", F.lit(0))).alias("support"))
    return line.join(leaf.select("host", "template", F.col("lab").alias("labelled")), ["host", "template"])


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, template, labelled, purity.

    Null urls and urls without :// have an empty host and path and are judged by that host's template. Repeated rows
    count as often as they occur. Long urls are read whole. Other columns are ignored. An empty table gives no rows.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("_r", matching_rule(F.col("host"), F.col("path"), rules))
    blocked = F.when(F.col("_r.verdict") == "block", 1).otherwise(0)
    counts = p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_r").isNotNull(), 1).otherwise(0)).alias("lab"), F.sum(blocked).alias("blk"))
    t = templates(counts)
    judged = t.select("host", "path", "template").join(purities(t), ["host", "template"])
    out = p.join(judged, ["host", "path"])
    own = F.when((F.col("support") >= MIN_LABELS) & (F.col("purity") >= PURITY), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "template", "labelled", F.round("purity", 6).alias("purity"))
