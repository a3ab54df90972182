"""Quality rules with risk-controlled thresholds (native: DataFrame functions only).

``measure`` computes, per row, the base counts and integer badness scores (per mille, large is bad).
``fit_thresholds`` turns labelled good documents into one cutoff per stratum and score:

* the loosest-to-strictest sequence of cutoffs is tested in order, and the strictest one is taken whose
  exact binomial (Clopper-Pearson) bound says that at most ``risk / n_rules`` of the stratum's good
  documents are rejected;
* every test runs at level ``delta / (strata * rules)`` (Bonferroni), so with probability
  ``1 - delta`` all strata keep at least ``1 - risk`` of their good documents at once.

A stratum with too few labelled documents gets no cutoff: nothing there is rejected by the method.
The thresholds read counts per (stratum, score, value), at most 1001 rows each, so no task ever holds
a stratum's documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import text_of
from lodestack.storage import materialize

WINDOW = 5
RULES = ("symbols", "marks", "dup_lines", "few_words")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Strata up to which the cutoffs (a few numbers each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_STRATA = 20_000


def _count_chars(text: Column, keep: str) -> Column:
    """Code points of text within the character class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _permille(part: Column, whole: Column) -> Column:
    """part / whole in whole thousandths, rounded up; 0 if whole is 0."""
    return F.when(whole > 0, F.least(F.ceil(part * 1000 / whole), F.lit(1000))).otherwise(F.lit(0)).cast("int")


def measure(docs: DataFrame) -> DataFrame:
    """docs plus ``_q`` (in place of a column of that name): a struct of the base counts and the badness scores of the whole text.

    Null text counts as empty (all counts 0). Rows are independent; nothing is shuffled.
    n_repeat_words: the word positions inside 5-word windows that occur twice or more, found by sorting
    window hashes (64 bits) beside their places; a text without repeated windows skips the sort.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), text_of().alias("_t"))
    d = d.withColumn("_w", F.filter(F.split(F.regexp_replace("_t", r"[\x09-\x0D]", " "), " ", -1), lambda w: w != ""))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_h")
    d = d.withColumn(
        "_win",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])),
        ).otherwise(F.expr("cast(array() as array<bigint>)")),
    )
    d = d.withColumn("_rep", F.size(F.array_distinct("_win")) < F.size("_win"))
    d = d.withColumn(
        "_s",
        F.when(F.col("_rep"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
        ),
    )
    places = F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce((k > 0) & (F.get("_s", k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    d = d.withColumn(
        "_b",
        F.struct(
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            _count_chars(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_rep"), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
            _count_chars(F.col("_t"), r"!?~^=+@{}\\\[\]\\/|#*$%&<>").alias("n_marks"),
        ),
    )
    b, zero = F.col("_b"), F.lit(0).cast("int")
    words, chars = b["n_words"], b["word_chars"]
    score = {
        "symbols": _permille(b["n_symbols"], chars),
        "marks": _permille(b["n_marks"], chars),
        "dup_lines": _permille(b["n_dup_lines"], b["n_lines"]),
        # distinct words against what a text of this length is expected to have at least: its square root
        "few_words": F.when(words > 0, F.least(F.ceil(250 * F.sqrt(words.cast("double")) / b["n_distinct"]), F.lit(1000))).otherwise(zero).cast("int"),
    }
    q = F.struct(
        *[b[c].alias(c) for c in BASE],
        ((words < 10) | (100 * b["n_repeat_words"] > 20 * words)).alias("base_failed"),
        *[score[r].alias(r) for r in RULES],
    )
    return d.select(*[F.col(f"_own.`{c}`").alias(c) for c in docs.columns if c != "_q"], q.alias("_q"))


def _lgamma(x: Column) -> Column:
    """log gamma(x) for x >= 1: Stirling's series at x + 8, stepped back."""
    z = x + 8.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * F.log(F.lit(6.283185307179586)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    return series - reduce(lambda a, k: a + F.log(x + float(k)), range(1, 8), F.log(x))


def allowed_rejections(n: Column, risk: float, level: Column) -> Column:
    """The largest k for which k rejections among n good documents prove, at this level, a rejection rate of
    at most ``risk``: P(Bin(n, risk) <= k) <= level. -1 if even none proves it.

    The distribution is summed exactly term by term, from so far below the mean that what lies before it is
    below 1e-300, so an array of O(sqrt(n)) terms is enough for any n.
    """
    m = n * risk
    spread = F.sqrt(m * (1 - risk)) + 1
    low = F.greatest(F.lit(0), F.floor(m - 40 * spread)).cast("long")
    high = F.least(n, F.ceil(m)).cast("long")
    x, k0 = n.cast("double"), low.cast("double")
    first = _lgamma(x + 1) - _lgamma(k0 + 1) - _lgamma(x - k0 + 1) + k0 * F.log(F.lit(risk)) + (x - k0) * F.log(F.lit(1 - risk))
    ratio = F.log(F.lit(risk / (1 - risk)))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"), (low - 1).alias("best"))

    def step(a: Column, k: Column) -> Column:
        total = a["sum"] + F.exp(a["term"])
        after = a["term"] + F.log((x - k) / (k + 1.0)) + ratio
        return F.struct(F.when(k < n, after).otherwise(F.lit(-1e9)).alias("term"), total.alias("sum"), F.when(total <= level, k).otherwise(a["best"]).alias("best"))

    return F.when(n > 0, F.aggregate(F.sequence(low, high), start, step, lambda a: a["best"])).otherwise(F.lit(-1).cast("long"))


def fit_thresholds(good: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Cutoffs (stratum, rule, cutoff, n_good): a score above its cutoff is rejected; no row: never rejected.

    good: labelled good documents with ``stratum`` (non-null) and one int column per rule.
    """
    long = good.select("stratum", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RULES]), F.array(*RULES))).alias("rule", "value"))
    counts = long.groupBy("stratum", "rule", "value").count()
    total = F.struct(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("count").alias("c")))).alias("hist"))
    per = counts.groupBy("stratum", "rule").agg(total.alias("g")).select("stratum", "rule", "g.*")  # at most 1001 values each
    strata = good.agg(F.count_distinct("stratum").alias("strata"))
    per = per.crossJoin(F.broadcast(strata))  # one row
    level = F.lit(delta) / (F.col("strata") * len(RULES))
    per = per.withColumn("k", allowed_rejections(F.col("n"), risk / len(RULES), level))
    # from the largest value down: the first value whose rejection would exceed k is the cutoff
    walk = F.aggregate(
        "hist",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("cut")),
        lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["cut"], F.when(a["seen"] + x["c"] > F.col("k"), -x["v"])).alias("cut")),
        lambda a: a["cut"],
    )
    return per.where("k >= 0").select("stratum", "rule", F.coalesce(walk, F.lit(0)).cast("int").alias("cutoff"), F.col("n").alias("n_good"))


def judge(measured: DataFrame, labels: DataFrame, stratum: Column, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """measured (with ``doc_id`` and ``_q``) plus ``_kept`` boolean, ``_failed`` array of rule names.

    measured is read more than once: hand in a stored table. A document is good when it has labels and all its
    non-null quality labels are 1; documents that fail the base rules don't count. A null stratum is ''.
    """
    m = measured.withColumn("_stratum", F.coalesce(stratum.cast("string"), F.lit("")))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good")).where("_good = 1")
    fitted = m.where(~F.col("_q.base_failed")).join(good.select("doc_id"), "doc_id", "left_semi").select(F.col("_stratum").alias("stratum"), *[F.col(f"_q.{r}").alias(r) for r in RULES])
    cuts = fit_thresholds(fitted, risk, delta)
    wide = materialize(cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut")), "cutoffs")
    if wide.count() <= BROADCAST_STRATA:
        wide = F.broadcast(wide)
    out = m.join(wide, m["_stratum"] == wide["stratum"], "left")
    failed = F.filter(F.array(*[F.when(F.col(f"_q.{r}") > F.element_at("_cut", F.lit(r)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = out.withColumn("_failed", failed).withColumn("_kept", ~F.col("_q.base_failed") & (F.size("_failed") == 0))
    return out.drop("stratum", "_cut", "_stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, kept, failed_rules.

    Null doc_id, text or stratum are kept as rows (empty text fails the base rules); repeated rows each get
    their verdict; an empty docs gives an empty result; without labels only the base rules reject.
    """
    small = materialize(measure(docs.select("doc_id", "text", F.col(stratum).alias("_lang"))).select("doc_id", "_lang", "_q"), "quality")
    out = judge(small, labels, F.col("_lang"), risk, delta)
    return out.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in BASE], F.col("_q.base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_failed").alias("failed_rules"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns. Verdicts stay with their rows, whatever their doc_id: a null one
    or one that other rows have too. Null and empty texts fail the base rules; long ones are measured whole; an empty docs gives no rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = materialize(measure(docs.select(row, "doc_id", "text", F.col(stratum).alias("_lang"))).select("_row", "doc_id", "_lang", "_q"), "quality")
    return judge(measured, labels, F.col("_lang"), risk, delta).where("_kept").select("_row.*")
