import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestack.llm.quality import RULES, allowed_rejections, keep_good, quality_rules
from tests.llm import cases


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    places = {p for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(places) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(places), failed


def corpus():
    rng = random.Random(1)
    vocab = [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "klmnrst"]
    rows, labels = [], []
    for i in range(3000):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        bad = i % 10 == 0
        if bad:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "s", 0, 0, 0, ""))
        labels.append((i, 0 if bad else 1, 0, "en"))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int, lang string"


def test_base_counts_match_brute_force(spark, tmp_path):
    rows = cases.rows(60)
    got = quality_rules(cases.stored(spark, tmp_path / "d", rows), spark.createDataFrame([(5, 1, 0, "x"), (5, None, 0, "x"), (None, 1, 0, "x")], LABELS)).collect()
    key = lambda r: tuple(map(str, r))
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    assert have == sorted(((d, *brute(t)) for d, t, *_ in rows), key=key)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels: no cutoffs


def test_cutoffs_reject_bad_and_keep_good(spark, tmp_path):
    rows, labels = corpus()
    d = cases.stored(spark, tmp_path / "d", rows)
    lab = spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality_rules(d, lab).collect()}
    good = [got[i] for i, q, *_ in labels if q == 1]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert not any(got[i].kept for i, q, *_ in labels if q == 0)
    out = keep_good(d, lab)
    assert out.columns == d.columns and out.count() == sum(r.kept for r in got.values())


def test_binomial_bound_is_exact(spark):
    def cdf(k, n, p):
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))

    ns = [0, 1, 10, 100, 597, 598, 599, 2000, 50000]
    rows = spark.createDataFrame([(n,) for n in ns], "n long").select("n", allowed_rejections(F.col("n"), 0.005, F.lit(0.05)).alias("k")).collect()
    for n, k in rows:
        want = -1
        while want + 1 < n and n and cdf(want + 1, n, 0.005) <= 0.05:
            want += 1
        assert k == want, (n, k, want)
    (big,) = spark.range(1).select(allowed_rejections(F.lit(10**9).cast("long"), 0.005, F.lit(0.05)).alias("k")).first()
    assert 5_000_000 - 4500 < big < 5_000_000 - 3000 and len(RULES) == 4


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], LABELS)
    assert quality_rules(cases.stored(spark, tmp_path / "d", []), none).count() == 0
    assert quality_rules(cases.stored(spark, tmp_path / "e", cases.rows(3)), none).count() == len(cases.rows(3))


def test_rows_without_a_doc_id_have_their_own_verdict(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(n, t, "en", "s", 1, 1, 1, "") for n, t in [(1, good), (1, "too short"), (2, "too short"), (None, good), (None, "too short"), (None, None)]]
    out = keep_good(cases.stored(spark, tmp_path / "d", rows), spark.createDataFrame([], LABELS))
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", good), ("None", good)]


def test_false_rejections_on_unseen_rows(spark, tmp_path):
    """Cutoffs from one half of the labels reject at most the promised share of the other half's good documents."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 400)) + "#" * min(6, int(rng.expovariate(2))) for _ in range(40)), "en", "s", 0, 0, 0, "") for i in range(12000)]
    lab = spark.createDataFrame([(i, 1, 0, "en") for i in range(0, 12000, 2)], LABELS)
    out = quality_rules(cases.stored(spark, tmp_path / "d", rows), lab).where("doc_id % 2 = 1 and not base_failed")
    n, lost = out.count(), out.where("not kept").count()
    assert n > 5000 and 0 < lost <= 0.02 * n


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", 5, 6, 7)], "doc_id long, text string, lang string, _t long, _w long, _q long")
    out = keep_good(d, spark.createDataFrame([], LABELS))
    assert out.columns == d.columns and tuple(out.first()) == (1, "a b c d e f g h i j k", "en", 5, 6, 7)
