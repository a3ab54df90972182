import random
import re

import pytest

from lodestack.llm import mixing
from lodestack.llm.mixing import apply_mix, fit_budget, mix_sources
from tests.llm import cases


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return {**t, **{s: cap * sizes[s] for s in capped}}
        capped |= set(over)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def data():
    rng = random.Random(3)
    out = cases.rows(40)
    for i in range(400):
        out.append((2000 + i, "w " * rng.randint(1, 90), "en", rng.choice(["big", "big", "big", "Zed", "é", "tiny" if i < 3 else "big"]), 0, 0, 0, ""))
    return out


def test_targets_and_sums(spark, tmp_path):
    rows = data()
    got = mix_sources(cases.stored(spark, tmp_path / "d", rows)).collect()
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    assert len(got) == len(rows) and sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    took = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size
        took[r.source] = took.get(r.source, 0) + r.taken
    for s in sizes:
        longest = max(words(r[1]) for r in rows if r[3] == s)
        assert abs(took[s] - want[s]) <= max(1, longest if s in ("s2",) else 1), (s, took[s], want[s])
    again = mix_sources(spark.read.parquet(str(tmp_path / "d")).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def sums_up_to(lengths, counts, budget):
    reach = 1
    for a, b in zip(lengths, counts):
        for _ in range(b):
            reach |= reach << a
    return (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1


@pytest.mark.parametrize("low, high", [(1, 40), (200, 3000), (5000, 20000)])
def test_fit_budget_against_brute_force(low, high):
    rng = random.Random(low)
    for _ in range(150):
        lengths = sorted(rng.sample(range(low, high), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 5)
        take = fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(a * t for a, t in zip(lengths, take)) == sums_up_to(lengths, counts, budget), (lengths, counts, budget)


def test_the_last_window_is_exact(monkeypatch):
    monkeypatch.setattr(mixing, "WINDOW", 4)
    monkeypatch.setattr(mixing, "LOOSE", 16)
    rng = random.Random(2)
    for _ in range(500):
        lengths = sorted(rng.sample(range(1, rng.choice([8, 20])), rng.randint(1, 4)))
        counts = [rng.randint(1, 60) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        take = fit_budget(lengths, counts, budget)
        assert sum(a * t for a, t in zip(lengths, take)) == sums_up_to(lengths, counts, budget), (lengths, counts, budget)


def test_applied_mix_repeats_documents(spark, tmp_path):
    d = cases.stored(spark, tmp_path / "d", data())
    out, plan = apply_mix(d), mix_sources(d)
    assert out.columns == d.columns and out.count() == plan.agg({"times": "sum"}).first()[0]


def test_rows_of_one_doc_id_are_rows_of_their_own(spark, tmp_path):
    rows = [(d, t, "en", s, n, 0, 0, "") for n, (d, t, s) in enumerate([(1, "a " * 50, "x"), (1, "b " * 50, "x"), (None, "c " * 7, "x"), (None, "c " * 7, "x"), (2, "d " * 400, "y")] + [(3, "same " * 10, "z")] * 37)]
    d = cases.stored(spark, tmp_path / "d", rows)
    plan = mix_sources(d).collect()
    assert len(plan) == len(rows) and sum(r.source == "z" for r in plan) == 37
    sizes = {"x": 114, "y": 400, "z": 370}
    for s, target in brute_targets(sizes).items():
        took = sum(r.taken for r in plan if r.source == s)
        lengths = {"x": [7, 50], "y": [400], "z": [10]}[s]
        assert abs(took - target) <= max(lengths), (s, took, target)
    out = [r.text for r in apply_mix(d).collect()]
    for text in {r[1] for r in rows}:
        n = out.count(text)
        assert n == sum(r.times for r in plan if (r.size, r.source) == (words(text), next(x[3] for x in rows if x[1] == text))) or words(text) == 50


def test_empty_table(spark, tmp_path):
    d = cases.stored(spark, tmp_path / "d", [])
    assert mix_sources(d).count() == 0 and apply_mix(d).count() == 0
