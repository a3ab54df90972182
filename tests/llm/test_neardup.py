import random
import re

import pytest

from lodestack.llm import neardup
from lodestack.llm.neardup import components, jaccard_groups, keep_one
from tests.llm import cases


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    sets = [shingle_set(t) for _, t, *_ in data]
    near = [[] for _ in data]
    for i in range(len(data)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 90 * (len(sets[i]) + len(sets[j]) - k):
                near[i].append(j)
                near[j].append(i)
    out = []
    for i, (d, *_) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        out.append((d, len(sets[i]), len(near[i]), min(ids) if ids else None))
    return out


def kept_rows(rows):
    """One row of each group, the smallest doc_id first, and all rows without words."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        if not sets[i]:
            out.append(rows[i])
        elif i not in seen:
            out.append(rows[i])
            todo = [i]
            while todo:
                a = todo.pop()
                for j in range(len(rows)):
                    k = len(sets[a] & sets[j])
                    if j not in seen and sets[j] and 100 * k >= 90 * (len(sets[a]) + len(sets[j]) - k):
                        seen.add(j)
                        todo.append(j)
    return out


def data():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    base = cases.rows(20)
    passage = " ".join(rng.choice(vocab) for _ in range(80))
    k = 1000
    for size in (9, 10, 40, 200, 400):
        for _ in range(6):
            words = [rng.choice(vocab) for _ in range(size)]
            for copy in range(rng.randint(1, 8)):
                w = list(words)
                for _ in range(rng.randint(0, max(1, size // 60))):
                    w[rng.randrange(len(w))] = rng.choice(vocab)
                base.append((k, " ".join(w).title() if copy % 2 else " ".join(w), "en", "s", 1, 1, 1, ""))
                k += 1
    for _ in range(40):  # a passage that many share
        base.append((k, passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 6, 9, 60]))), "en", "s", 1, 1, 1, ""))
        k += 1
    return base


@pytest.mark.parametrize("tight", [False, True])
def test_matches_brute_force(spark, tmp_path, monkeypatch, tight):
    if tight:  # bounds that bite change the work, not the links
        monkeypatch.setattr(neardup, "MAX_HEAVY", 8)
        monkeypatch.setattr(neardup, "MAX_BITS", 1 << 8)
        monkeypatch.setattr(neardup, "TILE_BYTES", 1 << 12)
        monkeypatch.setattr(neardup, "TILE_PAIRS", 7)
        monkeypatch.setattr(neardup, "HOT", 3)
        monkeypatch.setattr(neardup, "COARSE", 2)
        monkeypatch.setattr(neardup, "BLOCK_CLASSES", 8)
        monkeypatch.setattr(neardup, "FLUSH_TOKENS", 500)
    rows = data()
    got = [(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in jaccard_groups(cases.stored(spark, tmp_path / "d", rows)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_a_large_family_makes_rows_in_proportion(spark, tmp_path, monkeypatch):
    """Near copies of one text, all alike in their prefixes: no pairs, a few rows per copy, and brute force's numbers of links."""
    rng, n = random.Random(3), 700
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "en", "s", 1, 1, 1, ""))
    sent = {}
    for name in ("candidates", "families", "verify"):
        monkeypatch.setattr(neardup, name, lambda *a, f=getattr(neardup, name), name=name: sent.setdefault(name, f(*a)))
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 100)
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_groups(cases.stored(spark, tmp_path / "d", rows)).collect()}
    assert got == {d: tuple(rest) for d, *rest in brute(rows)}
    links = sum(x[1] for x in got.values()) // 2
    assert sent["candidates"].count() <= n * neardup.HOT // 2 < links and sent["families"].count() < 40 * n


def test_one_of_each_group_stays(spark, tmp_path):
    rows = data()
    d = cases.stored(spark, tmp_path / "d", rows)
    out = keep_one(d)
    assert out.columns == d.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r[0]), str(r[1])) for r in kept_rows(rows))


def test_each_row_is_judged_by_its_own_text(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(i, t, "en", "s", n, 1, 1, "") for n, (i, t) in enumerate([(1, a), (1, b[:-3] + " new end of this"), (2, a), (2, b), (2, c), (None, a), (None, c), (None, c), (None, ""), (None, None), (1, "")])]
    out = keep_one(cases.stored(spark, tmp_path / "d", rows)).collect()
    want = sorted((str(r[0]), str(r[1])) for r in kept_rows(rows))
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == want and ("1", a) in want and ("2", c) in want and len(want) >= 6


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "z")], "a string, b string")
    got = {r.v: r.root for r in components(e).collect()}
    assert got == {**{f"{i:03}": "000" for i in range(61)}, "x": "x", "y": "x", "z": "x"}


def test_empty_table(spark, tmp_path):
    assert jaccard_groups(cases.stored(spark, tmp_path / "d", [])).count() == 0
